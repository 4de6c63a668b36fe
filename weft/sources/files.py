"""Graphs from text files, and written graphs.

Folders and lines (tab-separated):

    vertices/*       id  n  n sources of incoming edges  n  n destinations of outgoing edges
    vtx_property/*   id  label number  [key number:value,...]        strings and characters in quotes
    edge_property/*  source  destination  label number  [...]
    index/vtx_label, index/edge_label                     name  number
    index/vtx_property_index, index/edge_property_index   name  number  type (1 int, 2 double, 3 char, 4 string)

Edges are the lines of ``edge_property``; ``disagreements`` shows where ``vertices`` says otherwise.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import EdgeArm, Graph, VertexArm
from weft.schema import CODES, TYPES, Schema

#: A property in a list: number, then a quoted text or anything up to a comma.
_PROPERTY = r"""(\d+):("[^"]*"|'[^']*'|[^,\]]*)"""


def _names(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """The driver holds the dictionary: one line for each label or key that was declared."""
    rows = [r.value.split("\t") for r in spark.read.text(path).collect() if r.value.strip()]
    return {int(r[1]): [r[0].strip(), *(x.strip() for x in r[2:])] for r in rows}


def _properties(lines: DataFrame, at: int, keys: dict[int, list[str]]) -> list:
    """A typed column for each key of the list in the given field."""
    found = F.map_from_entries(F.transform(F.array_distinct(F.regexp_extract_all(F.get("f", F.lit(at)), F.lit(_PROPERTY), F.lit(0))), lambda x: F.struct(F.split(x, ":", 2)[0].cast("int").alias("k"), F.split(x, ":", 2)[1].alias("v"))))
    plain = lambda v, t: F.regexp_replace(v, r"""^["']|["']$""", "") if t in ("string", "char") else v
    return [plain(F.element_at(found, F.lit(number)), CODES[int(kind)]).cast(TYPES[CODES[int(kind)]]).alias(name) for number, (name, kind) in keys.items()]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.trim(F.col("value"))
    return spark.read.text(path).where(F.length(text) > 0).select(F.split("value", "\t").alias("f"))


def from_files(spark: SparkSession, folder: str) -> Graph:
    labels, links = _names(spark, f"{folder}/index/vtx_label"), _names(spark, f"{folder}/index/edge_label")
    keys, link_keys = _names(spark, f"{folder}/index/vtx_property_index"), _names(spark, f"{folder}/index/edge_property_index")
    schema = Schema({n: CODES[int(t)] for n, t in keys.values()}, {n: CODES[int(t)] for n, t in link_keys.values()}, tuple(n for n, *_ in labels.values()), tuple(n for n, *_ in links.values()))
    v, e = _lines(spark, f"{folder}/vtx_property"), _lines(spark, f"{folder}/edge_property")
    number = lambda k: F.trim(F.get("f", F.lit(k))).cast("long")
    v = v.select(number(0).alias("vid"), number(1).alias("label"), *_properties(v, 2, keys))
    e = e.select(number(0).alias("src"), number(1).alias("dst"), number(2).alias("label"), *_properties(e, 3, link_keys))
    vertex_arms = [VertexArm(n, lambda k=k: v.where(F.col("label") == k).drop("label"), tuple(schema.vertex_keys)) for k, (n, *_) in labels.items()]
    edge_arms = [EdgeArm(n, lambda k=k: e.where(F.col("label") == k).drop("label"), tuple(schema.edge_keys)) for k, (n, *_) in links.items()]
    named = lambda rows, names: rows.withColumn("label", F.create_map(*(F.lit(x) for k, (n, *_) in names.items() for x in (k, n)))[F.col("label")])
    return Graph(spark, schema, vertex_arms, edge_arms, one_scan=(lambda: named(v, labels), lambda: named(e, links)))


def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of all edges that the files of vertices name, each from both of its ends."""
    lines = _lines(spark, f"{folder}/vertices").select(F.filter(F.split(F.concat_ws(" ", "f"), r"\s+"), lambda x: x != "").alias("n")).select(F.transform("n", lambda x: x.cast("long")).alias("n"))
    at = lambda k: F.get("n", k)
    n_in = at(F.lit(1)).cast("int")
    ends = lines.select(at(F.lit(0)).alias("v"), F.slice("n", 3, n_in).alias("into"), F.slice("n", n_in + 4, at(n_in + 2).cast("int")).alias("out"))
    into = ends.select(F.explode("into").alias("src"), F.col("v").alias("dst"))
    return into.unionByName(ends.select(F.col("v").alias("src"), F.explode("out").alias("dst")))


def disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that only the files of vertices or only those of edges have."""
    mine = from_files(spark, folder).edges()[0].select(F.col("e_src").alias("src"), F.col("e_dst").alias("dst")).distinct()
    theirs = adjacency(spark, folder).distinct()
    return mine.exceptAll(theirs).withColumn("only_in", F.lit("edges")).unionByName(theirs.exceptAll(mine).withColumn("only_in", F.lit("vertices")))


def write_graph(graph: Graph, folder: str) -> None:
    """A Parquet folder per arm and the schema; ``read_graph`` opens it."""
    spark, s = graph.spark, graph.schema
    known = {"vertex_keys": s.vertex_keys, "edge_keys": s.edge_keys, "vertex_labels": s.vertex_labels, "edge_labels": s.edge_labels}
    arms = {"vertices": [[a.label, a.keys] for a in graph.vertex_arms], "edges": [[a.label, a.keys, a.ends] for a in graph.edge_arms]}
    for kind, some in (("vertices", graph.vertex_arms), ("edges", graph.edge_arms)):
        for k, a in enumerate(some):
            a.frame().write.mode("overwrite").parquet(f"{folder}/{kind}-{k}")
    spark.createDataFrame([(json.dumps({"schema": known, "arms": arms}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/graph")


def read_graph(spark: SparkSession, folder: str) -> Graph:
    known = json.loads(spark.read.text(f"{folder}/graph").first().value)
    s = known["schema"]
    schema = Schema(s["vertex_keys"], s["edge_keys"], tuple(s["vertex_labels"]), tuple(s["edge_labels"]))
    vertex_arms = [VertexArm(n, lambda k=k: spark.read.parquet(f"{folder}/vertices-{k}"), tuple(keys)) for k, (n, keys) in enumerate(known["arms"]["vertices"])]
    edge_arms = [EdgeArm(n, lambda k=k: spark.read.parquet(f"{folder}/edges-{k}"), tuple(keys), tuple(ends)) for k, (n, keys, ends) in enumerate(known["arms"]["edges"])]
    return Graph(spark, schema, vertex_arms, edge_arms)
