"""The relational tables as a property graph: ``vid = key * 16 + tag``, so ids are unique across tables and never 0."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import EdgeArm, Graph, VertexArm
from weft.schema import Schema

TAGS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "event": 7, "document": 8, "page": 9}
VERTEX_KEYS = {
    "name": "string", "acctbal": "double", "mktsegment": "string", "brand": "string", "ptype": "string", "size": "int", "retailprice": "double",
    "status": "string", "totalprice": "double", "orderyear": "int", "priority": "string", "etype": "string", "value": "double",
    "lang": "string", "source": "string", "n_chars": "int", "quality": "int", "toxic": "int", "url": "string",
}
EDGE_KEYS = {"quantity": "double", "extendedprice": "double", "discount": "double", "tax": "double", "returnflag": "string", "linestatus": "string", "linenumber": "int"}
EDGE_LABELS = ("in_region", "in_nation", "placed", "contains", "supplies", "did")


def vid(key: str, label: str):
    return (F.col(key).cast("long") * 16 + TAGS[label]).alias("vid")


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def vertices(label: str, table: Callable[[], DataFrame] | str, key: str, **props) -> VertexArm:
        def frame() -> DataFrame:
            rows = read(table) if isinstance(table, str) else table()
            return rows.select(vid(key, label), *((F.col(c) if isinstance(c, str) else c()).alias(k) for k, c in props.items()))

        return VertexArm(label, frame, tuple(props))

    def edges(label: str, table: Callable[[], DataFrame] | str, src: tuple[str, str], dst: tuple[str, str], **props) -> EdgeArm:
        def frame() -> DataFrame:
            rows = read(table) if isinstance(table, str) else table()
            return rows.select(vid(src[1], src[0]).alias("src"), vid(dst[1], dst[0]).alias("dst"), *(F.col(c).alias(k) for k, c in props.items()))

        return EdgeArm(label, frame, tuple(props), (src[0], dst[0]))

    def documents() -> DataFrame:
        """Grouped, labels are known to have one row for each document, so Catalyst drops the join where no label is asked for."""
        labels = read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        return read("documents").join(labels, "doc_id", "left")

    arms = [
        vertices("region", "region", "r_regionkey", name="r_name"),
        vertices("nation", "nation", "n_nationkey", name="n_name"),
        vertices("customer", "customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        vertices("supplier", "supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
        vertices("part", "part", "p_partkey", name="p_name", brand="p_brand", ptype="p_type", size="p_size", retailprice="p_retailprice"),
        vertices("order", "orders", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderyear=lambda: F.year("o_orderdate"), priority="o_orderpriority"),
        vertices("event", "events", "event_id", etype="event_type", value="value"),
        vertices("document", documents, "doc_id", lang="lang", source="source", n_chars="n_chars", quality="quality", toxic="toxic"),
        vertices("page", "pages", "page_id", url="url"),
    ]
    links = [
        edges("in_region", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
        edges("in_nation", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        edges("in_nation", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        edges("placed", "orders", ("customer", "o_custkey"), ("order", "o_orderkey")),
        edges("contains", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), **{k: f"l_{k}" for k in EDGE_KEYS}),
        edges("supplies", lambda: read("lineitem").select("l_suppkey", "l_partkey").distinct(), ("supplier", "l_suppkey"), ("part", "l_partkey")),
        edges("did", "events", ("customer", "user_id"), ("event", "event_id")),
    ]
    return Graph(spark, Schema(VERTEX_KEYS, EDGE_KEYS, tuple(a.label for a in arms), EDGE_LABELS), arms, links)
