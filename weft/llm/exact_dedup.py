"""Exact dedup by skew-safe combining, in DataFrame functions only.

Three steps, each of which groups by the digest *and* the whole normalised text:

1. local: the map side of the first aggregation leaves one row per text and input partition;
2. salted: those rows meet by (digest, text, salt), the salt being taken from the input partition, so a text that a
   third of all rows hold comes to ``salts`` tasks as one row per partition;
3. global: at most ``salts`` winners per text meet.

Texts travel only in the steps 2 and 3, copies no more than once per partition. The verdicts go back to the documents
by digest; documents whose digest stands for more than one text (found by step 3) go back by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import keep, only, table, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=sha256) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z only. Null text: empty. Of a group the largest id stays;
    null ids are smaller than any other, and a group of null ids only has a null ``keep_id``. An id is taken as the
    identity of its row: rows that repeat the id that stays are all kept, and count in ``group_size``. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    ``digest`` only routes; a weak one costs time, never correctness.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.translate(text_of(text_col), UPPER, LOWER).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    best = [F.max("_best").alias("_best"), F.sum("_rows").alias("_rows")]
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_text", "_salt")
        .agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_rows"))
    )
    groups = salted.groupBy("_digest", "_text").agg(*best)
    verdicts = keep(
        groups.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"), F.max("_best").alias("_best"), F.sum("_rows").alias("_rows"),
            F.max(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"),
        ),
        "op8-verdicts",
    )
    thin = rows.select("_id", "_digest")
    own = verdicts.where("_texts = 1").select("_digest", "_best", "_rows", "_sha")
    out = thin.join(own, "_digest")
    shared = verdicts.where("_texts > 1").select("_digest")
    if not shared.isEmpty():  # a digest that two texts share: decided by the texts themselves
        some = groups.join(shared, "_digest", "left_semi").withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256))
        out = out.select("_id", "_best", "_rows", "_sha").unionByName(rows.join(some, ["_digest", "_text"]).select("_id", "_best", "_rows", "_sha"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_best").alias("keep_id"), F.col("_rows").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_best")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def keep_last(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each group of equal texts the row with the largest id, with its own columns; rows that repeat both id and text
    become one, rows of a text that only null ids have too."""
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    i, t = (f"c{names.index(c)}" for c in (id_col, text_col))
    best = exact_dedup(docs, id_col=i, text_col=t, **how).where("kept").select(F.col(i).alias("i"), F.unhex("text_sha256").alias("key"))
    return only(docs, sha256(F.translate(text_of(t), UPPER, LOWER)), i, best).toDF(*names)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""
