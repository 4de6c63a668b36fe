"""Helpers that the training-data operators share: tables, scratch folders, file systems."""

from __future__ import annotations

import contextlib
import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Python workers on this machine, or with the same paths, find this package even if it is not installed."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [top, *paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session names none (tests, one machine), a temporary folder is made and set once.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set(key, found)
        _path(spark, found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}" if found.startswith("/") else found


def _path(spark: SparkSession, folder: str) -> None:
    """The folder goes when the application ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _path(spark, folder)
    return folder


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What an action within has shuffled is deleted when the action ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here, and lost executors lose nothing."""
    folder = scratch(df.sparkSession, name) + "/t"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def only(docs: DataFrame, digest: Column, id_col: str, kept: DataFrame) -> DataFrame:
    """The rows whose id and digest are in ``kept`` (i, key), one row for each: one shuffle of the documents."""
    name = lambda i, key: F.concat_ws(":", i.cast("string"), F.hex(key))
    kept = kept.select(name(F.col("i"), F.col("key")).alias("_name")).distinct()
    return docs.withColumn("_name", name(F.col(id_col), digest)).join(kept, "_name", "left_semi").dropDuplicates(["_name"]).drop("_name")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def size_of(df: DataFrame) -> int:
    """Spark's own estimate of the bytes of a plan: for files, their size. Nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; works in executors as in the driver."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), posixpath.normpath(parts.path)
    return fs.FileSystem.from_uri(uri)


def put_whole(uri: str, write) -> None:
    """Write a file under a name of this attempt, then move it: a task that runs again leaves the same whole file."""
    fs, path = file_system(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        write(out)
    fs.move(own, path)
