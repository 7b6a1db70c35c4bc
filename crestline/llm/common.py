"""Shared helpers: the cluster's shared folder, written cuts of the lineage, and files in that folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (tests on one machine) is a local folder taken, once a session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="crestline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/crestline/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Settings (dots as __) within the block; the session's own come back after it."""
    wanted = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, codec: str = "zstd", tidy: bool = True, folder: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later work never recomputes it, whichever executors are lost.

    Shuffle files of the writing go at its end: Spark's cleaner drops them only once nothing refers to them, which one
    collection does not promise. tidy lets the cleaner drop the rest (broadcasts), which costs a collection on the driver.
    folder (of shared_dir) is for tables that one remove() takes away once all that reads them is written itself.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", codec).parquet(path)
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI in the shared folder, for Python workers (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def text_or_empty(name: str):
    """The column as a string; null reads as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal few but heavy rows (one per file or block) out to tasks, one each up to a multiple of the cores."""
    return df.repartition(max(1, min(rows, 64 * df.sparkSession.sparkContext.defaultParallelism)))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about `limit` bytes at most (one row at least): bounds a worker's memory."""
    for batch in batches:
        sizes = batch.column(column)
        offsets = pa.compute.binary_length(sizes).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(offsets):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(offsets):
            yield batch.slice(start)
