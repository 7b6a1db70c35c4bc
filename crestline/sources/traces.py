"""Binary web traces and search results as scored lists (node_id, item_id, score)."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import placed

# Record layouts. Home-IP trace, big-endian; access log, little-endian.
HOME_IP = ">IIIIIIIHIHBBIIIIIH"
ACCESS = "<IIIIBBBB"


def files(spark: SparkSession, glob: str) -> DataFrame:
    """Files of a glob as binary rows; a glob without files is an error of the reader."""
    return spark.read.format("binaryFile").load(glob).select("content")


def object_id(url: Column) -> Column:
    """The number of the second word of a request, up to its first dot; over 19 characters the first 18; modulo 2^32."""
    digits = F.substring_index(F.get(F.split(url, " ", 3), F.lit(1)), ".", 1)
    digits = F.regexp_replace(F.when(F.length(digits) > 19, F.substring(digits, 1, 18)).otherwise(digits), "^/", "")
    return F.when(digits.rlike("^[0-9]+$"), F.pmod(digits.cast("decimal(20,0)"), F.lit(1 << 32)).cast("bigint"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.where("item_id IS NOT NULL").groupBy("node_id", "item_id").agg(F.count("*").alias("score"))


def access_log(spark: SparkSession, glob: str, by_client: bool) -> DataFrame:
    """Requests per server and client or object of gzipped 20-byte records; a part of a record at the end is ignored."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                data = gzip.decompress(content)
                rows = list(struct.iter_unpack(ACCESS, data[: len(data) - len(data) % struct.calcsize(ACCESS)]))
                yield pa.RecordBatch.from_arrays([pa.array([r[7] for r in rows], pa.int64()), pa.array([r[1 if by_client else 2] for r in rows], pa.int64())], ["node_id", "item_id"])

    return counted(files(spark, glob).mapInArrow(decode, "node_id long, item_id long"))


def home_ip(spark: SparkSession, glob: str, by_client: bool, servers: int = 10) -> DataFrame:
    """Requests per server group (server address modulo `servers`) and client or object of gzipped records with URLs."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                data, at, rows = gzip.decompress(content), 0, []
                while at + struct.calcsize(HOME_IP) <= len(data):
                    r = struct.unpack_from(HOME_IP, data, at)
                    at += struct.calcsize(HOME_IP)
                    rows.append((r[8] % servers, r[6], data[at : at + r[17]].decode("latin-1")))
                    at += r[17]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["node_id", "client", "url"])

    rows = files(spark, glob).mapInArrow(decode, "node_id long, client long, url string")
    return counted(rows.select("node_id", (F.col("client") if by_client else object_id(F.col("url"))).alias("item_id")))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """word, doc, score of result lines `word Q0 doc rank score run`; scores are shifted above 0 and scaled by 1000."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.col("value").contains("Q0")).select(parts.alias("p")).where(F.size("p") == 6)
    rows = rows.select(F.col("p")[0].cast("bigint").alias("node_id"), F.col("p")[2].alias("doc"), F.col("p")[4].cast("double").alias("raw"))
    shift = rows.agg((1 - F.least(F.lit(0.0), F.min("raw"))).alias("shift"))
    return rows.crossJoin(F.broadcast(shift)).select("node_id", "doc", F.floor((F.col("raw") + F.col("shift")) * 1000).cast("bigint").alias("score"))


def numbered(results: DataFrame) -> DataFrame:
    """Lists with dense document numbers from 0, by name; the dictionary has a row per document."""
    names = placed(results.select("doc").distinct(), ["doc"], descending=False).select("doc", F.col("place").alias("item_id"))
    return results.join(names, "doc").groupBy("node_id", "item_id").agg(F.sum("score").alias("score"))
