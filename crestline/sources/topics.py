"""Search topics: their descriptions, their vocabulary, query files for it, and a topic's lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import placed

TRIM = "?!\n\t.\" "


def topics(spark: SparkSession, path: str) -> DataFrame:
    """topic (its number attribute, or null), description: the text without quotes and without marks at its ends."""
    rows = spark.read.format("xml").option("rowTag", "topic").schema("_number long, description string").load(path)
    return rows.select(F.col("_number").alias("topic"), F.replace(F.btrim("description", F.lit(TRIM)), F.lit('"'), F.lit("")).alias("description"))


def words(described: DataFrame) -> DataFrame:
    return described.select("topic", F.explode(F.split("description", " ")).alias("word"))


def vocabulary(described: DataFrame) -> DataFrame:
    """word, node_id: distinct words by name, numbered from 0."""
    return placed(words(described).select("word").distinct(), ["word"], descending=False).select("word", F.col("place").alias("node_id"))


def topic_lists(described: DataFrame, results: DataFrame, topic: int) -> DataFrame:
    """The lists (node_id, item_id, score) of a topic's words; a word without results is a stop word and drops out."""
    own = words(described.where(F.col("topic") == topic)).select("word").distinct().join(vocabulary(described), "word").select("node_id")
    return results.join(F.broadcast(own), "node_id", "left_semi")


def write_queries(vocabulary: DataFrame, path: str, each: int = 30) -> None:
    """One XML file (parameters of queries with type, number and text) for every `each` words, in the folder's parts."""
    query = vocabulary.select(F.floor(F.col("node_id") / each).alias("part"), F.lit("indri").alias("type"), F.col("node_id").alias("number"), F.col("word").alias("text"))
    query.repartition("part").sortWithinPartitions("number").write.format("xml").option("rootTag", "parameters").option("rowTag", "query").partitionBy("part").mode("overwrite").save(path)
