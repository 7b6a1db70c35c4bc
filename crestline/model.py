"""Scored item lists spread over nodes: rows (node_id, item_id, score), an item at most once a node, scores >= 0.

The result order everywhere is score descending, then item_id descending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def result_order():
    return F.desc("score"), F.desc("item_id")


def totals(rows: DataFrame) -> DataFrame:
    """Sum and number of answers per item; the sum of what was sent is a lower bound of an item's total."""
    return rows.groupBy("item_id").agg(F.sum("score").cast("bigint").alias("score"), F.count("*").alias("answers"))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k items of largest total: a partial aggregation, one exchange, and a take of k rows per task."""
    return totals(rows).select("item_id", "score").orderBy(*result_order()).limit(k)


def ranked(lists: DataFrame) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(*result_order())))


def local_top(lists: DataFrame, k: int) -> DataFrame:
    """Each node's first k items; the rank filter stays by the window, so that Spark limits groups before the shuffle."""
    return ranked(lists).where(F.col("rank") <= k).drop("rank")


def kth(scores: DataFrame, k: int, column: str = "score") -> int:
    """The k-th largest score, 0 if there are fewer: the one number that a round hands to the next."""
    least = scores.orderBy(F.desc(column)).limit(k).agg(F.count("*").alias("n"), F.min(column).alias("s")).first()
    return int(least.s) if least.n >= k else 0


def nodes(lists: DataFrame) -> int:
    return lists.select("node_id").distinct().count()


def unique(lists: DataFrame) -> DataFrame:
    """Duplicate items of a node summed."""
    return lists.groupBy("node_id", "item_id").agg(F.sum("score").cast("bigint").alias("score"))


def unsent(lists: DataFrame, sent: DataFrame) -> DataFrame:
    return lists.join(sent.select("node_id", "item_id"), ["node_id", "item_id"], "left_anti")


def placed(rows: DataFrame, order: list[str], descending: bool = True) -> DataFrame:
    """Rows with their place from 0 in one order over all, without a task that sees them all.

    Rows are dealt out by ranges of the order and sorted there; the driver holds the row count of each range.
    """
    spark = rows.sparkSession
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)
    offsets, total = [], 0
    for r in own.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, start long"))
    return own.withColumn("part", part).join(starts, "part").withColumn("place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")).drop("_at", "part", "start")
