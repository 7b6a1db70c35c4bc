"""Scored lists from the driver's tables, and deterministic skewed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each source is one SQL text that Spark and other engines read alike.
TABLES = {
    "L1": "SELECT l_suppkey % 10 AS node_id, l_partkey AS item_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY l_suppkey % 10, l_partkey",
    "L2": "SELECT l_suppkey % 10 AS node_id, l_partkey AS item_id, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY l_suppkey % 10, l_partkey",
    "L3": "SELECT l_suppkey % 10 AS node_id, l_partkey AS item_id, count(*) AS score FROM lineitem GROUP BY l_suppkey % 10, l_partkey",
    "E1": "SELECT CAST(hour(ts) % 8 AS BIGINT) AS node_id, user_id AS item_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS score FROM events GROUP BY hour(ts) % 8, user_id",
    "E2": "SELECT t.node_id, e.item_id, e.score FROM (SELECT event_type, user_id AS item_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS score FROM events GROUP BY event_type, user_id) e JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS node_id FROM (SELECT DISTINCT event_type FROM events) d) t ON t.event_type = e.event_type",
    "E3": "SELECT CAST(hour(ts) % 8 AS BIGINT) AS node_id, user_id AS item_id, count(*) AS score FROM events GROUP BY hour(ts) % 8, user_id",
}


def affine(x: str, a: int, b: int) -> str:
    return f"(({a} * (({x}) % 2147483647) + {b}) % 2147483647)"


def zipf_sql(nodes: int, n: int, zipf: float, overlap: float, reorder: int, seed: int) -> str:
    """Lists of one score curve, max(1, floor((n / place)^zipf)); ids are shared by rank with the chance `overlap`, and
    places are shifted by up to `reorder`."""
    u1, u2 = affine(f"node_id * 1000003 + rnk * 7919 + {seed}", 1103515245, 12345), affine(f"node_id * 15485863 + rnk * 104729 + {seed}", 69069, 362437)
    return f"""SELECT node_id, item_id, CAST(greatest(1, floor(power(CAST({n} AS DOUBLE) / pos, CAST({zipf} AS DOUBLE)) + 1e-9)) AS BIGINT) AS score FROM (
  SELECT node_id, CASE WHEN u1 % 10000 < {round(overlap * 10000)} THEN rnk ELSE 100000000 * (node_id + 1) + rnk END AS item_id,
         row_number() OVER (PARTITION BY node_id ORDER BY rnk + u2 % {reorder + 1}, rnk) AS pos FROM (
    SELECT node_id, rnk, {u1} AS u1, {u2} AS u2 FROM (SELECT a.i AS node_id, b.i + 1 AS rnk FROM range({nodes}) AS a(i) CROSS JOIN range({n}) AS b(i)) g) u) p"""


ZIPF = {
    "Z1": zipf_sql(10, 1000, 1.0, 1.0, 10, 1),
    "Z2": zipf_sql(10, 10000, 0.8, 0.75, 100, 2),
    "Z3": zipf_sql(10, 10000, 2.0, 0.0, 0, 3),
    "Z4": zipf_sql(10, 10000, 0.4, 0.25, 100, 1),
}
SQL = TABLES | ZIPF


def simple_zipf_sql(n: int, zipf: float, lists: int = 1) -> str:
    """One normalised Zipf curve, scaled so that the smallest score is 1; the same for each of `lists` nodes."""
    return f"""SELECT b.i AS node_id, r AS item_id, CAST(greatest(1, floor(p / least_p + 1e-9)) AS BIGINT) AS score
FROM (SELECT r, p, min(p) OVER () AS least_p FROM (SELECT i + 1 AS r, power(CAST(i + 1 AS DOUBLE), -{zipf}) AS p FROM range({n}) AS t(i)) a) c CROSS JOIN range({lists}) AS b(i)"""


def disjoint_zipf_sql(n: int, zipf: float, lists: int) -> str:
    """The same curve at every node, over items that no two nodes share."""
    return f"SELECT node_id, node_id * 100000000 + item_id AS item_id, score FROM ({simple_zipf_sql(n, zipf, lists)}) s"


def offset_zipf_sql(n: int, zipf: float, lists: int, overlap: float) -> str:
    """n - 1 items a node on a curve normalised to 10^7 plus the node's number; floor(overlap * n) + 1 ranks share their
    item over the nodes."""
    return f"""SELECT b.i AS node_id, CASE WHEN r <= {int(overlap * n) + 1} THEN r ELSE 100000000 * (b.i + 1) + r END AS item_id, CAST(floor(p / whole * 10000000 + b.i + 1e-9) AS BIGINT) AS score
FROM (SELECT r, p, sum(p) OVER () AS whole FROM (SELECT i + 1 AS r, power(CAST(i + 1 AS DOUBLE), -{zipf}) AS p FROM range({n - 1}) AS t(i)) a) c CROSS JOIN range({lists}) AS b(i)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named source; only the columns that its text uses are read."""
    for table in ("lineitem", "events"):
        if f"FROM {table}" in SQL[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(SQL[name])
