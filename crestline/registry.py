"""All registered queries of the top-k engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.hashing import cell_sql
from .model import result_order, top
from .operators import steps
from .operators.protocols import PROTOCOLS
from .operators.report import export, overview
from .plans import relational
from .sources.lists import SQL, load

K = 10
QUALITY = ("p1_naive", "p2_naive_2k", "p10_extra_round", "p15_approximate_gcs", "p19_approximate_bloom")


def protocol(name: str, source: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return PROTOCOLS[name][1](load(spark, sf_dir, source).persist(), K).frame


def step(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.STEPS[name](load(spark, sf_dir, "L1").persist())


def rounds_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protocol, round and what was sent in it, for the protocols whose rounds an oracle states."""
    lists = load(spark, sf_dir, "L1").persist()
    out = None
    for name in ("p1_naive", "p2_naive_2k", "p3_magic", "p4_tput"):
        own = PROTOCOLS[name][1](lists, K).report().withColumn("protocol", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protocol, recall, abs_err, rel_err and k_err of the answers of exact and approximate protocols against the truth."""
    lists = load(spark, sf_dir, "L1").persist()
    order = Window.orderBy(*result_order())
    truth = top(lists, K).withColumn("place", F.row_number().over(order)).persist()
    out = None
    for name in QUALITY:
        found = PROTOCOLS[name][1](lists, K).frame.withColumn("place", F.row_number().over(order))
        both = truth.join(found.select("item_id", F.col("score").alias("own")), "item_id", "left").join(found.select("place", F.col("score").alias("at")), "place", "left")
        gap = F.abs(F.col("score") - F.col("own"))
        last = F.max(F.when(F.col("place") == K, (F.col("score") - F.col("at")).cast("double") / F.col("score")))
        own = both.agg((F.count("own") / K).alias("recall"), (F.coalesce(F.sum(gap), F.lit(0)).cast("double") / K).alias("abs_err"), F.round(F.coalesce(F.sum(gap.cast("double") / F.col("score")), F.lit(0.0)) / K, 9).alias("rel_err"), F.round(last, 9).alias("k_err")).withColumn("protocol", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


COSTED = ["p1_naive", "p2_naive_2k", "p3_magic", "p4_tput"]


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(load(spark, sf_dir, "L1").persist(), COSTED, K, source="L1")


def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(export_rows(spark, sf_dir))


def export_sql() -> str:
    """The same figures from the rounds by their definitions: 2k rows a node are the one answer that is not exact."""
    body = rounds_sql().rsplit("\nSELECT protocol, round", 1)[0]
    n, tput, looked = 10, "protocol = 'p4_tput'", "(protocol = 'p3_magic' AND round = 2 OR protocol = 'p4_tput' AND round = 3)"
    each = []
    for i in range(1, 5):
        at = f"FILTER (WHERE round = {i})"
        each += [f"coalesce(max(sketch) {at}, 0)::BIGINT AS r{i}_sketch_bytes", f"coalesce(sum(items) {at}, 0)::BIGINT AS r{i}_transferred_items_sum"]
        for kind, test in (("serial_items", f"NOT {looked}"), ("random_items", looked), ("random_access", looked)):
            each += [f"coalesce({f}(items) FILTER (WHERE round = {i} AND {test}), 0)::BIGINT AS r{i}_{kind}_{f}" for f in ("sum", "max")]
    names = ", ".join(f"('{name}', {name != 'p2_naive_2k'}, {rounds})" for name, rounds in zip(COSTED, (1, 1, 2, 3)))
    return f"""{body}, ids AS (SELECT count(*) AS ids FROM c), z AS (SELECT s.*, CASE WHEN {tput} AND round = 2 THEN {4 * n} WHEN {tput} AND round = 3 THEN {4 * n} * ids ELSE 0 END AS sketch FROM s CROSS JOIN ids),
d AS (SELECT protocol, sum(items) AS items, {", ".join(each)} FROM z GROUP BY protocol),
g AS (SELECT distance FROM ({relational.text("m5_distance")}) a), q AS (SELECT * FROM ({quality_sql()}) a WHERE protocol = 'p2_naive_2k'),
b AS (SELECT min(score) AS score_k FROM ({exact_sql("L1")}) a), names(protocol, exact, rounds) AS (VALUES {names})
SELECT names.protocol, 'L1' AS source, exact, CAST(rounds AS BIGINT) AS rounds, CAST(100 * items + r1_sketch_bytes + r2_sketch_bytes + r3_sketch_bytes + r4_sketch_bytes AS BIGINT) AS bytes,
CASE WHEN exact THEN 0.0 ELSE rel_err END::DOUBLE AS rel_err, CASE WHEN exact THEN 1.0 ELSE recall END::DOUBLE AS recall, CASE WHEN exact THEN 1.0 ELSE distance END::DOUBLE AS distance, CAST(score_k AS BIGINT) AS score_k, CASE WHEN exact THEN 0.0 ELSE k_err END::DOUBLE AS k_err, d.* EXCLUDE (protocol, items)
FROM names JOIN d ON d.protocol = names.protocol CROSS JOIN g CROSS JOIN q CROSS JOIN b"""


def best_sql() -> str:
    return f"SELECT exact, count(*) AS protocols, min_by(protocol, (bytes, protocol)) AS cheapest, min_by(protocol, (rel_err, bytes, protocol)) AS closest FROM ({export_sql()}) e GROUP BY exact"


def rounds_sql() -> str:
    """The rounds by their definitions: the local best, the winners' other rows, and the three phases of the uniform threshold."""
    n = 10
    return f"""WITH x AS ({SQL["L1"]}), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, item_id DESC) AS rnk FROM x),
w AS (SELECT item_id FROM (SELECT item_id, sum(score) AS s FROM x GROUP BY item_id ORDER BY s DESC, item_id DESC LIMIT {K}) a),
t1 AS (SELECT min(s) AS t FROM (SELECT sum(score) AS s FROM r WHERE rnk <= {K} GROUP BY item_id ORDER BY s DESC LIMIT {K}) a),
p AS (SELECT item_id, sum(score) AS s, count(*) AS a FROM r, t1 WHERE rnk <= {K} OR 2 * {n} * score >= t GROUP BY item_id),
t2 AS (SELECT min(s) AS u FROM (SELECT s FROM p ORDER BY s DESC LIMIT {K}) a),
c AS (SELECT item_id FROM p, t1, t2 WHERE 2 * {n} * s + ({n} - a) * t >= 2 * {n} * u),
e AS (SELECT 'p1_naive' AS protocol, 1 AS round, node_id FROM r
UNION ALL SELECT 'p2_naive_2k', 1, node_id FROM r WHERE rnk <= {2 * K}
UNION ALL SELECT 'p3_magic', CASE WHEN rnk <= {K} THEN 1 ELSE 2 END, node_id FROM r WHERE rnk <= {K} OR item_id IN (SELECT item_id FROM w)
UNION ALL SELECT 'p4_tput', CASE WHEN rnk <= {K} THEN 1 WHEN 2 * {n} * score >= t THEN 2 ELSE 3 END, node_id FROM r, t1 WHERE rnk <= {K} OR 2 * {n} * score >= t OR item_id IN (SELECT item_id FROM c)),
s AS (SELECT protocol, round, node_id, count(*) AS items FROM e GROUP BY protocol, round, node_id)
SELECT protocol, round, CAST(sum(items) AS BIGINT) AS items, max(items) AS largest, CAST(100 * sum(items) AS BIGINT) AS bytes, 100 * max(items) AS largest_bytes FROM s GROUP BY protocol, round"""


def quality_sql() -> str:
    texts = {"p1_naive": exact_sql("L1"), "p2_naive_2k": naive_2k_sql("L1"), "p10_extra_round": exact_sql("L1"), "p15_approximate_gcs": filter_sql("L1", 1 << 12, 1), "p19_approximate_bloom": filter_sql("L1", 1 << 10, 3)}
    each = "\nUNION ALL ".join(f"SELECT '{name}' AS protocol, * FROM ({sql}) a{i}" for i, (name, sql) in enumerate(texts.items()) if name in QUALITY)
    return f"""WITH truth AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id DESC) AS place FROM ({exact_sql("L1")}) t),
f AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY score DESC, item_id DESC) AS place FROM ({each}) q)
SELECT p.protocol, count(o.score) / {K}.0::DOUBLE AS recall, coalesce(sum(abs(t.score - o.score)), 0)::DOUBLE / {K} AS abs_err, round(coalesce(sum(abs(t.score - o.score)::DOUBLE / t.score), 0) / {K}, 9) AS rel_err,
round(max(CASE WHEN t.place = {K} THEN (t.score - b.score)::DOUBLE / t.score END), 9) AS k_err
FROM truth t CROSS JOIN (SELECT DISTINCT protocol FROM f) p LEFT JOIN f o ON o.protocol = p.protocol AND o.item_id = t.item_id LEFT JOIN f b ON b.protocol = p.protocol AND b.place = t.place GROUP BY p.protocol"""


def exact_sql(source: str) -> str:
    return f"SELECT item_id, CAST(sum(score) AS BIGINT) AS score FROM ({SQL[source]}) x GROUP BY item_id ORDER BY score DESC, item_id DESC LIMIT {K}"


def filter_sql(source: str, m: int, hashes: int) -> str:
    """The approximate filters: the best items of the first round, and every row whose cells they set."""
    cells = ", ".join(f"b{i} AS (SELECT DISTINCT {cell_sql('item_id', m, i)} AS cell FROM e)" for i in range(hashes))
    test = " AND ".join(f"{cell_sql('item_id', m, i)} IN (SELECT cell FROM b{i})" for i in range(hashes))
    return f"""WITH x AS ({SQL[source]}), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, item_id DESC) AS rnk FROM x),
e AS (SELECT item_id, sum(score) AS s FROM r WHERE rnk <= {K} GROUP BY item_id ORDER BY s DESC, item_id DESC LIMIT {K}), {cells}
SELECT item_id, CAST(sum(score) AS BIGINT) AS score FROM r WHERE rnk <= {K} OR ({test}) GROUP BY item_id ORDER BY score DESC, item_id DESC LIMIT {K}"""


def naive_2k_sql(source: str) -> str:
    return f"SELECT item_id, CAST(sum(score) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, item_id DESC) AS rnk FROM ({SQL[source]}) x) r WHERE rnk <= {2 * K} GROUP BY item_id ORDER BY score DESC, item_id DESC LIMIT {K}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {name: partial(protocol, name, "L1") for name in PROTOCOLS}
    out |= {f"{name}_zipf": partial(protocol, name, "Z2") for name in ("p1_naive", "p4_tput", "p6_tput_tight", "p9_sketch_two_rounds", "p10_extra_round")}
    out |= {name: partial(relational.run, sql=relational.text(name)) for name in relational.STEPS if name not in steps.STEPS}
    out |= {name: partial(step, name) for name in steps.STEPS}
    out |= {"k1_rounds_report": rounds_report, "m1_m4_answer_quality": answer_quality, "k1_export": export_rows, "k4_overview": best_rows}
    out |= {name: partial(relational.run, sql=sql) for name, sql in relational.SOURCES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: exact_sql("L1") for name, (exact, _) in PROTOCOLS.items() if exact}
    out |= {name: exact_sql("Z2") for name in queries() if name.endswith("_zipf") and name.startswith("p")}
    out |= {"p2_naive_2k": naive_2k_sql("L1"), "p15_approximate_gcs": filter_sql("L1", 1 << 12, 1), "p19_approximate_bloom": filter_sql("L1", 1 << 10, 3)}
    out |= {"k1_rounds_report": rounds_sql(), "m1_m4_answer_quality": quality_sql(), "k1_export": export_sql(), "k4_overview": best_sql()}
    out |= {name: relational.text(name) for name in relational.STEPS}
    return out | relational.SOURCES
