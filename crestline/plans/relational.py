"""Single steps of the protocols as SQL that Spark and other engines read alike, over the list of L1 (k = 10).

Each text starts from the lists `x`; Catalyst plans the joins, and the same text is the oracle of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import cell_sql
from ..sources.lists import SQL, disjoint_zipf_sql, offset_zipf_sql, simple_zipf_sql

K = 10
N = 10
C = cell_sql("item_id", 1024)
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, item_id DESC) AS rnk FROM x)"
FIRST = f"{RANKED}, first AS (SELECT node_id, item_id, score FROM r WHERE rnk <= {K}), ps AS (SELECT item_id, CAST(sum(score) AS BIGINT) AS score, count(*) AS answers FROM first GROUP BY item_id), tau AS (SELECT min(score) AS t FROM (SELECT score FROM ps ORDER BY score DESC LIMIT {K}) b)"
TRUTH = f"truth AS (SELECT item_id, CAST(sum(score) AS BIGINT) AS score FROM x GROUP BY item_id), best AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id DESC) AS rnk FROM truth ORDER BY score DESC, item_id DESC LIMIT {K})"
GUESS = f"{RANKED}, guess AS (SELECT item_id, CAST(sum(score) AS BIGINT) AS score FROM r WHERE rnk <= {2 * K} GROUP BY item_id), appr AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id DESC) AS rnk FROM guess ORDER BY score DESC, item_id DESC LIMIT {K})"
CELLS = f"cells AS (SELECT cell, CAST(sum(v) AS BIGINT) AS v, count(*) AS answers FROM (SELECT node_id, {C} AS cell, max(score) AS v FROM x GROUP BY node_id, {C}) c GROUP BY cell)"
SPAN = "s AS (SELECT node_id, item_id, score, max(score) OVER (PARTITION BY node_id) AS top, min(score) OVER (PARTITION BY node_id) AS bottom FROM x)"
HIST = f"{SPAN}, h AS (SELECT node_id, CAST(floor((top - score) / greatest(1, ceil((top - bottom + 1) / 10))) AS BIGINT) AS entry, count(*) AS freq, max(score) AS high, min(score) AS low, CAST(sum(score) AS BIGINT) AS mass FROM s GROUP BY node_id, CAST(floor((top - score) / greatest(1, ceil((top - bottom + 1) / 10))) AS BIGINT))"

BOUNDS = f"{RANKED}, cu AS (SELECT node_id, max(score) AS cutoff FROM r WHERE rnk > {K} GROUP BY node_id), tot AS (SELECT sum(cutoff) AS total FROM cu), ou AS (SELECT cell, CAST(sum(hi - coalesce(cutoff, 0)) + max(coalesce(total, 0)) AS BIGINT) AS over_bound, CAST(sum(lo) AS BIGINT) AS under_bound FROM (SELECT node_id, {C} AS cell, max(score) AS hi, min(score) AS lo FROM r WHERE rnk <= {K} GROUP BY node_id, {C}) c LEFT JOIN cu ON cu.node_id = c.node_id CROSS JOIN tot GROUP BY cell)"

SIZES = "z AS (SELECT node_id, count(*) AS n, (SELECT count(*) FROM x) AS total FROM x GROUP BY node_id)"
GCS = f"2 * {N} * 0.8 * 1.44 / (800 * ({N} * n / total::DOUBLE) * ln(2) * (floor(total / floor(n / 10)) - 1))"

STEPS = {
    # filters and limits
    "f1_threshold_scan": f"{FIRST} SELECT node_id, item_id, score FROM x, tau WHERE score >= t / 20.0",
    "f2_whole_threshold": f"{FIRST} SELECT node_id, item_id, score FROM x, tau WHERE floor(score) >= ceil(t / {N}.0)",
    "f3_prefix_one_below": f"{FIRST}, e AS (SELECT node_id, min(rnk) AS stop FROM r, tau WHERE score < ceil(t / {N}.0) GROUP BY node_id) SELECT r.node_id, item_id, score FROM r LEFT JOIN e ON r.node_id = e.node_id WHERE rnk <= coalesce(stop, rnk)",
    "f4_rank_cut": f"{RANKED} SELECT node_id, item_id, score, CAST(rnk AS BIGINT) AS place FROM r WHERE rnk <= {K}",
    "f5_least_share": f"{FIRST} SELECT CAST(ceil(t / {N}.0) AS BIGINT) AS share FROM tau",
    "f6_count_from_score": f"{FIRST} SELECT node_id, count(*) AS n FROM x, tau WHERE score >= ceil(t / {N}.0) GROUP BY node_id",
    "f7_upper_bound_prune": f"{FIRST} SELECT item_id, score, answers FROM ps, tau WHERE 2 * {N} * score + ({N} - answers) * t >= 2 * {N} * t",
    "f8_cell_bound_prune": f"{CELLS}, {FIRST} SELECT cell, v, answers FROM cells, tau WHERE ({N} - answers) * floor(t / {N}.0) + v >= t",
    "f9_unsent": f"{RANKED} SELECT node_id, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM r WHERE rnk > {K} GROUP BY node_id",
    "f10_distinct_at_k": f"{TRUTH}, o AS (SELECT score, row_number() OVER (ORDER BY score DESC, item_id DESC) AS p FROM truth) SELECT max(CASE WHEN p = {K} THEN score END) AS kth, max(CASE WHEN p = {K + 1} THEN score END) AS after, max(CASE WHEN p = {K} THEN score END) > max(CASE WHEN p = {K + 1} THEN score END) AS clear FROM o WHERE p <= {K + 1}",
    # joins
    "j1_candidate_fetch": f"{FIRST} SELECT x.node_id, x.item_id, x.score FROM x WHERE item_id IN (SELECT item_id FROM ps)",
    "j2_truth_probe": f"{RANKED}, {TRUTH} SELECT node_id, item_id, score FROM r WHERE item_id IN (SELECT item_id FROM best) AND rnk > {K}",
    "j3_estimate_probe": f"{FIRST}, e AS (SELECT item_id FROM ps ORDER BY score DESC, item_id DESC LIMIT {K}) SELECT node_id, item_id, score FROM x WHERE item_id IN (SELECT item_id FROM e)",
    "j4_bloom_probe": f"{FIRST}, b0 AS (SELECT DISTINCT {C} AS cell FROM ps), b1 AS (SELECT DISTINCT {cell_sql('item_id', 1024, 1)} AS cell FROM ps) SELECT node_id, item_id, score FROM x WHERE {C} IN (SELECT cell FROM b0) AND {cell_sql('item_id', 1024, 1)} IN (SELECT cell FROM b1)",
    "j5_bucket_probe": f"{FIRST}, b AS (SELECT DISTINCT {C} % 64 AS cell FROM ps) SELECT node_id, count(DISTINCT {C} % 64) AS buckets, count(*) AS tested FROM x WHERE {C} % 64 IN (SELECT cell FROM b) GROUP BY node_id",
    "j6_mask_probe": f"{CELLS}, {FIRST}, m AS (SELECT cell FROM cells, tau WHERE v > t) SELECT node_id, item_id, score FROM x WHERE {C} IN (SELECT cell FROM m)",
    "j7_merge_sum": "SELECT item_id, CAST(sum(score) AS BIGINT) AS score, count(*) AS answers FROM x GROUP BY item_id",
    "j8_missing_estimate": f"{HIST}, {FIRST}, e AS (SELECT s.node_id, {C} AS cell, min(h.entry) AS entry FROM s JOIN h ON h.node_id = s.node_id AND s.score BETWEEN h.low AND h.high GROUP BY s.node_id, {C}), g AS (SELECT e.node_id, cell, CAST(floor(mass / freq) AS BIGINT) AS guess FROM e JOIN h ON h.node_id = e.node_id AND h.entry = e.entry), p AS (SELECT ps.item_id, n.node_id, {C} AS cell FROM ps CROSS JOIN (SELECT DISTINCT node_id FROM x) n) SELECT p.item_id, CAST(sum(coalesce(guess, 0)) AS BIGINT) AS guess FROM p LEFT JOIN first f ON f.item_id = p.item_id AND f.node_id = p.node_id LEFT JOIN g ON g.node_id = p.node_id AND g.cell = p.cell WHERE f.item_id IS NULL GROUP BY p.item_id",
    "j9_score_range": f"{HIST}, {FIRST} SELECT f.node_id, f.item_id, f.score, min(h.entry) AS entry FROM first f JOIN h ON h.node_id = f.node_id AND f.score BETWEEN h.low AND h.high GROUP BY f.node_id, f.item_id, f.score",
    "j10_false_positives": f"{FIRST}, {TRUTH} SELECT count(*) AS wrong FROM ps WHERE item_id NOT IN (SELECT item_id FROM best)",
    "j11_matches": f"{TRUTH}, {GUESS} SELECT b.item_id, b.score AS exact, a.score AS found FROM best b JOIN appr a ON a.item_id = b.item_id",
    # aggregations
    "a1_sum_by_item": "SELECT item_id, CAST(sum(score) AS BIGINT) AS score FROM x GROUP BY item_id",
    "a2_answers": "SELECT item_id, count(*) AS answers FROM x GROUP BY item_id",
    "a3_count_by_node_item": "SELECT l_suppkey % 10 AS node_id, l_partkey AS item_id, count(*) AS score FROM lineitem GROUP BY l_suppkey % 10, l_partkey",
    "a4_distinct_items": "SELECT count(DISTINCT item_id) AS items FROM x",
    "a5_total_length": "SELECT count(*) AS rows FROM x",
    "a6_cell_max": f"SELECT node_id, {C} AS cell, max(score) AS v FROM x GROUP BY node_id, {C}",
    "a7_a8_cell_sum": f"{CELLS} SELECT cell, v, answers FROM cells",
    "a9_kth_cell": f"{CELLS} SELECT min(v) AS kth FROM (SELECT v FROM cells ORDER BY v DESC LIMIT {K}) t",
    "a10_least_entry": f"{HIST}, p AS (SELECT s.node_id, {C} AS cell, h.entry FROM s JOIN h ON h.node_id = s.node_id AND s.score BETWEEN h.low AND h.high) SELECT node_id, cell, min(entry) AS entry FROM p GROUP BY node_id, cell",
    "a11_cell_upper_bound": f"{HIST}, {FIRST}, p AS (SELECT s.node_id, {C} AS cell, max(h.high) AS ub FROM s JOIN h ON h.node_id = s.node_id AND s.score BETWEEN h.low AND h.high GROUP BY s.node_id, {C}), u AS (SELECT cell, CAST(sum(ub) AS BIGINT) AS ub FROM p GROUP BY cell), g AS (SELECT {C} AS cell, max(score) AS got FROM ps GROUP BY {C}) SELECT u.cell, ub, ub + coalesce(got, 0) > t AS passes FROM u LEFT JOIN g ON g.cell = u.cell CROSS JOIN tau",
    "a12_over_under": f"{BOUNDS} SELECT cell, over_bound, under_bound FROM ou",
    "a13_fold_cells": f"{CELLS} SELECT cell % 128 AS cell, max(v) AS v FROM cells GROUP BY cell % 128",
    "a14_kth_bounds": f"{BOUNDS}, f AS (SELECT cell % 128 AS cell, max(over_bound) AS o, max(under_bound) AS u FROM ou GROUP BY cell % 128) SELECT (SELECT u FROM f ORDER BY u DESC LIMIT 1 OFFSET {K - 1}) AS under_kth, (SELECT o FROM f ORDER BY o DESC LIMIT 1 OFFSET {K - 1}) AS over_kth",
    "a15_cells_between": f"{CELLS}, {FIRST}, b AS (SELECT max(t) AS t, count(*) FILTER (WHERE v >= t AND v < 2 * t) AS between_count, min(CASE WHEN v >= t THEN v END) AS lo FROM cells, tau) SELECT between_count, CAST(CASE WHEN lo > 0 AND lo < 2 * t THEN 2 * t - (lo + 1) ELSE 0 END AS BIGINT) AS next_cutoff FROM b",
    "a16_histogram": f"{HIST} SELECT node_id, entry, freq, high, low, CAST(floor(mass / freq) AS BIGINT) AS mean, CAST(sum(mass) OVER (PARTITION BY node_id ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM h",
    "a17_tail_average": f"{HIST} SELECT node_id, CAST(floor(sum(mass) / sum(freq)) AS BIGINT) AS tail FROM h WHERE entry >= 3 GROUP BY node_id",
    "a18_round_stats": f"{RANKED}, t AS (SELECT CASE WHEN rnk <= {K} THEN 1 ELSE 2 END AS round, node_id, count(*) AS items FROM r GROUP BY CASE WHEN rnk <= {K} THEN 1 ELSE 2 END, node_id) SELECT round, CAST(sum(items) AS BIGINT) AS total, max(items) AS largest FROM t GROUP BY round",
    "a19_array_stats": f"{CELLS} SELECT min(v) AS least, max(v) AS most, min(CASE WHEN v > 0 THEN v END) AS least_used, count(*) FILTER (WHERE v > 0) AS used FROM cells",
    # windows, sorts, set operations
    "w1_reverse_index": "SELECT node_id, item_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY score DESC, item_id DESC) - 1 AS BIGINT) AS place FROM x",
    "w2_running_mass": "SELECT node_id, item_id, CAST(sum(score) OVER (PARTITION BY node_id ORDER BY score DESC, item_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS mass FROM x",
    "t2_global_top": f"{TRUTH} SELECT item_id, score FROM best",
    "t4_kth_or_zero": f"{FIRST} SELECT CASE WHEN count(*) < {K} THEN 0 ELSE min(score) END AS kth FROM (SELECT score FROM ps ORDER BY score DESC LIMIT {K}) t",
    "t5_more_than": f"{CELLS}, {FIRST} SELECT count(*) AS n FROM cells, tau WHERE v > t",
    "t6_entry_order": f"{HIST} SELECT node_id, entry, CAST(row_number() OVER (ORDER BY freq DESC, node_id, entry) AS BIGINT) AS place FROM h",
    "o1_union_all": "SELECT node_id, item_id, score FROM x WHERE node_id < 5 UNION ALL SELECT node_id, item_id, score FROM x WHERE node_id >= 5",
    "o4_bit_or": f"SELECT cell, bit_or(b) AS bits FROM (SELECT CAST(floor({C} / 32.0) AS BIGINT) AS cell, CAST(power(2, {C} % 32) AS BIGINT) AS b FROM x) t GROUP BY cell",
    "o6_intersection": f"{TRUTH}, {GUESS} SELECT item_id FROM best INTERSECT SELECT item_id FROM appr",
    # scalar functions and sketches
    "x2_hash": f"SELECT DISTINCT item_id, {C} AS cell FROM x",
    "x3_power_of_two": "SELECT node_id, CAST(floor(log2(count(*)) + 0.5) AS BIGINT) AS bits, CAST(power(2, floor(log2(count(*)) + 0.5)) AS BIGINT) AS size FROM x GROUP BY node_id",
    "x5_bloom_size": f"{SIZES}, e AS (SELECT node_id, n, ceil(1.44 * log2(800 * ln(2) * (floor(total / n) - 1) / ({N + 1} * 1.44))) AS bits FROM z) SELECT node_id, CAST(bits * n AS BIGINT) AS m, CAST(ceil(bits * ln(2)) AS BIGINT) AS hashes FROM e",
    "x7_gcs_modulus": f"{SIZES} SELECT node_id, CAST(floor(floor(n / 10) / ({GCS})) AS BIGINT) AS m, 0::BIGINT AS none FROM z",
    "x9_rice_parameter": f"SELECT node_id, CAST(greatest(0, floor(log2((128.0 * sum(d) + 49 * count(*)) / (128.0 * count(*)))) + 1) AS BIGINT) AS k FROM (SELECT node_id, cell - coalesce(lag(cell) OVER (PARTITION BY node_id ORDER BY cell), 0) AS d FROM (SELECT DISTINCT node_id, {C} AS cell FROM x) c) t GROUP BY node_id",
    "i7_count_min_query": f"{CELLS}, c1 AS (SELECT cell, CAST(sum(v) AS BIGINT) AS v FROM (SELECT node_id, {cell_sql('item_id', 1024, 1)} AS cell, max(score) AS v FROM x GROUP BY node_id, {cell_sql('item_id', 1024, 1)}) c GROUP BY cell), i AS (SELECT DISTINCT item_id, {C} AS p0, {cell_sql('item_id', 1024, 1)} AS p1 FROM x) SELECT item_id, least(cells.v, c1.v) AS estimate FROM i JOIN cells ON cells.cell = p0 JOIN c1 ON c1.cell = p1",
    "i16_golomb_bits": f"SELECT d.node_id, CAST(sum(floor(d / power(2, k)) + 1 + k) AS BIGINT) AS bits FROM (SELECT node_id, cell - coalesce(lag(cell) OVER (PARTITION BY node_id ORDER BY cell), 0) AS d FROM (SELECT DISTINCT node_id, {C} AS cell FROM x) c) d JOIN (SELECT node_id, CAST(greatest(0, floor(log2((128.0 * sum(d) + 49 * count(*)) / (128.0 * count(*)))) + 1) AS BIGINT) AS k FROM (SELECT node_id, cell - coalesce(lag(cell) OVER (PARTITION BY node_id ORDER BY cell), 0) AS d FROM (SELECT DISTINCT node_id, {C} AS cell FROM x) c) t GROUP BY node_id) p ON p.node_id = d.node_id GROUP BY d.node_id",
    # quality metrics of the approximate answer (the best 2k rows of each node)
    "m1_recall": f"{TRUTH}, {GUESS} SELECT CAST(count(*) AS DOUBLE) / {K} AS recall FROM best b JOIN appr a ON a.item_id = b.item_id",
    "m2_k_error": f"{TRUTH}, {GUESS} SELECT CAST(b.score - a.score AS DOUBLE) / b.score AS k_err FROM best b JOIN appr a ON a.rnk = b.rnk WHERE b.rnk = {K}",
    "m3_abs_error": f"{TRUTH}, {GUESS} SELECT CAST(coalesce(sum(abs(b.score - a.score)), 0) AS DOUBLE) / {K} AS abs_err FROM best b JOIN appr a ON a.item_id = b.item_id",
    "m4_rel_error": f"{TRUTH}, {GUESS} SELECT round(coalesce(sum(CAST(abs(b.score - a.score) AS DOUBLE) / b.score), 0) / {K}, 9) AS rel_err FROM best b JOIN appr a ON a.item_id = b.item_id",
    "m9_filter_false_positives": f"{FIRST}, b AS (SELECT DISTINCT {C} AS cell FROM ps) SELECT count(*) AS wrong FROM x WHERE {C} IN (SELECT cell FROM b) AND item_id NOT IN (SELECT item_id FROM ps)",
    "k5_differences": f"{TRUTH}, {GUESS} SELECT CAST(b.rnk AS BIGINT) AS place, b.item_id AS exact_item, a.item_id AS found_item FROM best b JOIN appr a ON a.rnk = b.rnk WHERE a.item_id <> b.item_id OR a.score <> b.score",
}

# Steps over each node's own list (set operations: each node's cells against the next node's).
NEXT = f"(node_id + {N - 1}) % {N}"
STEPS |= {
    "x4_bloom_eps": f"{SIZES} SELECT node_id, round({N + 1} * 1.44 / (800 * ln(2) * (floor(total / n) - 1)), 12) AS eps FROM z",
    "x6_gcs_eps": f"{SIZES} SELECT node_id, round({GCS}, 12) AS eps FROM z",
    "x8_count_min_size": f"{SIZES}, e AS (SELECT node_id, n, 2 * 1.44 * 0.7 / ln(2) * n * n / (total * 800.0 * {K}) AS eps FROM z) SELECT node_id, round(eps, 9) AS eps, CAST(power(2, floor(log2(greatest(1, ceil(n / eps))) + 0.5)) AS BIGINT) AS columns FROM e",
    "w4_last_match": f"{FIRST} SELECT n.node_id, coalesce(max(rnk), 0) - 1 AS place FROM (SELECT DISTINCT node_id FROM x) n LEFT JOIN r ON r.node_id = n.node_id AND r.item_id IN (SELECT item_id FROM ps) GROUP BY n.node_id",
    "m5_distance": f"{TRUTH}, {GUESS}, n AS (SELECT b.rnk AS i, a.rnk AS j, lag(a.rnk) OVER (ORDER BY b.rnk) AS before FROM best b JOIN appr a ON a.item_id = b.item_id AND abs(a.rnk - b.rnk) <= {K // 2}) SELECT CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE round((2 * count(*) / {K}.0::DOUBLE + (count(*) - count(*) FILTER (WHERE j < before)) / count(*)::DOUBLE) / 3, 9) END AS distance FROM n",
    "s18_unique": "SELECT node_id, item_id, CAST(2 * score AS BIGINT) AS score FROM x",
    "t1_total_order": "SELECT node_id, item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id DESC, node_id DESC) AS BIGINT) AS place FROM x",
    "w3_differences": f"SELECT node_id, cell, CAST(cell - coalesce(lag(cell) OVER (PARTITION BY node_id ORDER BY cell), 0) AS BIGINT) AS delta FROM (SELECT DISTINCT node_id, {C} AS cell FROM x) t",
    "x10_log_scale": "SELECT node_id, item_id, score, CAST(ceil(ln(score) * 16) + 1 AS BIGINT) AS scaled FROM x",
    "x11_bounds": "SELECT node_id, item_id, greatest(score, 5000000) AS least_five, least(score, 5000000) AS most_five FROM x",
    "o2_cell_union": f"SELECT node_id, {C} AS cell FROM x UNION SELECT {NEXT} AS node_id, {C} AS cell FROM x",
    "o3_cell_difference": f"SELECT node_id, {C} AS cell FROM x EXCEPT SELECT {NEXT} AS node_id, {C} AS cell FROM x",
    "o5_cells_by_modulus": f"SELECT DISTINCT node_id, bits, hv FROM (SELECT node_id, 6 AS bits, {C} % 64 AS hv FROM x UNION ALL SELECT node_id, 10 AS bits, {C} AS hv FROM x) t",
}


def text(name: str, source: str = "L1") -> str:
    """The whole SQL of a step: a CTE for the lists, then the step's own."""
    step = STEPS[name]
    joint = " " if step.startswith("SELECT") else ", "
    return f"WITH x AS ({SQL[source]}){joint}{step}"


SOURCES = {
    "s15_simple_zipf": simple_zipf_sql(1000, 1.0),
    "s16_same_lists": simple_zipf_sql(500, 0.8, 5),
    "s16_disjoint_lists": disjoint_zipf_sql(500, 0.8, 5),
    "s13_s14_offset_lists": offset_zipf_sql(500, 0.7, 5, 0.2),
    **{f"s17_{name.lower()}_lists": f"SELECT node_id, item_id, score FROM ({SQL[name]}) t" for name in ("Z1", "Z2", "Z3", "Z4")},
    **{f"source_{name.lower()}": SQL[name] for name in ("L1", "L2", "L3", "E1", "E2", "E3")},
}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for table in ("lineitem", "events"):
        if f"FROM {table}" in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)
