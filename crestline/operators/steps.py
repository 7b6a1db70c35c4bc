"""Single steps of the protocols as DataFrame functions over lists (node_id, item_id, score).

STEPS maps a query name to a function of the lists; the SQL of the same name in plans/relational.py is its oracle and
shares no text with it. Numbers that reach the driver are thresholds and figures of one row a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sizing
from ..functions.hashing import cell
from ..model import kth, local_top, placed, ranked, result_order, top, totals, unique, unsent
from .sketches import bloom_cells, bloom_pass, count_min_cells, count_min_query, fold_cells

K = 10
N = 10
M = 1024

def item_cell() -> Column:
    return cell("item_id", M)


def next_node() -> Column:
    return ((F.col("node_id") + N - 1) % N).alias("node_id")


def first(x: DataFrame) -> DataFrame:
    return local_top(x, K).select("node_id", "item_id", "score")


def partial(x: DataFrame) -> DataFrame:
    return totals(first(x))


def tau(x: DataFrame) -> int:
    return kth(partial(x), K)


def node_cells(x: DataFrame) -> DataFrame:
    return x.groupBy("node_id", item_cell().alias("cell")).agg(F.max("score").alias("v"))


def cells(x: DataFrame) -> DataFrame:
    return node_cells(x).groupBy("cell").agg(F.sum("v").cast("bigint").alias("v"), F.count("*").alias("answers"))


def whole(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def entries(x: DataFrame) -> DataFrame:
    """Rows with the entry of ten equal score ranges a node, from the top."""
    span = x.groupBy("node_id").agg(F.max("score").alias("top"), F.min("score").alias("bottom"))
    width = F.greatest(F.lit(1), F.ceil((F.col("top") - F.col("bottom") + 1) / 10))
    return x.join(F.broadcast(span), "node_id").withColumn("entry", whole((F.col("top") - F.col("score")) / width)).drop("top", "bottom")


def histogram(x: DataFrame) -> DataFrame:
    return entries(x).groupBy("node_id", "entry").agg(F.count("*").alias("freq"), F.max("score").alias("high"), F.min("score").alias("low"), F.sum("score").cast("bigint").alias("mass"))


def guess(x: DataFrame) -> DataFrame:
    """An approximate answer: the best of each node's first 2k rows."""
    return top(local_top(x, 2 * K), K)


def numbered(best: DataFrame) -> DataFrame:
    """The k rows of an answer with their places."""
    return best.withColumn("place", F.row_number().over(Window.orderBy(*result_order())).cast("bigint"))


def pairs(x: DataFrame) -> DataFrame:
    return top(x, K).join(guess(x).select("item_id", F.col("score").alias("found")), "item_id")


def prefix(x: DataFrame) -> DataFrame:
    """Rows down to the first one below the node's share of the threshold, which goes too."""
    share = -(-tau(x) // N)
    stop = x.where(F.col("score") < share).groupBy("node_id").agg(F.max(F.struct("score", "item_id")).alias("s")).select("node_id", "s.item_id", "s.score")
    return x.where(F.col("score") >= share).select("node_id", "item_id", "score").unionByName(stop)


def at_k(x: DataFrame) -> DataFrame:
    best = top(x, K + 1).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    a, b = F.get("s", F.lit(K - 1)), F.get("s", F.lit(K))
    return best.select(a.alias("kth"), b.alias("after"), (a > b).alias("clear"))


def missing(x: DataFrame) -> DataFrame:
    """For each sent item, the guesses of the nodes that did not send it: the mean of the best entry that holds its cell."""
    ps, sent = partial(x).select("item_id"), first(x).select("node_id", "item_id")
    best = entries(x).groupBy("node_id", item_cell().alias("cell")).agg(F.min("entry").alias("entry"))
    means = best.join(histogram(x).select("node_id", "entry", whole(F.col("mass") / F.col("freq")).alias("guess")), ["node_id", "entry"])
    asked = ps.crossJoin(F.broadcast(x.select("node_id").distinct())).join(sent, ["node_id", "item_id"], "left_anti").withColumn("cell", item_cell())
    return asked.join(means, ["node_id", "cell"], "left").groupBy("item_id").agg(F.sum(F.coalesce("guess", F.lit(0))).cast("bigint").alias("guess"))


def upper(x: DataFrame) -> DataFrame:
    t = tau(x)
    high = histogram(x).select("node_id", "entry", "high")
    own = entries(x).select("node_id", "entry", item_cell().alias("cell")).distinct().join(F.broadcast(high), ["node_id", "entry"]).groupBy("node_id", "cell").agg(F.max("high").alias("ub"))
    got = partial(x).groupBy(item_cell().alias("cell")).agg(F.max("score").alias("got"))
    return own.groupBy("cell").agg(F.sum("ub").cast("bigint").alias("ub")).join(got, "cell", "left").select("cell", "ub", (F.col("ub") + F.coalesce("got", F.lit(0)) > t).alias("passes"))


def over_under(x: DataFrame) -> DataFrame:
    """Cells of the first k rows: a node without the cell may still hold up to its best row outside."""
    sent = first(x)
    cutoffs = unsent(x, sent).groupBy("node_id").agg(F.max("score").alias("cutoff"))
    total = cutoffs.agg(F.sum("cutoff")).first()[0] or 0
    own = sent.groupBy("node_id", item_cell().alias("cell")).agg(F.max("score").alias("hi"), F.min("score").alias("lo")).join(F.broadcast(cutoffs), "node_id", "left")
    return own.groupBy("cell").agg((F.sum(F.col("hi") - F.coalesce("cutoff", F.lit(0))) + F.lit(total)).cast("bigint").alias("over_bound"), F.sum("lo").cast("bigint").alias("under_bound"))


def kth_bounds(x: DataFrame) -> DataFrame:
    both = over_under(x)
    over, under = (kth(fold_cells(both.select("cell", F.col(c).alias("v")), 128), K, "v") for c in ("over_bound", "under_bound"))
    return x.sparkSession.createDataFrame([(under, over)], "under_kth long, over_kth long")


def between(x: DataFrame) -> DataFrame:
    """Cells from the threshold up to twice it, and how far the cutoff may fall before the next cell passes."""
    t = tau(x)
    least = F.min(F.when(F.col("v") >= t, F.col("v")))
    ahead = F.when((least > 0) & (least < 2 * t), 2 * t - (least + 1)).otherwise(0)
    return cells(x).agg(F.count_if((F.col("v") >= t) & (F.col("v") < 2 * t)).alias("between_count"), ahead.cast("bigint").alias("next_cutoff"))


def running(x: DataFrame) -> DataFrame:
    mass = F.sum("mass").over(Window.partitionBy("node_id").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    return histogram(x).select("node_id", "entry", "freq", "high", "low", whole(F.col("mass") / F.col("freq")).alias("mean"), mass.alias("running"))


def rounds(x: DataFrame) -> DataFrame:
    from .protocols import Result

    return Result(x, [first(x), unsent(x, first(x))]).report().select("round", F.col("items").alias("total"), "largest")


def by_node(x: DataFrame, schema: str, figures) -> DataFrame:
    """One row a node from sizing functions: figures(node's rows, all rows) on counts that the driver holds."""
    counts = {r.node_id: r["count"] for r in x.groupBy("node_id").count().collect()}
    return x.sparkSession.createDataFrame([(node, *figures(n, sum(counts.values()))) for node, n in counts.items()], f"node_id long, {schema}")


def gaps(x: DataFrame) -> DataFrame:
    return x.select("node_id", item_cell().alias("cell")).distinct().select("node_id", "cell", (F.col("cell") - F.coalesce(F.lag("cell").over(Window.partitionBy("node_id").orderBy("cell")), F.lit(0))).alias("delta"))


def rice(x: DataFrame) -> DataFrame:
    rows = gaps(x).groupBy("node_id").agg(F.count("*").alias("n"), F.sum("delta").alias("total")).collect()
    return x.sparkSession.createDataFrame([(r.node_id, sizing.rice_parameter(r.n, r.total)) for r in rows], "node_id long, k long")


def golomb(x: DataFrame) -> DataFrame:
    k = F.col("k").cast("int")
    return gaps(x).join(F.broadcast(rice(x)), "node_id").groupBy("node_id").agg(F.sum(whole(F.col("delta") / F.pow(F.lit(2.0), k)) + 1 + k).cast("bigint").alias("bits"))


def distance(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row, distance: how alike two answers are, 1 if equal; a match counts within half the answer's length of its place."""
    width = max(1, k // 2)
    own = numbered(truth).select("item_id", F.col("place").alias("i"))
    other = numbered(found).select("item_id", F.col("place").alias("j"))
    near = own.join(other, "item_id").where(F.abs(F.col("i") - F.col("j")) <= width)
    moved = near.withColumn("back", F.col("j") < F.lag("j").over(Window.orderBy("i")))
    n, t = F.count("*"), F.count_if("back")
    return moved.agg(F.when(n == 0, 0.0).otherwise(F.round((n / k + n / k + (n - t) / n) / 3, 9)).alias("distance"))


def last_match(x: DataFrame) -> DataFrame:
    """Place of each node's last row that the others' first rows ask for, from 0; -1 where none matches."""
    asked = partial(x).select("item_id")
    hit = ranked(x).join(F.broadcast(asked), "item_id", "left_semi").groupBy("node_id").agg(F.max("rank").alias("r"))
    return x.select("node_id").distinct().join(hit, "node_id", "left").select("node_id", (F.coalesce("r", F.lit(0)) - 1).cast("bigint").alias("place"))


def errors(value: Column):
    return F.coalesce(F.sum(value), F.lit(0.0)) / K


STEPS = {
    "f1_threshold_scan": lambda x: x.where(F.col("score") * 2 * N >= tau(x)).select("node_id", "item_id", "score"),
    "f2_whole_threshold": lambda x: x.where(F.floor("score") >= -(-tau(x) // N)).select("node_id", "item_id", "score"),
    "f3_prefix_one_below": prefix,
    "f4_rank_cut": lambda x: ranked(x).where(F.col("rank") <= K).select("node_id", "item_id", "score", F.col("rank").cast("bigint").alias("place")),
    "f5_least_share": lambda x: x.sparkSession.createDataFrame([(-(-tau(x) // N),)], "share long"),
    "f6_count_from_score": lambda x: x.where(F.col("score") >= -(-tau(x) // N)).groupBy("node_id").agg(F.count("*").alias("n")),
    "f7_upper_bound_prune": lambda x: (lambda t: partial(x).where(2 * N * F.col("score") + (N - F.col("answers")) * t >= 2 * N * t))(tau(x)),
    "f8_cell_bound_prune": lambda x: (lambda t: cells(x).where((N - F.col("answers")) * (t // N) + F.col("v") >= t))(tau(x)),
    "f9_unsent": lambda x: unsent(x, first(x)).groupBy("node_id").agg(F.count("*").alias("n"), F.sum("score").cast("bigint").alias("score")),
    "f10_distinct_at_k": at_k,
    "j1_candidate_fetch": lambda x: x.join(partial(x).select("item_id"), "item_id", "left_semi").select("node_id", "item_id", "score"),
    "j2_truth_probe": lambda x: unsent(x.join(F.broadcast(top(x, K).select("item_id")), "item_id", "left_semi"), first(x)).select("node_id", "item_id", "score"),
    "j3_estimate_probe": lambda x: x.join(F.broadcast(top(first(x), K).select("item_id")), "item_id", "left_semi").select("node_id", "item_id", "score"),
    "j4_bloom_probe": lambda x: bloom_pass(x, bloom_cells(partial(x), M, 2), M, 2).select("node_id", "item_id", "score"),
    "j5_bucket_probe": lambda x: x.withColumn("cell", item_cell() % 64).join(partial(x).select((item_cell() % 64).alias("cell")).distinct(), "cell", "left_semi").groupBy("node_id").agg(F.countDistinct("cell").alias("buckets"), F.count("*").alias("tested")),
    "j6_mask_probe": lambda x: x.withColumn("cell", item_cell()).join(cells(x).where(F.col("v") > tau(x)).select("cell"), "cell", "left_semi").select("node_id", "item_id", "score"),
    "j7_merge_sum": totals,
    "j8_missing_estimate": missing,
    "j9_score_range": lambda x: entries(x).join(first(x), ["node_id", "item_id", "score"], "left_semi").select("node_id", "item_id", "score", "entry"),
    "j10_false_positives": lambda x: partial(x).join(top(x, K), "item_id", "left_anti").agg(F.count("*").alias("wrong")),
    "j11_matches": lambda x: pairs(x).select("item_id", F.col("score").alias("exact"), "found"),
    "a1_sum_by_item": lambda x: totals(x).drop("answers"),
    "a2_answers": lambda x: totals(x).drop("score"),
    "a4_distinct_items": lambda x: x.agg(F.countDistinct("item_id").alias("items")),
    "a5_total_length": lambda x: x.agg(F.count("*").alias("rows")),
    "a6_cell_max": node_cells,
    "a7_a8_cell_sum": cells,
    "a9_kth_cell": lambda x: x.sparkSession.createDataFrame([(kth(cells(x), K, "v"),)], "kth long"),
    "a10_least_entry": lambda x: entries(x).groupBy("node_id", item_cell().alias("cell")).agg(F.min("entry").alias("entry")),
    "a11_cell_upper_bound": upper,
    "a12_over_under": over_under,
    "a13_fold_cells": lambda x: fold_cells(cells(x), 128),
    "a14_kth_bounds": kth_bounds,
    "a15_cells_between": between,
    "a16_histogram": running,
    "a17_tail_average": lambda x: histogram(x).where("entry >= 3").groupBy("node_id").agg(whole(F.sum("mass") / F.sum("freq")).alias("tail")),
    "a18_round_stats": rounds,
    "a19_array_stats": lambda x: cells(x).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("least_used"), F.count_if(F.col("v") > 0).alias("used")),
    "w1_reverse_index": lambda x: ranked(x).select("node_id", "item_id", (F.col("rank") - 1).cast("bigint").alias("place")),
    "w2_running_mass": lambda x: x.select("node_id", "item_id", F.sum("score").over(Window.partitionBy("node_id").orderBy(*result_order()).rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("mass")),
    "w3_differences": gaps,
    "w4_last_match": last_match,
    "t1_total_order": lambda x: placed(x, ["score", "item_id", "node_id"]).select("node_id", "item_id", "score", (F.col("place") + 1).alias("place")),
    "t2_global_top": lambda x: top(x, K),
    "t4_kth_or_zero": lambda x: x.sparkSession.createDataFrame([(tau(x),)], "kth long"),
    "t5_more_than": lambda x: cells(x).where(F.col("v") > tau(x)).agg(F.count("*").alias("n")),
    "o1_union_all": lambda x: x.where("node_id < 5").unionByName(x.where("node_id >= 5")),
    "o2_cell_union": lambda x: x.select("node_id", item_cell().alias("cell")).union(x.select(next_node(), item_cell().alias("cell"))).distinct(),
    "o3_cell_difference": lambda x: x.select("node_id", item_cell().alias("cell")).subtract(x.select(next_node(), item_cell().alias("cell"))),
    "o4_bit_or": lambda x: x.groupBy(F.shiftright(item_cell(), 5).alias("cell")).agg(F.bit_or(F.pow(F.lit(2), item_cell() % 32).cast("bigint")).alias("bits")),
    "o5_cells_by_modulus": lambda x: x.select("node_id", F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), cell("item_id", 1 << b).alias("hv")) for b in (6, 10)))).alias("c")).select("node_id", "c.*").distinct(),
    "o6_intersection": lambda x: top(x, K).select("item_id").intersect(guess(x).select("item_id")),
    "x2_hash": lambda x: x.select("item_id", item_cell().alias("cell")).distinct(),
    "x3_power_of_two": lambda x: by_node(x, "bits long, size long", lambda n, _: (sizing.power_of_two(n).bit_length() - 1, sizing.power_of_two(n))),
    "x4_bloom_eps": lambda x: by_node(x, "eps double", lambda n, total: (round(sizing.bloom_eps(800, total, n, N + 1), 12),)),
    "x5_bloom_size": lambda x: by_node(x, "m long, hashes long", lambda n, total: sizing.bloom_size(n, sizing.bloom_eps(800, total, n, N + 1))),
    "x6_gcs_eps": lambda x: by_node(x, "eps double", lambda n, total: (round(sizing.gcs_eps(n // 10, 800, N, total, n), 12),)),
    "x7_gcs_modulus": lambda x: by_node(x, "m long, none long", lambda n, total: (sizing.gcs_modulus(n // 10, sizing.gcs_eps(n // 10, 800, N, total, n)), sizing.gcs_modulus(n, sizing.gcs_eps(total, 800, N, total, n)))),
    "x8_count_min_size": lambda x: by_node(x, "eps double, columns long", lambda n, total: (round(sizing.count_min_eps(n, K, total), 9), sizing.count_min_columns(n, sizing.count_min_eps(n, K, total)))),
    "x9_rice_parameter": rice,
    "x10_log_scale": lambda x: x.select("node_id", "item_id", "score", (F.ceil(F.log("score") * 16) + 1).cast("bigint").alias("scaled")),
    "x11_bounds": lambda x: x.select("node_id", "item_id", F.greatest("score", F.lit(5000000)).alias("least_five"), F.least("score", F.lit(5000000)).alias("most_five")),
    "i7_count_min_query": lambda x: count_min_query(x.select("item_id").distinct(), count_min_cells(x, 2, M), 2, M),
    "i16_golomb_bits": golomb,
    "m1_recall": lambda x: pairs(x).agg((F.count("*") / K).alias("recall")),
    "m2_k_error": lambda x: x.sparkSession.createDataFrame([((kth(top(x, K), K) - kth(guess(x), K)) / kth(top(x, K), K),)], "k_err double"),
    "m3_abs_error": lambda x: pairs(x).agg(errors(F.abs(F.col("score") - F.col("found")).cast("double")).alias("abs_err")),
    "m4_rel_error": lambda x: pairs(x).agg(F.round(errors(F.abs(F.col("score") - F.col("found")) / F.col("score")), 9).alias("rel_err")),
    "m5_distance": lambda x: distance(top(x, K), guess(x), K),
    "m9_filter_false_positives": lambda x: bloom_pass(x, bloom_cells(partial(x), M), M).join(partial(x), "item_id", "left_anti").agg(F.count("*").alias("wrong")),
    "k5_differences": lambda x: numbered(top(x, K)).join(numbered(guess(x)).select("place", F.col("item_id").alias("found_item"), F.col("score").alias("found")), "place").where((F.col("item_id") != F.col("found_item")) | (F.col("score") != F.col("found"))).select("place", F.col("item_id").alias("exact_item"), "found_item"),
    "s18_unique": lambda x: unique(x.unionByName(x)),
}
