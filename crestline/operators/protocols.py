"""Exact and approximate top-k protocols as chains of rounds.

Each takes lists (node_id, item_id, score) and returns a Result: the frame of the k best items and a frame for each
round of what the nodes sent in it. A round's frame is lazy; only thresholds (one number each) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cell
from ..functions.sizing import Estimate, power_of_two
from ..model import kth, local_top, nodes, result_order, top, totals, unsent


# The modelled size of a record and of an id on the wire.
RECORD_BYTES = 100
ID_BYTES = 4


@dataclass
class Result:
    frame: DataFrame
    rounds: list[DataFrame] = field(default_factory=list)
    thresholds: dict[str, int] = field(default_factory=dict)
    sketches: dict[int, int] = field(default_factory=dict)  # round -> modelled bytes of thresholds, ids and sketches
    lookups: set[int] = field(default_factory=set)  # rounds in which nodes look items up instead of reading their lists

    def shipped(self) -> DataFrame:
        """round, node_id, items: rows sent by each node in each round; nodes that send nothing in a round have no row."""
        out = None
        for i, r in enumerate(self.rounds, 1):
            own = r.groupBy("node_id").agg(F.count("*").alias("items")).select(F.lit(i).alias("round"), "node_id", "items")
            out = own if out is None else out.unionAll(own)
        return out


    def report(self) -> DataFrame:
        """round, items, largest (of one node), bytes and bytes of the busiest node: what the rounds cost at RECORD_BYTES a row."""
        return self.shipped().groupBy("round").agg(F.sum("items").alias("items"), F.max("items").alias("largest")).withColumns({"bytes": F.col("items") * RECORD_BYTES, "largest_bytes": F.col("largest") * RECORD_BYTES})


def sent(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0].select("node_id", "item_id", "score")
    for r in rounds[1:]:
        out = out.unionAll(r.select("node_id", "item_id", "score"))
    return out


def finish(rounds: list[DataFrame], k: int, **thresholds: int) -> Result:
    return Result(top(sent(rounds), k), rounds, thresholds)


def naive(lists: DataFrame, k: int, cutoff: int = 0) -> Result:
    """All lists, or each node's first cutoff * k rows (then not exact)."""
    return finish([local_top(lists, cutoff * k) if cutoff else lists], k)


def magic(lists: DataFrame, k: int) -> Result:
    """The least an exact protocol could send: after the local best, just the true winners' other rows."""
    first = local_top(lists, k)
    winners = top(lists, k).select("item_id")
    out = finish([first, unsent(lists.join(winners, "item_id", "left_semi"), first)], k)
    out.lookups = {2}
    return out


def tput(lists: DataFrame, k: int) -> Result:
    """Three-phase uniform threshold with alpha 1/2, in whole numbers: a node sends rows with 2 * n * score >= tau1."""
    n = nodes(lists)
    first = local_top(lists, k).persist()
    tau1 = kth(totals(first), k)
    left = unsent(lists, first)
    second = left.where(2 * n * F.col("score") >= tau1)
    partial = totals(sent([first, second]))
    tau2 = kth(partial, k)
    candidates = partial.where(2 * n * F.col("score") + (n - F.col("answers")) * tau1 >= 2 * n * tau2).select("item_id")
    third = left.where(2 * n * F.col("score") < tau1).join(candidates, "item_id", "left_semi")
    out = finish([first, second, third], k, tau1=tau1, tau2=tau2)
    out.sketches, out.lookups = {2: ID_BYTES * n, 3: ID_BYTES * n * candidates.count()}, {3}
    return out


def tput_hash(lists: DataFrame, k: int, tight: bool = False) -> Result:
    """Threshold protocol whose second round sends a hashed array (largest score per cell) in place of rows.

    `tight` takes the k-th largest cell as the threshold, and repeats the last round with the k-th score found if that
    was too high.
    """
    n = nodes(lists)
    first = local_top(lists, k).persist()
    tau1 = kth(totals(first), k)
    m = power_of_two(lists.count())
    t = tau1 // max(1, n)
    seen = lists.where(F.col("score") >= t).unionByName(first.where(F.col("score") < t)).withColumn("cell", cell("item_id", m))
    per_node = seen.groupBy("node_id", "cell").agg(F.max("score").alias("score"))
    cells = per_node.groupBy("cell").agg(F.sum("score").alias("score"), F.count("*").alias("answers")).persist()
    threshold = max(tau1, kth(cells, k)) if tight else tau1

    def answer(threshold: int, before: list[DataFrame]) -> DataFrame:
        passed = cells.where((n - F.col("answers")) * t + F.col("score") >= threshold).select("cell")
        # Cells that no node filled stand for rows below t at every node.
        left = unsent(lists, sent(before)).withColumn("cell", cell("item_id", m))
        if n * t >= threshold:
            failed = cells.where((n - F.col("answers")) * t + F.col("score") < threshold).select("cell")
            return left.join(failed, "cell", "left_anti").drop("cell")
        return left.join(passed, "cell", "left_semi").drop("cell")

    rounds = [first, answer(threshold, [first])]
    found = kth(totals(sent(rounds)), k)
    if found < threshold:
        rounds.append(answer(found, rounds))
    return finish(rounds, k, tau1=tau1, threshold=threshold, found=found)


def count_min(lists: DataFrame, k: int, hashes: int = 3, columns: int = 1 << 14, cut_rank: int | None = None) -> Result:
    """Two rounds: each node's best rows with a count-min sketch (largest score per cell), then what the summed sketch passes.

    With cut_rank, rows below a node's cutoff (its k-th score shared by the nodes) stay out of the sketch, and every
    cell stands for at least the sum of the cutoffs.
    """
    from .sketches import count_min_cells, count_min_pass

    n = nodes(lists)
    first = local_top(lists, k)
    tau = kth(totals(first), k)
    cutoff = 0
    if cut_rank:
        cuts = local_top(lists, cut_rank).groupBy("node_id").agg(F.floor(F.min("score") / n).cast("bigint").alias("cutoff"))
        held = lists.join(cuts, "node_id").where(F.col("score") > F.col("cutoff"))
        cutoff = cuts.agg(F.sum("cutoff")).first()[0] or 0
        lists_in = held.withColumn("score", F.col("score") - F.col("cutoff")).drop("cutoff")
    else:
        lists_in = lists
    if tau <= cutoff:
        return finish([first, unsent(lists, first)], k, tau=tau, cutoff=cutoff)
    cells = count_min_cells(lists_in, hashes, columns)
    second = count_min_pass(unsent(lists, first), cells, tau - cutoff, hashes, columns)
    return finish([first, second], k, tau=tau, cutoff=cutoff)


def approximate_filter(lists: DataFrame, k: int, m: int = 1 << 12, hashes: int = 1, gamma: float = 1.0, beta: float = 0.0) -> Result:
    """Two rounds, not exact: the coordinator's best k * gamma items so far as a filter; nodes send what passes, at most
    k * beta rows each if beta is set."""
    from .sketches import bloom_cells, bloom_pass

    first = local_top(lists, k)
    held = top(first, max(1, int(k * gamma))).select("item_id")
    second = bloom_pass(unsent(lists, first), bloom_cells(held, m, hashes), m, hashes)
    if beta:
        second = local_top(second, max(1, int(k * beta)))
    return finish([first, second], k)


def histogram_filter(lists: DataFrame, k: int, entries: int = 10, m: int = 1 << 16, hashes: int = 1, estimate: Estimate | None = None, pop: bool = False) -> Result:
    """Two rounds, exact: the local best with a histogram of filters for the rest; the bounds of all nodes give one filter.

    A cell's upper bound is the sum over nodes of its best entry's largest score, or the node's cutoff where the cell
    is in no entry. Where the threshold is no more than the sum of the cutoffs everything is sent. With an estimate the
    cost model chooses ranges and moduli, else ranges are equal. `pop` drops the lowest entries that the threshold allows.
    """
    from .sketches import costed_cells, histogram_cells, popped, upper_bounds

    first = local_top(lists, k)
    tau = kth(totals(first), k)
    n = nodes(lists)
    sizes: dict[int, int] = {}
    if estimate is None:
        cells, cutoffs = histogram_cells(lists, entries, m, hashes, lambda best: F.ceil(best / n), k)
    else:
        sketch = costed_cells(lists, entries, estimate, k)
        cells, cutoffs, m, sizes = sketch.at_widest(), sketch.cutoff_rows(), sketch.wide, sketch.bytes()
    cells, cutoffs = cells.persist(), cutoffs.persist()
    if pop:
        cells, cutoffs = popped(cells, cutoffs, tau)
    total = cutoffs.agg(F.sum("cutoff")).first()[0] or 0
    left = unsent(lists, first)
    if tau > total:
        left = upper_bounds(left, cells, cutoffs, m, hashes, tau)
    out = finish([first, left], k, tau=tau, cutoff=total)
    out.sketches = {1: sum(sizes.values())}
    return out


def extra_round(lists: DataFrame, k: int, gamma: float = 0.9, depth: int = 5, entries: int = 10, heuristic: bool = True, estimate: Estimate = Estimate()) -> Result:
    """Sketches first, no rows: the bounds of the k-th score give a threshold between them, and nodes send matches with
    a further sketch; a last round with the k-th score found, less what was asked before, makes it exact.

    The first sketch stops at the depth * k-th row of each list (0: it does not). `heuristic` lets the threshold fall to
    the sum of the cutoffs plus one where the estimate lies below it.
    """
    from .sketches import bounds, costed_cells, upper_bounds

    sketch = costed_cells(lists, entries, estimate, k, depth)
    narrow, cutoffs = sketch.at_narrowest(), sketch.cutoff_rows()
    over, under = bounds(narrow, cutoffs)
    low, high, total = kth(under, k), kth(over, k), sketch.total
    threshold = int(low + gamma * max(0, high - low))
    if threshold <= total:
        threshold = total + 1 if heuristic and high > total else 0
    everything = lists.select("node_id", "item_id", "score")
    if threshold <= total:
        out = finish([everything], k, low=low, high=high, threshold=threshold, cutoff=total)
        out.sketches = {1: sum(sketch.bytes().values())}
        return out
    first = upper_bounds(everything, sketch.at_widest(), cutoffs, sketch.wide, 1, threshold).persist()
    found = kth(totals(first), k)
    rounds, sizes = [first], {1: sum(sketch.bytes().values())}
    if found < threshold:
        # The further sketch goes down to each node's share of the score that is still possible.
        deeper = costed_cells(lists, entries // 2, estimate, k, before=sketch, least=found // max(1, nodes(lists)))
        sizes[2], total = sum(deeper.bytes().values()) - sizes[1], deeper.total
        left = unsent(everything, first)
        rounds.append(left if found <= total else upper_bounds(left, deeper.at_widest(), deeper.cutoff_rows(), deeper.wide, 1, found))
    out = finish(rounds, k, low=low, high=high, threshold=threshold, found=found, cutoff=total)
    out.sketches = sizes
    return out


def klee(lists: DataFrame, k: int, cells_round: bool = False, mass: float = 0.1, m: int = 1 << 12, parity: bool = True) -> Result:
    """Two rounds (three with the cell round), not exact: score estimates from histograms set the threshold tau / n.

    `parity` also sends the first row below the threshold. With the cell round, candidates are kept by hash cells whose
    summed upper bounds exceed tau, and exact scores are sent for the estimated best.
    """
    from .sketches import klee_estimates, klee_histogram

    n = nodes(lists)
    first = local_top(lists, k)
    histogram, members = klee_histogram(lists, mass, m)
    histogram, members = histogram.persist(), members.persist()
    estimates = klee_estimates(first, histogram, members, m).persist()
    tau = kth(estimates, k)
    left = unsent(lists, first).select("node_id", "item_id", "score")
    below = F.col("score") * n < tau
    candidates = left.where(~below)
    if parity:
        row = F.max(F.struct("score", "item_id")).alias("row")
        stop = lists.where(below).groupBy("node_id").agg(row).select("node_id", "row.item_id", "row.score")
        candidates = candidates.unionByName(unsent(stop, first).select("node_id", "item_id", "score"))
    if not cells_round:
        return finish([first, candidates], k, tau=tau)
    wanted = estimates.orderBy(*result_order()).limit(k).select("item_id")
    exact = candidates.join(wanted, "item_id", "left_semi").select("node_id", "item_id", "score")
    row = candidates.withColumn("cell", cell("item_id", m))
    in_cell = histogram.select("node_id", "low", "high")
    bound = row.join(in_cell, "node_id").where(F.col("score").between(F.col("low"), F.col("high"))).groupBy("node_id", "cell").agg(F.max("high").alias("bound"))
    received = sent([first, exact]).withColumn("cell", cell("item_id", m)).groupBy("item_id", "cell").agg(F.sum("score").alias("score")).groupBy("cell").agg(F.max("score").alias("score"))
    sums = bound.groupBy("cell").agg(F.sum("bound").alias("bound")).join(received, "cell", "left")
    passed = sums.where(F.col("bound") + F.coalesce("score", F.lit(0)) > tau).select("cell")
    last = unsent(row.join(passed, "cell", "left_semi"), exact).select("node_id", "item_id", "score")
    return finish([first, exact, last], k, tau=tau)


# Name, whether the result is exact, and the protocol with its standard parameters.
PROTOCOLS = {
    "p1_naive": (True, lambda x, k: naive(x, k)),
    "p2_naive_2k": (False, lambda x, k: naive(x, k, 2)),
    "p3_magic": (True, magic),
    "p4_tput": (True, tput),
    "p5_tput_hash": (True, lambda x, k: tput_hash(x, k)),
    "p6_tput_tight": (True, lambda x, k: tput_hash(x, k, True)),
    "p7_klee3": (False, lambda x, k: klee(x, k)),
    "p8_klee4": (False, lambda x, k: klee(x, k, True)),
    "p9_sketch_two_rounds": (True, lambda x, k: histogram_filter(x, k, estimate=Estimate())),
    "p10_extra_round": (True, extra_round),
    "p11_extra_round_no_split": (True, lambda x, k: extra_round(x, k, 0.5, 0)),
    "p12_extra_round_no_heuristic": (True, lambda x, k: extra_round(x, k, heuristic=False)),
    "p13_extra_round_many_entries": (True, lambda x, k: extra_round(x, k, entries=100)),
    "p14_under": (True, lambda x, k: extra_round(x, k, estimate=Estimate(overlap=0.0))),
    "p14_unweighted": (True, lambda x, k: extra_round(x, k, estimate=Estimate(weighted=False))),
    "p14_ideal": (True, lambda x, k: extra_round(x, k, estimate=Estimate(overlap=-1.0))),
    "p14_ideal_under": (True, lambda x, k: extra_round(x, k, estimate=Estimate(overlap=-1.0, bits=0.8))),
    "p14_ideal_over": (True, lambda x, k: extra_round(x, k, estimate=Estimate(overlap=-1.0, bits=1.2))),
    "p14_bits_20_over": (True, lambda x, k: extra_round(x, k, estimate=Estimate(bits=1.2))),
    "p14_bits_10_over": (True, lambda x, k: extra_round(x, k, estimate=Estimate(bits=1.1))),
    "p14_bits_20_under": (True, lambda x, k: extra_round(x, k, estimate=Estimate(bits=0.8))),
    "p14_bits_10_under": (True, lambda x, k: extra_round(x, k, estimate=Estimate(bits=0.9))),
    "p15_approximate_gcs": (False, lambda x, k: approximate_filter(x, k)),
    "p16_bloom_sketch": (True, lambda x, k: histogram_filter(x, k, hashes=2, pop=True)),
    "p17_gcs_sketch": (True, lambda x, k: histogram_filter(x, k, estimate=Estimate(), pop=True)),
    "p18_count_min": (True, lambda x, k: count_min(x, k, cut_rank=k)),
    "p19_approximate_bloom": (False, lambda x, k: approximate_filter(x, k, 1 << 10, 3)),
    "p20_count_min_whole": (True, lambda x, k: count_min(x, k)),
    "p21_count_min_filter": (True, lambda x, k: count_min(x, k, 1, 1 << 16)),
}
