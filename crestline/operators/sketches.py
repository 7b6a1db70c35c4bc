"""Sketches kept as rows: one row per cell, so that every step is a join or an aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import cell, h
from ..functions.sizing import Estimate, gcs_bytes_model
from ..model import local_top


def bloom_cells(items: DataFrame, m: int, hashes: int = 1) -> DataFrame:
    """Set bits (hash_no, cell) of a Bloom filter; with one hash, the hash values of a Golomb-coded set."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("hash_no"), cell("item_id", m, i).alias("cell")) for i in range(hashes)))).alias("c")
    return items.select(each).select("c.*").distinct()


def bloom_pass(rows: DataFrame, cells: DataFrame, m: int, hashes: int = 1) -> DataFrame:
    """Rows all of whose cells are set: a semi join per hash."""
    for i in range(hashes):
        own = cells.where(F.col("hash_no") == i).select(F.col("cell").alias("probe"))
        rows = rows.withColumn("probe", cell("item_id", m, i)).join(own, "probe", "left_semi").drop("probe")
    return rows


def count_min_cells(lists: DataFrame, hashes: int, m: int) -> DataFrame:
    """(hash_no, cell, v): the largest score of a cell within a node, summed over the nodes."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("hash_no"), cell("item_id", m, i).alias("cell")) for i in range(hashes)))).alias("c")
    per_node = lists.select("node_id", "score", each).groupBy("node_id", "c.hash_no", "c.cell").agg(F.max("score").alias("v"))
    return per_node.groupBy("hash_no", "cell").agg(F.sum("v").alias("v"))


def count_min_pass(rows: DataFrame, cells: DataFrame, least: int, hashes: int, m: int) -> DataFrame:
    """Rows whose cells all reach the least value."""
    return bloom_pass(rows, cells.where(F.col("v") >= least), m, hashes)


def count_min_query(items: DataFrame, cells: DataFrame, hashes: int, m: int) -> DataFrame:
    """item_id, estimate: the smallest of an item's cells."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("hash_no"), cell("item_id", m, i).alias("cell")) for i in range(hashes)))).alias("c")
    probes = items.select("item_id", each).select("item_id", "c.*")
    return probes.join(cells, ["hash_no", "cell"], "left").groupBy("item_id").agg(F.min(F.coalesce("v", F.lit(0))).alias("estimate"))


def histogram_cells(lists: DataFrame, entries: int, m: int, hashes: int, least, k: int | None, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, cutoffs) of a histogram of filters: equal score ranges, each with its largest and smallest score and cells.

    cells: node_id, entry, high, low, hash_no, cell. cutoffs: node_id, cutoff, the best score that no entry covers.
    `least(best)` gives the score down to which a node's sketch goes, from its k-th score; `whole` are the full lists
    where `lists` is a part that the sketch covers in full.
    """
    rows = lists
    if least is not None:
        best = local_top(lists, k).groupBy("node_id").agg(least(F.min("score")).alias("least"))
        rows = lists.join(F.broadcast(best), "node_id").where(F.col("score") >= F.col("least")).drop("least")
    # One row a node, whatever the lists hold; entries get their bounds from the cells' own aggregation.
    span = rows.groupBy("node_id").agg(F.max("score").alias("top"), F.min("score").alias("end"))
    width = F.greatest(F.lit(1), F.ceil((F.col("top") - F.col("end") + 1) / entries))
    placed = rows.join(F.broadcast(span), "node_id").withColumn("entry", F.floor((F.col("top") - F.col("score")) / width).cast("int"))
    bound = placed.groupBy("node_id", "entry").agg(F.max("score").alias("high"), F.min("score").alias("low"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("hash_no"), cell("item_id", m, i).alias("cell")) for i in range(hashes)))).alias("c")
    cells = placed.select("node_id", "entry", each).select("node_id", "entry", "c.*").distinct().join(F.broadcast(bound), ["node_id", "entry"])
    full = lists if whole is None else whole
    outside = full.join(rows.select("node_id", "item_id"), ["node_id", "item_id"], "left_anti").groupBy("node_id").agg(F.max("score").alias("cutoff"))
    cutoffs = full.select("node_id").distinct().join(outside, "node_id", "left").select("node_id", F.coalesce("cutoff", F.lit(0)).alias("cutoff"))
    return cells, cutoffs


def upper_bounds(rows: DataFrame, cells: DataFrame, cutoffs: DataFrame, m: int, hashes: int, least: int) -> DataFrame:
    """Rows whose cells' upper bound reaches `least`: best entry's high, or the cutoff, summed over the nodes.

    Only cells that some entry holds can exceed the sum of the cutoffs, so callers ask for more than that sum. Of
    several hashes each gives a bound, and all must reach it.
    """
    total = F.lit(cutoffs.agg(F.sum("cutoff")).first()[0] or 0)
    per_node = cells.groupBy("hash_no", "cell", "node_id").agg(F.max("high").alias("high"))
    gained = per_node.join(cutoffs, "node_id").groupBy("hash_no", "cell").agg(F.sum(F.greatest("high", "cutoff") - F.col("cutoff")).alias("gain"))
    return bloom_pass(rows, gained.where(F.col("gain") + total >= least), m, hashes)


def bounds(cells: DataFrame, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(over, under): per cell the sum over nodes of the largest (or the cutoff) and of the smallest score."""
    total = F.lit(cutoffs.agg(F.sum("cutoff")).first()[0] or 0)
    one = cells.where("hash_no = 0").groupBy("cell", "node_id").agg(F.max("high").alias("high"), F.max("low").alias("low")).join(cutoffs, "node_id")
    both = one.groupBy("cell").agg((F.sum(F.greatest("high", "cutoff") - F.col("cutoff")) + total).alias("over"), F.sum("low").alias("under"))
    return both.select(F.col("over").alias("score")), both.select(F.col("under").alias("score"))


def fold_cells(cells: DataFrame, m: int) -> DataFrame:
    """Cells (cell, v) at a smaller power of two, the largest of those that meet."""
    return cells.groupBy(F.pmod("cell", F.lit(m)).alias("cell")).agg(F.max("v").alias("v"))


def replicate_cells(cells: DataFrame, m: int, wide: int) -> DataFrame:
    """Cells of modulus m at a larger power of two: each stands for all that fold to it."""
    return cells.select(F.explode(F.sequence(F.col("cell"), F.lit(wide - 1).cast("bigint"), F.lit(m).cast("bigint"))).alias("cell"), "v")


def klee_histogram(lists: DataFrame, mass: float, m: int, cells: int = 100) -> tuple[DataFrame, DataFrame]:
    """(histogram, members): cells of equal width from each node's best score down.

    histogram: node_id, h, freq, avg, low, high, held (the mass before it is at most `mass` of the whole, so its members
    are listed). members: node_id, h, cell.
    """
    span = lists.groupBy("node_id").agg(F.max("score").alias("top"), F.min("score").alias("end"))
    width = F.greatest(F.lit(1), F.floor((F.col("top") - F.col("end")) / cells))
    placed = lists.join(F.broadcast(span), "node_id").withColumn("h", F.floor((F.col("top") - F.col("score")) / width).cast("int")).drop("top", "end")
    per = Window.partitionBy("node_id")  # over the histogram's own rows, about `cells` a node
    each = placed.groupBy("node_id", "h").agg(F.count("*").alias("freq"), F.sum("score").alias("sum"), F.min("score").alias("low"), F.max("score").alias("high"))
    running = F.sum("sum").over(Window.partitionBy("node_id").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("held", F.coalesce(running, F.lit(0)) <= mass * F.sum("sum").over(per)).withColumn("avg", F.floor(F.col("sum") / F.col("freq")).cast("bigint"))
    members = placed.join(each.where("held").select("node_id", "h"), ["node_id", "h"]).select("node_id", "h", cell("item_id", m).alias("cell")).distinct()
    return each, members


def klee_estimates(sent: DataFrame, histogram: DataFrame, members: DataFrame, m: int) -> DataFrame:
    """item_id, score: what is known plus, for each node that did not send the item, its histogram's estimate.

    The pairs of item and node are no more than k times the square of the nodes.
    """
    known = sent.groupBy("item_id").agg(F.sum("score").alias("known"))
    tail = histogram.where(~F.col("held")).groupBy("node_id").agg(F.floor(F.sum("sum") / F.sum("freq")).cast("bigint").alias("tail"))
    everyone = histogram.select("node_id").distinct().join(tail, "node_id", "left")
    pairs = sent.select("item_id").distinct().crossJoin(everyone).join(sent.select("node_id", "item_id"), ["node_id", "item_id"], "left_anti")
    first = members.groupBy("node_id", "cell").agg(F.min("h").alias("h")).join(histogram.select("node_id", "h", "avg"), ["node_id", "h"])
    guess = pairs.withColumn("cell", cell("item_id", m)).join(first, ["node_id", "cell"], "left")
    guessed = guess.groupBy("item_id").agg(F.sum(F.coalesce("avg", "tail", F.lit(0))).alias("guess"))
    return known.join(guessed, "item_id", "left").select("item_id", (F.col("known") + F.coalesce("guess", F.lit(0))).alias("score"))


def popped(cells: DataFrame, cutoffs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Drops the lowest entry of nodes, most cells for a point of cutoff first, until the cutoffs would reach `least`.

    One row per entry and node comes to the driver: nodes times entries, whatever the lists hold.
    """
    spark = cells.sparkSession
    sizes = cells.groupBy("node_id", "entry").agg(F.max("high").alias("high"), F.count("*").alias("size")).collect()
    cut = {r.node_id: r.cutoff for r in cutoffs.collect()}
    lowest = {}
    for r in sorted(sizes, key=lambda r: r.entry):
        lowest[r.node_id] = r
    rise = {node: max(0, r.high - cut[node]) for node, r in lowest.items()}
    total, gone = sum(cut.values()), []
    for node in sorted(lowest, key=lambda n: (-lowest[n].size / (1 + rise[n]), n)):
        if total + rise[node] >= least:
            break
        total += rise[node]
        cut[node] += rise[node]
        gone.append((node, lowest[node].entry))
    if not gone:
        return cells, cutoffs
    dropped = spark.createDataFrame(gone, "node_id long, entry int")
    return cells.join(F.broadcast(dropped), ["node_id", "entry"], "left_anti"), spark.createDataFrame(list(cut.items()), "node_id long, cutoff long")


@dataclass
class Costed:
    """A histogram of filters whose ranges and sizes the cost model chose.

    cells: node_id, entry, high, low, m, cell, each at its entry's own modulus m. ranges: (node_id, entry, high, low, m,
    rows) of each entry, and cutoffs: node_id -> best score below the last entry; both are small and on the driver.
    """

    cells: DataFrame
    ranges: list[tuple]
    cutoffs: dict[int, int]

    @property
    def total(self) -> int:
        return sum(self.cutoffs.values())

    @property
    def wide(self) -> int:
        return max((r[4] for r in self.ranges), default=1)

    def cutoff_rows(self) -> DataFrame:
        return self.cells.sparkSession.createDataFrame(list(self.cutoffs.items()), "node_id long, cutoff long")

    def at_widest(self) -> DataFrame:
        """Cells at the largest modulus; a cell of a smaller one stands for all that fold to it (SPREAD at most)."""
        step = F.sequence(F.col("cell"), F.lit(self.wide - 1).cast("bigint"), F.col("m"))
        return self.cells.select("node_id", "entry", "high", "low", F.lit(0).alias("hash_no"), F.explode(step).alias("cell"))

    def at_narrowest(self) -> DataFrame:
        """Cells folded to the smallest modulus, where an item counts once."""
        m = min((r[4] for r in self.ranges), default=1)
        return self.cells.select("node_id", "entry", "high", "low", F.lit(0).alias("hash_no"), F.pmod("cell", F.lit(m)).alias("cell"))

    def bytes(self) -> dict[int, int]:
        """node_id -> modelled bytes of its entries with their bounds, and of the cutoff."""
        out = dict.fromkeys(self.cutoffs, 4)
        for node, _, _, _, m, rows in self.ranges:
            out[node] += 8 + gcs_bytes_model(rows, m)
        return out


def cost_ranges(lists: DataFrame, spans: dict[int, tuple[int, int, int]], modulus, first: int = 0) -> tuple[list[tuple], dict[int, int]]:
    """(ranges, cutoffs): each node's scores from `spans[node]` = (start, end, entries) cut into ranges from the top down.

    A range takes an equal part of what is left; while `modulus(node, rows, best)` is 0 (no filter pays) it is halved, and
    a halved range is the last if rows are left above its planned end. All nodes go down one range a pass: a pass is one
    aggregation of the rows by the bands between the possible ends, at most 34 rows a node, whatever the lists hold.
    """
    spark = lists.sparkSession
    state, made, cutoffs = dict(spans), [], {}
    entry = first
    while state:
        ends = {}
        for node, (at, least, left) in state.items():
            width = max(0, at - least) // left
            ends[node] = [at - width]
            while width:
                width //= 2
                ends[node].append(at - width)
        probe = spark.createDataFrame([(n, state[n][0], own) for n, own in ends.items()], "node_id long, start long, ends array<long>")
        band = F.size(F.filter("ends", lambda e: e <= F.col("score"))).alias("band")
        near = lists.select("node_id", "score").join(F.broadcast(probe), "node_id").where("score <= start")
        bands = {}
        for r in near.groupBy("node_id", band).agg(F.count("*").alias("n"), F.max("score").alias("best")).collect():
            bands.setdefault(r.node_id, {})[r.band] = (r.n, r.best)
        after = {}
        for node, (at, least, left) in state.items():
            own = bands.get(node, {})
            for j, end in enumerate(ends[node]):
                rows = sum(n for b, (n, _) in own.items() if b > j)
                m = modulus(node, rows, at) if rows else 0
                if m:
                    break
            else:
                cutoffs[node] = at
                continue
            made.append((node, entry, at, end, m, rows))
            below = max((best for b, (_, best) in own.items() if b <= j), default=0)
            if below >= max(1, least) and below < ends[node][0] and left > 1:
                after[node] = (below, least, left - 1)
            else:
                cutoffs[node] = below
        state, entry = after, entry + 1
    return made, cutoffs


SPREAD = 64  # the largest modulus over the smallest of a histogram


def costed_cells(lists: DataFrame, entries: int, estimate: Estimate, k: int, depth: int = 0, before: Costed | None = None, least: int | None = None) -> Costed:
    """A histogram of filters down to each node's share of its k-th score, or to its depth * k-th row if that comes first.

    With `before`, the histogram goes on below it down to `least`, with `entries` further entries, and holds both.
    """
    spark = lists.sparkSession
    at_k = F.min("score").alias("at_k")
    best = local_top(lists, k).groupBy("node_id").agg(at_k)
    facts = lists.groupBy("node_id").agg(F.count("*").alias("length"), F.max("score").alias("top"), F.min("score").alias("end")).join(F.broadcast(best), "node_id")
    facts = {r.node_id: r for r in facts.collect()}
    true = lists.select("item_id").distinct().count() if estimate.overlap < 0 else 0
    deep = {r.node_id: r.score for r in local_top(lists, depth * k + 1).groupBy("node_id").agg(F.min("score").alias("score")).collect()} if depth else {}
    spans = {}
    for node, f in facts.items():
        if before is not None:
            if before.cutoffs.get(node, 0) > 0 and before.cutoffs[node] >= max(least, f.end):
                spans[node] = (before.cutoffs[node], max(least, f.end), max(1, entries))
            continue
        low, count = max(-(-f.at_k // len(facts)), f.end), entries
        if node in deep and deep[node] > low:
            count = max(1, int(entries * (f.top - deep[node]) / max(1, f.top - low)))
            low = deep[node]
        spans[node] = (f.top, low, count)

    def modulus(node: int, rows: int, top: int) -> int:
        f = facts[node]
        return estimate.modulus(rows, top, f.at_k, len(facts), f.length, true)

    held = [] if before is None else before.ranges
    ranges, cutoffs = cost_ranges(lists, spans, modulus, 1 + max((r[1] for r in held), default=-1))
    cutoffs = {**dict.fromkeys(facts, 0), **(before.cutoffs if before else {}), **cutoffs}
    ranges = held + ranges
    floor = max((r[4] for r in ranges), default=1) // SPREAD
    ranges = [(*r[:4], max(r[4], floor), r[5]) for r in ranges]
    own = {}
    for r in ranges:
        own.setdefault(r[0], []).append(r[1:5])
    frame = spark.createDataFrame(list(own.items()), "node_id long, own array<struct<entry:int,high:long,top_low:long,m:long>>")
    within = F.get(F.filter("own", lambda e: F.col("score").between(e.top_low, e.high)), F.lit(0)).alias("e")
    placed = lists.join(F.broadcast(frame), "node_id").select("node_id", "item_id", "score", within).where("e IS NOT NULL").select("node_id", "item_id", "score", "e.*")
    low = placed.groupBy("node_id", "entry").agg(F.min("score").alias("low"))
    cells = placed.select("node_id", "entry", "high", "m", F.pmod(h("item_id"), "m").alias("cell")).distinct().join(F.broadcast(low), ["node_id", "entry"])
    return Costed(cells.persist(), ranges, cutoffs)
