"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lowered. Runs of SEED words that a document shares with an item are the seeds; an
item is tried in a document only if enough of its own seeds occur there (tiles of at least MIN_TILE words that cover
the threshold hold at least that many, so none is missed). Then the tiling: the longest match of words that no tile
holds yet is marked, again and again, until none of MIN_TILE words is left; matches grow from equal running
Karp-Rabin hashes of MIN_TILE words. Tiles may lie in any order, so a reordered passage is covered as well as a copied
one. A document whose tiles cover at least `coverage` of an item's words is contaminated by it.

Distribution. Documents are scanned where they lie, with no shuffle. The benchmark's seed index goes to the workers
in blocks of at most BLOCK_WORDS words; a larger benchmark takes a pass for each block, so what is broadcast is bounded.

Edge cases: null and empty texts match nothing; an item of fewer than SEED words is found as a run of its words; an
item without words matches nothing; repeated rows and ids give a row each; repeated items each match; an empty
benchmark or table gives no matches; other columns are not read. Texts and items are compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_or_empty

SEED = 3
MIN_TILE = 3
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = 0x9E3779B97F4A7C15


def running(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of every run of `width` words."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(_MULTIPLIER) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return h


class Items:
    """A block of benchmark items: word numbers, and an index from seed hash to the items that hold it."""

    def __init__(self, items: list[tuple[object, str]]):
        self.number: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        for key, text in items:
            own = np.array([self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall(text.lower())], np.int64)
            if len(own):
                self.items.append((key, own))
        hashes = [(running(own, min(SEED, len(own))), np.full(max(1, len(own) - SEED + 1), i)) for i, (_, own) in enumerate(self.items)]
        seeds = np.concatenate([h for h, _ in hashes]) if hashes else np.empty(0, np.uint64)
        owner = np.concatenate([o for _, o in hashes]) if hashes else np.empty(0, np.int64)
        order = np.lexsort((owner, seeds))
        self.seeds, self.owner = seeds[order], owner[order]
        self.distinct = np.unique(self.seeds)
        self.repeats = [int(np.unique(h, return_counts=True)[1].max()) for h, _ in hashes]
        self.short = sorted({len(own) for _, own in self.items if len(own) < SEED})

    def shared(self, ids: np.ndarray) -> dict[int, int]:
        """Number of each item's different seeds that occur in a document."""
        out: dict[int, int] = {}
        if not len(self.distinct):
            return out
        for width in (*self.short, SEED):
            h = running(ids, width)
            at = np.minimum(np.searchsorted(self.distinct, h), len(self.distinct) - 1)
            found = np.unique(h[self.distinct[at] == h])
            for a, b in zip(np.searchsorted(self.seeds, found, "left").tolist(), np.searchsorted(self.seeds, found, "right").tolist()):
                for i in self.owner[a:b].tolist():
                    out[i] = out.get(i, 0) + 1
        return out


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of a (item) and b (document): (place in a, place in b, length), longest first.

    Each round finds the matches of unmarked words that start with equal hashes and marks them by length; a match that
    a longer tile has cut is found again, shorter, in a later round.
    """
    least = min(least, len(a))
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    by_hash: dict[int, list[int]] = {}
    for j, h in enumerate(running(b, least).tolist()):
        by_hash.setdefault(h, []).append(j)
    starts = [(i, j) for i, h in enumerate(running(a, least).tolist()) for j in by_hash.get(h, ())]
    out = []
    while starts:
        found, again = [], []
        for i, j in starts:
            if not (free_a[i] and free_b[j]):
                continue
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                again.append((i, j))  # inside a longer match, which starts before
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                found.append((-n, i, j))
        if not found:
            break
        for n, i, j in sorted(found):
            n = -n
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((i, j, n))
            else:
                again.append((i, j))
                again += [(i + k, j + k) for k in range(1, n - least + 1)]
        starts = list(dict.fromkeys(again))
    return out


def blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Items]:
    """Items in blocks of bounded words, streamed to the driver a partition at a time."""
    held, words = [], 0
    for r in benchmark.select(F.col(item_col).alias("key"), text_or_empty(item_text).alias("text")).toLocalIterator():
        n = r.text.count(" ") + 1
        if held and words + n > BLOCK_WORDS:
            yield Items(held)
            held, words = [], 0
        held.append((r.key, r.text))
        words += n
    if held:
        yield Items(held)


def matched(text: str, items: Items, coverage: float) -> list[tuple[object, int, int, list[tuple[int, int, int]]]]:
    get = items.number.get
    ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
    known = ids > 0
    if not known.any():
        return []
    ids[~known] = -np.arange(1, 1 + int((~known).sum()))  # unknown words equal nothing
    out = []
    for i, seeds in items.shared(ids).items():
        key, own = items.items[i]
        need = coverage * len(own)
        # A tile of n words holds n - SEED + 1 seeds, at least n / MIN_TILE of them; equal seeds of one item count once.
        if len(own) >= SEED and MIN_TILE * seeds * items.repeats[i] < need * (MIN_TILE - SEED + 1):
            continue
        found = tiles(own, ids, MIN_TILE)
        covered = sum(n for _, _, n in found)
        if covered >= need:
            out.append((key, covered, len(own), found))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, item_col, covered (words of the item in tiles), item_words, tiles (array of item place, document place,
    length in words): a row per document and item at or over the threshold."""
    spark = docs.sparkSession
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_kind}, item {item_kind}, covered long, item_words long, tiles array<struct<item_at: long, doc_at: long, words: long>>"
    tile_type = pa.list_(pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())]))
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                rows = []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    rows += [(k, *m) for m in matched(text, held.value, coverage)]
                if rows:
                    at, keys, covered, total, found = zip(*rows)
                    found = [[{"item_at": i, "doc_at": j, "words": n} for i, j, n in x] for x in found]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(keys, item_type), pa.array(covered, pa.int64()), pa.array(total, pa.int64()), pa.array(found, tile_type)], ["id", "item", "covered", "item_words", "tiles"])

        own = source.mapInArrow(run, schema)
        out = own if out is None else out.unionAll(own)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def query(spark, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark, with the items."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark).select("doc_id", "item_id", "covered", "item_words", F.size("tiles").cast("long").alias("n_tiles"))
