"""Exact Jaccard self-join of word shingle sets, with size-banded tiles and hashed bitmap signatures.

1. Sets. Each text's distinct shingles give its size, a 64-bit key (equal sets share one; from here on a set counts
   once) and a hashed bitmap of four to eight bits for each shingle. Tokens that repeat within a chunk of texts are
   counted, so that the common ones of the corpus are known (HOT_LIST at most: only an order, never a filter).
2. Index. Under a global order (common tokens last) two sets x <= y (by size, then key) that reach the threshold t share
   a token among the first n - ceil(t*n) + 1 of y and the first n - ceil(2t/(1+t)*n) + 1 of x (its `mid` tokens). Rows
   are sorted by token and size; a row stays if a partner of a near enough size that meets this is in its token's run.
3. Bags. Bit counts bound the overlap of two sets from above: |A & B| <= |A| - bits(a & ~b). Each row is first tried so
   against the row before it and the first of its size band in its run; then the runs that hold several bags are cut
   into tiles of bounded bytes, tiles whose sizes are near enough meet, and their sets of different bags are tried. A
   task returns a spanning forest of the pairs that pass, at most a row for each member and never the pairs; sets of one
   bag are not tried again, so a group of near copies costs its members, not their pairs. What the forests connect is a
   bag: every pair that reaches the threshold lies within one.
4. Intersection. Each bag's sorted arrays, made from the texts once more, are dealt out in tiles by size, and its pairs are intersected exactly. A
   task returns a spanning forest of the links and how many links each member has; without links asked for, sets that
   are connected already are not intersected. A bag of more than a tile is repeated for each pair of its tiles in reach.
5. Classes over all forests are spread to the documents.

Nothing is capped or sampled: every pair that reaches the threshold is linked directly or through its class.

Edge cases: null and empty texts, and texts of white space, have no shingles and a class of their own; repeated rows
share a class; repeated ids give a row each; null ids are never a class's name unless all its ids are null; an empty
table gives an empty result; other columns are not read. Memory of a task: about 80 bytes a byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import components
from .common import chunks, cut, remove, settings, shared_dir, text_or_empty
from .shingles import mix, sets

HOT_LIST = 1 << 18
HOT_CHUNK = 3
HOT_LEAST = 16
TILE = 2048
TILE_SHINGLES = TILE << 9
CHUNK = 1 << 20
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
PAIRS = 1 << 15
ID_BYTES = 32 << 20


def key_of(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    x = mix(np.array([np.bitwise_xor.reduce(s), len(s)], np.uint64) + np.add.reduce(s, keepdims=True))
    return int(mix(x[:1] * np.uint64(3) + x[1:]).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Bit h % W of each shingle h; W is the power of two from four times the size up, 64 at least."""
    width = max(64, 4 << int(len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[s & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0 (id, size, key, bitmap) for documents and of kind 1 (key: a token, n: its count in a chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            own = list(sets(batch.column("text")))
            keys = [key_of(s) for s in own]
            yield packed(0, batch.column("id"), [len(s) for s in own], keys, [bitmap(s) if len(s) else None for s in own])
            once = dict(zip(keys, own))
            if once:
                token, count = np.unique(np.concatenate(list(once.values())), return_counts=True)
                token, count = token[count >= HOT_CHUNK], count[count >= HOT_CHUNK]
                yield packed(1, pa.nulls(len(token), batch.column("id").type), count, token.view(np.int64), [None] * len(token))

    def packed(kind: int, ids, n, keys, maps) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), ids, pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(maps, pa.binary())], ["kind", "id", "n", "key", "bits"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"kind int, id {source.schema['id'].dataType.simpleString()}, n long, key long, bits binary")


def prefix_length(n, percent: int):
    """How many first tokens of a set of n hold one of every set that it reaches the threshold with."""
    return n - -(-percent * n // 100) + 1


def mid_length(n, percent: int):
    """The same where the other set is not smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def ordered(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The set with its prefix in the global order first: rare tokens by their hash, then common ones by their counts."""
    tokens, places = hot
    if not len(tokens) or not len(s):
        return s
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    common = tokens[at] == s
    if not common[: prefix_length(len(s), percent)].any():
        return s
    return np.concatenate([s[~common], s[common][np.argsort(places[at[common]], kind="stable")]])


def shared_index(docs: DataFrame, hot, percent: int, text_col: str) -> DataFrame:
    """token, rank (place in the token's run by size), n, key, mid, hub, before: sets that can meet a partner in a run.

    hub is the first key of the row's size band in the run and before the key of the row ahead, for step 3's first tries.
    A run's rows stream through one task (25 bytes each) in one pass, so a token of very many sets costs time there, not
    memory; what is compared is dealt out by tile.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in chunks(batches, "text", CHUNK):
            out = []
            for s in sets(batch.column("text")):
                n = len(s)
                if not n or (key := key_of(s)) in seen:
                    continue
                seen.add(key)
                out.append((ordered(s, hot.value, percent)[: prefix_length(n, percent)], n, key))
            if out:
                counts = [len(s) for s, _, _ in out]
                n = np.repeat([n for _, n, _ in out], counts)
                place = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
                columns = [pa.array(np.concatenate([s for s, _, _ in out]).view(np.int64)), pa.array(n), pa.array(np.repeat(np.array([k for _, _, k in out], np.int64), counts)), pa.array(place < mid_length(n, percent))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "n", "key", "mid"])

    source = docs.select(text_or_empty(text_col).alias("text"))
    rows = source.mapInArrow(prefixes, "token long, n long, key long, mid boolean").repartition("token").sortWithinPartitions("token", "n", "key")
    return rows.mapInArrow(run_rows(percent), "token long, rank long, n long, key long, mid boolean, hub long, before long")


def run_rows(percent: int):
    """Sorted (token, n, key, mid) rows: keeps those that have a partner in their run, with their place and first links.

    The last row of a batch waits for the next batch, which tells whether its run goes on; of a run that is under way
    only figures of its last rows are held.
    """
    names = ["token", "rank", "n", "key", "mid", "hub", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = np.empty((4, 0), np.int64)
        under_way = None  # of the waiting row's run: rows so far, band, hub, key and size of the last row, size of the last mid row

        def done(rows: np.ndarray, following: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            nonlocal under_way
            token, n, key, mid = rows
            count = len(token)
            if not count:
                return
            mid = mid.astype(bool)
            rank, last_band, last_hub, last_key, last_n, last_mid = under_way or (0, -1, 0, 0, 0, 0)
            i = np.arange(count)
            new = np.r_[under_way is None, token[1:] != token[:-1]]
            begin = np.maximum.accumulate(np.where(new, i, -1))
            goes_on = following is not None and following[0] == token[-1]
            has_next = np.r_[token[1:] == token[:-1], goes_on]
            next_n = np.r_[n[1:], following[1] if goes_on else 0]
            at = np.maximum.accumulate(np.where(mid, i, -1))
            ahead = np.r_[-1, at[:-1]]
            smaller = np.where(ahead >= np.maximum(begin, 0), n[ahead], np.where(begin < 0, last_mid, 0))
            keep = (mid & has_next & (next_n * percent <= n * 100)) | (smaller * 100 >= n * percent)
            band = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
            first = new | (band != np.r_[last_band, band[:-1]])
            hub_at = np.maximum.accumulate(np.where(first, i, -1))
            hub = np.where(hub_at >= 0, key[hub_at], last_hub)
            near = ~new & (np.r_[last_n, n[:-1]] * 100 >= n * percent)
            before = np.where(near, np.r_[last_key, key[:-1]], key)
            place = np.where(begin >= 0, i - begin, i + rank)
            if goes_on:
                mid_n = n[at[-1]] if at[-1] >= max(begin[-1], 0) else last_mid if begin[-1] < 0 else 0
                under_way = (int(place[-1]) + 1, int(band[-1]), int(hub[-1]), int(key[-1]), int(n[-1]), int(mid_n))
            else:
                under_way = None
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, place, n, key, mid, hub, before)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in range(4)]
            rows = np.concatenate([wait, own], axis=1)
            rows = rows[:, np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[2, 1:] != rows[2, :-1])]]
            wait = rows[:, -1:]
            yield from done(rows[:, :-1], wait[:, 0])
        yield from done(wait, None)

    return run


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps (64-bit words) folded to `width` words: a bit's place modulo a smaller power of two."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def possible(n1: np.ndarray, n2: np.ndarray, bits1: list[bytes], bits2: list[bytes], percent: int) -> np.ndarray:
    """Which pairs the bit counts allow to reach the threshold: an upper bound of the overlap is tried against it."""
    ok = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    size1, size2 = np.array([len(b) for b in bits1]), np.array([len(b) for b in bits2])
    for a, b in {(x, y) for x, y in zip(size1[ok].tolist(), size2[ok].tolist())}:
        at = np.flatnonzero(ok & (size1 == a) & (size2 == b))
        step = max(1, (8 << 20) // max(a, b))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            x = fold(np.frombuffer(b"".join([bits1[i] for i in own]), np.uint64).reshape(len(own), a // 8), min(a, b) // 8)
            y = fold(np.frombuffer(b"".join([bits2[i] for i in own]), np.uint64).reshape(len(own), b // 8), min(a, b) // 8)
            most = np.minimum(n1[own] - count_bits(x & ~y), n2[own] - count_bits(y & ~x))
            ok[own] = 100 * most >= percent * (n1[own] + n2[own] - most)
    return ok


def bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that sizes and bitmaps allow. maps: key, n, bits."""
    left = maps.select(F.col("key").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    right = maps.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    near = (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "bits1", 1 << 20):
            c = {x: batch.column(x) for x in ("n1", "n2", "bits1", "bits2")}
            keep = possible(c["n1"].to_numpy(), c["n2"].to_numpy(), c["bits1"].to_pylist(), c["bits2"].to_pylist(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "n1", "n2", "bits1", "bits2").mapInArrow(run, "a long, b long")


def arrays_of(docs: DataFrame, maps: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and shingles (sorted 64-bit words as bytes) of the sets wanted (keys), one row each from a task at most.

    Nothing is written here: arrays are as large as the texts, so they go to where they are met as they are made. Only
    a set whose id (or nameless row) repeats comes from several tasks.

    The ids go to the workers as an array of whole numbers while it is at most ID_BYTES, else texts are joined. A set
    that only rows without an id have is found among those rows by its key.
    """
    spark = docs.sparkSession
    wanted = cut(maps.join(keys, "key", "left_semi").select("key", "id"))
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    whole = source.schema["id"].dataType.simpleString() in ("bigint", "int")
    ids = wanted.where("id IS NOT NULL").select("id")
    held = None
    if whole and 8 * wanted.count() <= ID_BYTES:
        held = spark.sparkContext.broadcast(np.sort(np.array([r.id for r in ids.collect()], np.int64)))
        known = source.where("id IS NOT NULL")
    else:
        known = source.join(ids, "id", "left_semi")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                own = batch.column("id").to_numpy()
                at = np.minimum(np.searchsorted(held.value, own), max(0, len(held.value) - 1))
                batch = batch.filter(pa.array(held.value[at] == own if len(held.value) else np.zeros(len(own), bool)))
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in chunks(batches, "text", CHUNK):
            own = {key_of(s): s for s in sets(part.column("text"))}
            own = {k: s for k, s in own.items() if k not in seen}
            seen.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([s.tobytes() for s in own.values()], pa.binary())], ["key", "shingles"])

    shape = "key long, shingles binary"
    out = known.mapInArrow(lambda batches: run(listed(batches)), shape)
    nameless = wanted.where("id IS NULL").select("key")
    if nameless.limit(1).count():
        out = out.unionAll(source.where("id IS NULL").mapInArrow(run, shape).join(nameless, "key", "left_semi"))
    return out


def tile_of(rank: str) -> Column:
    """The tile of a row by its place in size order: TILE rows, or fewer so that the sets of a tile stay within bounds."""
    bits = F.length(F.bin("n"))
    rows = F.greatest(F.lit(16), F.least(F.lit(TILE), F.expr(f"shiftright({2 * TILE_SHINGLES}, length(bin(n)))")))
    return bits.cast("long") * (1 << 48) + F.floor(F.col(rank) / rows).cast("long")


def tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Members (token, tile, n, mid and other columns) of runs dealt to the pairs of tiles whose sizes are near enough.

    A tile meets itself and later ones up to the size band, so a member is repeated for each tile in reach, not for
    each other member.
    """
    tiles = members.groupBy("token", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("mid").alias("any"))
    other = tiles.select("token", F.col("tile").alias("tile2"), F.col("low").alias("low2"))
    met = tiles.join(other, "token").where(F.col("any") & (F.col("tile2") >= F.col("tile")) & (F.col("low2") * percent <= F.col("high") * 100)).select("token", "tile", "tile2")
    sides = met.select("token", F.col("tile").alias("t1"), F.col("tile2").alias("t2"), F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"))
    return members.join(sides, ["token", "tile"]).withColumn("second", F.col("tile") == F.col("t2")).drop("tile")


def in_several(index: DataFrame, bags: DataFrame) -> DataFrame:
    """The members (token, tile, n, key, mid, bag) of the runs of three rows or more that hold several bags."""
    members = index.select("token", "rank", "n", "key", "mid").join(bags.withColumnRenamed("node", "key"), "key", "left").withColumn("bag", F.coalesce("root", "key")).drop("root")
    mark = [F.bit_xor(F.xxhash64("key", "mid", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    runs = members.groupBy("token").agg((F.min("bag") != F.max("bag")).alias("several"), F.count("*").alias("size"), *mark).where("several AND size > 2")
    # Neighbouring shingles of a passage have the same members: the run of the least token stands for all of them.
    runs = runs.groupBy("size", "mark0", "mark1").agg(F.min("token").alias("token")).select("token")
    return members.join(runs, "token").withColumn("tile", tile_of("rank")).drop("rank")


def whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole pairs of tiles, many small ones at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        t = np.array([table.column(c).to_numpy() for c in ("token", "t1", "t2")])
        change = np.flatnonzero((t[:, 1:] != t[:, :-1]).any(axis=0))
        end = int(change[-1]) + 1 if len(change) else 0
        if end:
            yield table.slice(0, end)
        rest = table.slice(end).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each pair of tiles in the table, and whether it is a tile with itself."""
    t1, t2, token = (table.column(c).to_numpy() for c in ("t1", "t2", "token"))
    begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])])
    return begin, np.r_[begin[1:], len(token)], t1[begin] == t2[begin]


def folded(bits: list[bytes]):
    """A function of (rows, bytes): the bitmaps of rows as 64-bit words, folded to that many bytes; each row is kept at its own width and half of it."""
    size = np.array([len(b) for b in bits])
    place = np.empty(len(bits), np.int64)
    whole = {}
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        place[at] = np.arange(len(at))
        whole[w] = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w // 8)
    made: dict[tuple[int, int], np.ndarray] = {}

    def take(rows: np.ndarray, width: int, own: int) -> np.ndarray:
        if (own, width) not in made:
            made[own, width] = fold(whole[own], width // 8)
        return made[own, width][place[rows]]

    return size, take


def cross(percent: int):
    """Within each pair of tiles: a spanning forest of the pairs of different bags that sizes and bit counts allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pairs(batches):
            n, key = (table.column(c).to_numpy() for c in ("n", "key"))
            second, mid = (table.column(c).to_numpy(zero_copy_only=False) for c in ("second", "mid"))
            size, take = folded(table.column("bits").to_pylist())
            begin, end, alone = parts(table)
            run_end, same = np.repeat(end, end - begin), np.repeat(alone, end - begin)
            root = np.unique(table.column("bag").to_numpy(), return_inverse=True)[1]
            forest: list[tuple[int, int]] = []
            live, d = np.flatnonzero(mid & (same | ~second)), 0
            while len(live):
                d += 1
                live = live[live + d < run_end[live]]
                # Rows go by size, so once a partner is too large, later ones are as well.
                live = live[n[live + d] * percent <= n[live] * 100]
                tried = live[same[live] | second[live + d]]
                for k in range(0, len(tried), PAIRS):
                    x = tried[k : k + PAIRS]
                    x = x[root[x] != root[x + d]]
                    y = x + d
                    keep = np.zeros(len(x), bool)
                    for a, b in set(zip(size[x].tolist(), size[y].tolist())):
                        at = np.flatnonzero((size[x] == a) & (size[y] == b))
                        step = max(1, (8 << 20) // max(a, b))
                        for j in range(0, len(at), step):
                            i = at[j : j + step]
                            p, q = take(x[i], min(a, b), a), take(y[i], min(a, b), b)
                            most = np.minimum(n[x[i]] - count_bits(p & ~q), n[y[i]] - count_bits(q & ~p))
                            keep[i] = 100 * most >= percent * (n[x[i]] + n[y[i]] - most)
                    for i in x[keep].tolist():
                        if root[i] != root[i + d]:
                            forest.append((int(key[i]), int(key[i + d])))
                            root[root == root[i + d]] = root[i]
            if forest:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*forest)], ["a", "b"])

    return run


def intersected(percent: int, links: bool):
    """Pairs of tiles of a bag with arrays to (a, b, null): a spanning forest of the links; and, with links, (a, null, number of other rows linked)."""

    def pair_of_tiles(rows: list[np.ndarray], n, key, second, copies, same: bool) -> tuple[list, np.ndarray]:
        m = len(rows)
        values, ids = np.unique(np.concatenate(rows), return_inverse=True)
        at = np.r_[0, np.cumsum(n)]
        has = np.zeros(len(values), bool)
        root, forest, counts = np.arange(m), [], np.zeros(m, np.int64)
        for x in np.flatnonzero(same | ~second).tolist():
            y0 = x + 1 if same else m - int(second.sum())
            y1 = int(np.searchsorted(n, 100 * int(n[x]) // percent, side="right"))
            if y0 >= y1 or not links and (root[y0:y1] == root[x]).all():
                continue
            has[ids[at[x] : at[x + 1]]] = True
            both = np.add.reduceat(has[ids[at[y0] : at[y1]]], at[y0:y1] - at[y0], dtype=np.int64)
            has[ids[at[x] : at[x + 1]]] = False
            linked = np.flatnonzero(100 * both >= percent * (n[x] + n[y0:y1] - both)) + y0
            counts[x] += copies[linked].sum()
            counts[linked] += copies[x]
            for y in linked[root[linked] != root[x]].tolist():
                if root[y] != root[x]:
                    forest.append((int(key[x]), int(key[y])))
                    root[root == root[y]] = root[x]
        return forest, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pairs(batches):
            place = np.array([table.column(c).to_numpy() for c in ("token", "t1", "t2", "key")])
            again = (place[:, 1:] == place[:, :-1]).all(axis=0)
            if again.any():
                table = table.filter(pa.array(np.r_[True, ~again]))
            n, key, copies = (table.column(c).to_numpy() for c in ("n", "key", "copies"))
            second, arrays = table.column("second").to_numpy(zero_copy_only=False), table.column("shingles")
            out: list[tuple] = []
            for b, e, same in zip(*(x.tolist() for x in parts(table))):
                rows = [np.frombuffer(x, np.int64) for x in arrays.slice(b, e - b).to_pylist()]
                forest, counts = pair_of_tiles(rows, n[b:e], key[b:e], second[b:e], copies[b:e], same)
                out += [(x, y, None) for x, y in forest]
                if links:
                    out += [(int(key[b + i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "linked"])

    return run


def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most within the block."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS), spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES))


def join(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id of the class) and, if asked for, n_links (other rows that reach the threshold)."""
    with small_batches(docs.sparkSession):
        return _join(docs, percent, id_col, text_col, links)


def _join(docs: DataFrame, percent: int, id_col: str, text_col: str, links: bool) -> DataFrame:
    spark = docs.sparkSession
    first, second = shared_dir(spark), shared_dir(spark)  # tables that go once bags, and once links, are written
    told = cut(describe(docs, id_col, text_col), folder=first)
    own = told.where("kind = 0").drop("kind")
    common = told.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "key").limit(HOT_LIST).collect()
    tokens = np.array([r.key for r in common], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    places = np.array([r.n for r in common], np.int64)
    hot = spark.sparkContext.broadcast((tokens[order], places[order]))
    maps = cut(own.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("id").alias("id"), F.count("*").alias("copies")))
    own = cut(own.drop("bits"))
    index = cut(shared_index(docs, hot, percent, text_col), folder=first)

    pairs = [index.select(F.least("key", c).alias("a"), F.greatest("key", c).alias("b")).where("a <> b") for c in ("hub", "before")]
    # Forests are small whatever number of tasks finds them; rebalanced, they are written in few files.
    near = cut(bounded(pairs[0].unionAll(pairs[1]).distinct(), maps, percent).hint("rebalance"), folder=first)
    place = ["token", "t1", "t2"]
    members = cut(in_several(index, cut(components.label(near), folder=first)), folder=first)
    dealt = tile_pairs(members, percent).join(maps.select("key", "bits"), "key").select(*place, "second", "n", "key", "mid", "bag", "bits")
    more = cut(dealt.repartition(*place).sortWithinPartitions(*place, "n", "key").mapInArrow(cross(percent), "a long, b long").hint("rebalance"), folder=first)
    bags = cut(components.label(near.unionAll(more)).withColumnsRenamed({"node": "key", "root": "token"}))
    remove(spark, first)

    ranked = bags.join(maps.select("key", "n", "copies"), "key").withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("n", "key")) - 1)
    members = cut(ranked.select("token", tile_of("rank").alias("tile"), "n", "key", F.lit(True).alias("mid"), "copies"), folder=second)
    arrays = arrays_of(docs, maps, bags.select("key"), id_col, text_col)
    dealt = tile_pairs(members, percent).join(arrays, "key").select(*place, "second", "n", "key", "copies", "shingles")
    told_links = cut(dealt.repartition(*place).sortWithinPartitions(*place, "n", "key").mapInArrow(intersected(percent, links), "a long, b long, linked long").hint("rebalance"))
    remove(spark, second)

    classes = cut(components.label(told_links.where("b IS NOT NULL").select("a", "b")))
    roots = maps.select("key", "id", "copies").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    named = roots.join(least, "root").select("key", "component_id", "copies")
    if links:
        counts = told_links.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("linked").alias("linked"))
        named = named.join(counts, "key", "left").select("key", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    empty = F.col("n") == 0
    out = own.select("id", "n", F.when(~empty, F.col("key")).alias("key")).join(named, "key", "left")
    count = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *count)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c <= e.b)
SELECT doc_id, n::BIGINT AS n_shingles, c AS component_id, (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links FROM n JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) ON a = doc_id
"""
