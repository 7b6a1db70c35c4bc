"""Repeated byte strings of LENGTH bytes, found by suffix sorting with a difference cover.

What is asked: the bytes covered by a string of LENGTH bytes that also starts in a document of a smaller id.

1. Anchors. Every window of LENGTH bytes names one of its GRAM-byte grams, the one of least hash (the leftmost of
   equals). Equal windows name equal grams, so only windows whose gram occurs in two documents can repeat.
2. Pieces. Neighbouring windows with one anchor form a piece; pieces of shared anchors are dealt out by anchor, so all
   windows that could be equal meet in one task, and nothing else has to. A piece that a task has already seen in a
   smaller document goes without its bytes, so a text copied everywhere is dealt out a few times for each task.
3. Suffix order. Equal pieces of an anchor sort next to each other; the smallest document settles the others. The
   suffixes of the different pieces are sorted with a difference cover modulo 3: the triples at sample positions are
   sorted and named, the names are sorted by recursion, the remaining suffixes are sorted by their first character and
   the following sample's rank, and the two are merged. Neighbours in the order that share LENGTH bytes form a class,
   and its smallest document settles the others' windows.
4. Settled windows come back to their documents as intervals, which are united and cut out.

Edge cases: null texts are empty; documents shorter than LENGTH bytes keep all; a null id neither removes nor is
removed from; rows of one id are never compared with each other; repeated rows give a row each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, text_or_empty
from .shingles import buffers, mix, powers

LENGTH = 50
GRAM = 16
SLICE = 128 << 20  # shared anchors of a pass over the texts
FILTER_BITS = 29  # 64 MB in a worker, four bits an anchor of a full pass at least
SEEN = 300_000
SEGMENT = 23  # bits of a filter's segment, a power of two
BROADCAST_SPANS = 1 << 20
SORT_BYTES = 1 << 17  # what a processor's cache holds as ranks
_PLACE = np.uint64((1 << 26) - 1)


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, last window, hash of the anchor).

    Places within _PLACE are packed with hashes, so longer data is taken in stretches that overlap by a window less a byte.
    """
    most = int(_PLACE) + 1
    if len(data) <= most:
        return stretch(data, offsets, length)
    parts = []
    for b in range(0, len(data) - length + 1, most - length + 1):
        k, first, last, h = stretch(data[b : b + most], np.clip(offsets - b, 0, min(most, len(data) - b)), length)
        parts.append((k, first + b, last + b, h))
    return tuple(np.concatenate(x) for x in zip(*parts))


def stretch(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of windows of data whose places fit into _PLACE."""
    n, many = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    least = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= many:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < many:
        least = np.minimum(least[: len(least) - many + width], least[many - width :])
    at = (least & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + length <= offsets[1:][text]
    start = np.flatnonzero(valid)
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    new = np.r_[True, (at[start[1:]] != at[start[:-1]]) | (start[1:] != start[:-1] + 1) | (text[start[1:]] != text[start[:-1]])]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:] - 1, len(start) - 1]
    return text[start[begin]], start[begin], start[last], h[at[start[begin]]]


def order_of(columns: list[np.ndarray], kind: str | None = None) -> np.ndarray:
    """An order by several columns of whole numbers >= 0; they are packed into one key where 63 bits hold it."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c, b in zip(columns[1:], bits[1:]):
        key = key << b | c
    return np.argsort(key, kind=kind)


def ranks_of(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their columns, and the name of each row: its dense place, equal for equal rows."""
    order = order_of(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return order, names


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers >= 1 by the difference cover {1, 2} modulo 3; the end sorts before all."""
    n = len(t)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # with the place n, so that the two never run together
    s = np.concatenate([t, np.zeros(6, t.dtype)])
    order, names = ranks_of([np.concatenate([s[1 + k : n + 1 + k : 3], s[2 + k : n + 1 + k : 3]]) for k in range(3)])
    if names.max() + 1 < len(names):
        order = suffix_order(names + 1)
    rank = np.zeros(n + 6, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    rank[1 : n + 1 : 3], rank[2 : n + 1 : 3] = place[: len(ones)], place[len(ones) :]
    sampled = np.concatenate([ones, twos])[order]
    first = order < len(ones)
    if sampled[0] == n:  # the end sorts before all
        sampled, first = sampled[1:], first[1:]
    rest = np.arange(0, n, 3)
    rest = rest[order_of([s[0:n:3], rank[1 : n + 1 : 3]])]
    # Merge: the place of each remaining suffix among the sampled ones, by the keys that the cover makes comparable.
    ahead = np.arange(len(rest))
    for own, ahead_by in ((sampled[first], 1), (sampled[~first], 2)):
        at = np.concatenate([own, rest])
        mixed = order_of([*(s[at + k] for k in range(ahead_by)), rank[at + ahead_by]], "stable")  # two runs in order already
        is_rest = mixed >= len(own)
        ahead += np.cumsum(~is_rest)[is_rest]  # sampled suffixes of this kind before each remaining one, in order
    out, taken = np.empty(n, np.int64), np.zeros(n, bool)
    out[ahead], taken[ahead] = rest, True
    out[~taken] = sampled
    return out


def settle(pieces: list[bytes], doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Of different pieces with their smallest documents: (piece, from, to) of the bytes that repeat a smaller one's."""
    lengths = np.array([len(p) for p in pieces])
    begin = np.cumsum(np.r_[0, lengths[:-1] + 1])
    n = int(begin[-1] + lengths[-1] + 1)
    raw = np.frombuffer(b"\0".join(pieces) + bytes(9), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)
    ends = begin + lengths
    # A piece ends with a number of its own, so no suffix is compared beyond its piece; bytes count from there.
    text = raw[:n].astype(np.int64) + len(pieces) + 1
    text[ends] = np.arange(1, len(pieces) + 1)
    order = suffix_order(text)
    order = order[order + length <= ends[owner[order]]]
    if len(order) < 2:
        return []
    # Eight bytes at a time; the last eight may overlap those before.
    width = min(8, length)
    eight = np.ndarray((n,), np.uint64, raw, strides=(1,))
    mask = np.uint64((1 << 8 * width) - 1)
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, length - width, width), length - width]:
        at = np.flatnonzero(same)
        if not len(at):
            break
        same[at] = (eight[order[at] + k] ^ eight[order[at + 1] + k]) & mask == 0
    group = np.cumsum(np.r_[0, ~same])
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[owner[order]])
    hit = np.sort(order[least[group] < doc[owner[order]]])
    if not len(hit):
        return []
    new = np.r_[True, (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] > hit[:-1] + length)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(hit) - 1]
    own = owner[hit[first]]
    return list(zip(own.tolist(), (hit[first] - begin[own]).tolist(), (hit[last] - begin[own] + length).tolist()))


def repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text), start, stop: intervals of bytes that repeat a smaller document's; they may overlap."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of a chunk of texts with the smallest and largest id that have them."""
        for batch in chunks(batches, "text", 1 << 20):
            k, _, _, h = windows(*buffers(batch.column("text")), length)
            if not len(h):
                continue
            order = np.argsort(h)
            h, own = h[order], batch.column("id").to_numpy()[k[order]]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            columns = [h[head].view(np.int64), np.minimum.reduceat(own, head), np.maximum.reduceat(own, head)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "low", "high"])

    texts = source.select("id", "text")
    shared = cut(texts.mapInArrow(anchors, "anchor long, low long, high long").groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor"))
    count = shared.count()
    passes = max(1, -(-count // max(SLICE, 64)))
    found = []
    for part in range(passes):
        own = shared.where(F.pmod("anchor", F.lit(passes)) == part) if passes > 1 else shared
        wanted = spark.sparkContext.broadcast(filter_of(own, -(-count // passes)))
        rows = source.mapInArrow(pieces(length, wanted, passes, part), PIECES)
        out = rows.repartition("anchor").sortWithinPartitions("anchor", "mark", "id").mapInArrow(sorter(length), "id long, hash long, start long, stop long")
        found.append(cut(out) if passes > 1 else out)
    return reduce(DataFrame.unionAll, found)


def places(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each anchor in a filter of 2^bits bits; both lie in one segment of 2^SEGMENT bits."""
    h = mix(anchors)
    low = np.uint64((1 << min(bits, SEGMENT)) - 1)
    return h & np.uint64((1 << bits) - 1), h & np.uint64((1 << bits) - 1) & ~low | h >> np.uint64(32) & low


def filter_of(anchors: DataFrame, count: int) -> np.ndarray:
    """Bytes of a filter that holds every anchor (and lets a few others by): 16 bits each and more, at most 2^FILTER_BITS in all.

    Its segments are filled in tasks; the driver puts them next to each other.
    """
    bits = min(FILTER_BITS, max(10, (16 * count).bit_length()))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = places(batch.column(0).to_numpy().view(np.uint64), bits)
            low = np.uint64((1 << SEGMENT) - 1)
            columns = [(first >> np.uint64(SEGMENT)).astype(np.int32), (first & low).astype(np.int32), (second & low).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["segment", "first", "second"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, *own = (batch.column(c).to_numpy() for c in ("segment", "first", "second"))
            for i in np.unique(segment).tolist():
                flags = made.setdefault(i, np.zeros(1 << min(bits, SEGMENT) - 3, np.uint8))
                for at in own:
                    at = at[segment == i]
                    np.bitwise_or.at(flags, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for i, flags in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([flags.tobytes()], pa.binary())], ["segment", "flags"])

    dealt = anchors.mapInArrow(segments, "segment int, first int, second int").repartition("segment").mapInArrow(fill, "segment int, flags binary")
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in dealt.toLocalIterator():
        begin = r.segment << SEGMENT - 3
        out[begin : begin + len(r.flags)] = np.frombuffer(r.flags, np.uint8)
    return out


def passes_filter(anchors: np.ndarray, flags: np.ndarray) -> np.ndarray:
    first, second = places(anchors, int(len(flags)).bit_length() + 2)
    found = flags[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1
    return (found & flags[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8)).astype(bool)


PIECES = "anchor long, mark long, piece binary, id long, hash long, start long, stop long"


def pieces(length: int, wanted, passes: int = 1, part: int = 0):
    """Texts to the pieces of their shared anchors (of a part of them); a piece that the task has seen in a smaller document goes without its bytes.

    The few anchors of one document that the filter lets by cost their rows and change nothing.
    """

    hash_of = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}  # beyond SEEN it starts anew after a chunk, which only sends more bytes
        for batch in chunks(batches, "text", 1 << 20):
            data, offsets = buffers(batch.column("text"))
            k, first, last, h = windows(data, offsets, length)
            if not len(h):
                continue
            keep = passes_filter(h, wanted.value)
            if passes > 1:
                keep &= h.view(np.int64) % passes == part
            keep = np.flatnonzero(keep)
            if not len(keep):
                continue
            k, first, stop = k[keep], first[keep], last[keep] + length
            raw, own = data.tobytes(), batch.column("id").to_numpy()[k]
            found = [raw[a:b] for a, b in zip(first.tolist(), stop.tolist())]
            marks = [hash_of(x) for x in found]
            for i, (mark, doc) in enumerate(zip(marks, own.tolist())):
                least = seen.get(mark)
                if least is not None and least < doc:
                    found[i] = None
                else:
                    seen[mark] = doc
            if len(seen) >= SEEN:
                seen.clear()
            mark = np.array(marks, np.uint64).view(np.int64)
            columns = [h[keep].view(np.int64), mark, pa.array(found, pa.binary()), own, batch.column("hash").to_numpy()[k], first - offsets[k], stop - offsets[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "mark", "piece", "id", "hash", "start", "stop"])

    return run


def sorter(length: int):
    """Rows sorted by (anchor, mark, id) to settled intervals.

    A run of one mark is one string: its first document (whose row always has the bytes) settles larger ones. Of an anchor with two or more different
    pieces, one row per piece (and any more of the piece's first document) goes on to the suffix order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (None, None, 0)  # anchor, mark and first document of the run under way
        held: list[tuple] = []  # rows of the anchor under way: piece, document, hash, start
        different = 0
        ready: list[tuple] = []
        size = 0

        def packed(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "hash", "start", "stop"])

        def sort() -> list[tuple]:
            found = settle([r[0] for r in ready], np.array([r[1] for r in ready], np.int64), length)
            return [(ready[i][1], ready[i][2], ready[i][3] + a, ready[i][3] + b) for i, a, b in found]

        def anchor_ends() -> None:
            nonlocal held, different, ready, size
            if different > 1:
                ready += held
                size += sum(len(r[0]) for r in held)
            held, different = [], 0

        def rows_at(batch: pa.RecordBatch, at: np.ndarray) -> list[tuple]:
            taken = batch.select(["piece", "id", "hash", "start"]).take(pa.array(at))
            return list(zip(*(c.to_pylist() for c in taken.columns)))

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, mark, doc, h, start, stop = (batch.column(c).to_numpy() for c in ("anchor", "mark", "id", "hash", "start", "stop"))
            goes_on = state[0] is not None and (anchor[0], mark[0]) == state[:2]
            head = np.r_[not goes_on, (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])]
            at = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
            first = np.where(at >= 0, doc[np.maximum(at, 0)], state[2])
            over = doc > first
            if over.any():
                yield packed([doc[over], h[over], start[over], stop[over]])
            kept = np.flatnonzero(~over)
            begins = np.flatnonzero(np.r_[anchor[0] != state[0], anchor[1:] != anchor[:-1]])
            bounds = np.unique(np.r_[0, begins, len(anchor)])
            heads = np.cumsum(np.r_[0, head])
            several = heads[bounds[1:]] - heads[bounds[:-1]] > 1
            segment = np.repeat(np.arange(len(several)), np.diff(bounds))[kept]
            edge = (segment == 0) | (segment == len(several) - 1)  # anchors that may go on in another batch
            if len(begins) and begins[0] == 0:
                anchor_ends()
            for i in dict.fromkeys((0, len(several) - 1)):
                if i:
                    anchor_ends()
                held += rows_at(batch, kept[segment == i])
                different += int(heads[bounds[i + 1]] - heads[bounds[i]])
            inner = rows_at(batch, kept[~edge & several[segment]])
            ready += inner
            size += sum(len(r[0]) for r in inner)
            if size >= SORT_BYTES:
                out = sort()
                ready, size = [], 0
                if out:
                    yield packed(list(zip(*out)))
            state = (anchor[-1], mark[-1], int(first[-1]))
        anchor_ends()
        if ready:
            out = sort()
            if out:
                yield packed(list(zip(*out)))

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, kept (binary) and spans (removed runs: start, stop) of every document."""
    text = text_or_empty(text_col)
    found = repeated(docs, length, id_col, text_col)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted intervals of a task to maximal runs; only the run under way is held."""
        last = None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and row[:2] == last[:2] and row[2] <= last[3]:
                    last = (*last[:3], max(last[3], row[3]))
                else:
                    if last is not None:
                        out.append(last)
                    last = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["id", "hash", "start", "stop"])
                out = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last], ["id", "hash", "start", "stop"])

    runs = found.repartition("id", "hash").sortWithinPartitions("id", "hash", "start", "stop").mapInArrow(united, "id long, hash long, start long, stop long")
    spans = cut(runs.groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")))
    source = docs.select(F.col(id_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("data"))
    # Spans are a few numbers for each document that repeats something; beyond the bound the texts are joined by shuffle.
    few = (spans.agg(F.sum(F.size("spans") + 2)).first()[0] or 0) <= BROADCAST_SPANS
    joined = source.join(F.broadcast(spans) if few else spans, ["id", "hash"], "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    joined = joined.withColumn("spans", F.coalesce("spans", none))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda x: x["stop"]))
    starts = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length("data").cast("bigint")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("data"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    whole = F.when(F.size("spans") == 0, F.col("data")).otherwise(F.unhex(F.array_join(F.transform(kept, F.hex), "")))
    return joined.select(F.col("key").alias(id_col), F.length("data").cast("long").alias("n_bytes"), whole.alias("kept"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
