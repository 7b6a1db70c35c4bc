"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are entries themselves.
Second tier: a miss is merged bottom-up with a heap of candidate pairs over a doubly linked list of its bytes.
Both tiers sit behind a bounded memo of recent pre-tokens, so that each frequent one is resolved once a worker.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated rows and ids, and null ids, give a
row each; an empty table gives an empty result; extra columns are not read. Very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_or_empty

MEMO_LIMIT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash over a fixed set of byte strings by hash and displace.

    Keys fall into buckets by one hash; the largest buckets first choose a displacement that sends all their keys to
    free slots, and buckets of one key name a free slot outright. There are as many slots as keys.
    """

    def __init__(self, ids: dict[bytes, int]):
        self.n, self.m, self.seed = len(ids), max(1, len(ids) // 2), 0
        while not self._place(ids):
            self.seed += 1

    def _place(self, ids: dict[bytes, int]) -> bool:
        self.shift: list[int] = [0] * self.m
        self.slots: list[tuple[bytes, int] | None] = [None] * self.n
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key, self.seed)
            buckets.setdefault(h % self.m, []).append((h, key))
        alone = [(b, keys[0][1]) for b, keys in buckets.items() if len(keys) == 1]
        for b, keys in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(keys) == 1:
                break
            for d in range(4 * self.n):
                at = {self._slot(h, d) for h, _ in keys}
                if len(at) == len(keys) and all(self.slots[i] is None for i in at):
                    break
            else:
                return False
            self.shift[b] = d
            for h, key in keys:
                self.slots[self._slot(h, d)] = (key, ids[key])
        free = (i for i, x in enumerate(self.slots) if x is None)
        for (b, key), i in zip(alone, free, strict=False):
            self.shift[b] = ~i
            self.slots[i] = (key, ids[key])
        return True

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 32) + d * ((h & 0xFFFFFFFF) | 1)) % self.n

    def get(self, key: bytes) -> int:
        """The key's id, or -1 if it is not in the set."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[h % self.m]
        found = self.slots[~d if d < 0 else self._slot(h, d)]
        return found[1] if found[0] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of lowest rank is merged first, the leftmost of equals, until none is left."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts at i ends; the next part starts there
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        j = end[i]
        alive[j] = 0
        end[i] = e
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec(dict):
    """Encoder and decoder; as a dict it is the bounded memo from pre-token to ids."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str, memo: int = MEMO_LIMIT):
        super().__init__()
        self.ranks, self.whole, self.memo = ranks, whole, memo
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}

    def __missing__(self, token: str) -> list[int]:
        if len(self) >= self.memo:
            self.clear()
        piece = token.encode()
        i = self.whole.get(piece)
        ids = self[token] = [i] if i >= 0 else merge(piece, self.ranks)
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in map(self.__getitem__, self.split(text)):
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec_of(shared) -> Codec:
    """One codec a worker process for the broadcast vocabulary."""
    name, *parts = shared.value
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(*parts)
    return _codecs[name]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns id_col, those to keep, ids (array of int), decoded (binary, from the ids) and exact (decoded is the text).

    The vocabulary is read by the driver and broadcast: its size is that of the tokenizer file, whatever the corpus.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast(((ranks_path, len(ranks), pattern), ranks, PerfectHash(ranks), pattern))
    kept = F.struct(*keep) if keep else F.lit(0)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), kept.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in chunks(batches, "text"):
            ids, counts, decoded, exact = [], [0], [], []
            for text in batch.column("text").to_pylist():
                own = codec.encode(text)
                ids.append(np.array(own, "<i4"))
                counts.append(counts[-1] + len(own))
                decoded.append(codec.decode(own))
                exact.append(decoded[-1] == text.encode())
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("kept"), lists, pa.array(decoded, pa.binary()), pa.array(exact, pa.bool_())], ["key", "kept", "ids", "decoded", "exact"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    out = source.mapInArrow(run, f"key {kinds['key']}, kept {kinds['kept']}, ids array<int>, decoded binary, exact boolean")
    return out.select(F.col("key").alias(id_col), *(F.col(f"kept.{c}").alias(c) for c in keep), "ids", "decoded", "exact")


def query(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
