"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are cut into segments. For a segment with means m, n and deviations s, t (root of the summed squared
differences from the mean) of its length L, the inner product of the two parts lies within L*m*n +- s*t (Cauchy-Schwarz
on the differences); equivalently the squared distance is at least L*(m-n)^2 + (s-t)^2. Summed over the segments this
bounds a candidate's score from above. Levels go from one segment to many; after each, only pairs whose bound reaches
the query's current k-th score go on, and the survivors' scores are computed exactly. Bounds are taken along the
principal axes of SEED vectors, which leaves inner products as they are and gathers what vectors have in common in the
first axes; the last level has most axes as segments of their own. The same vectors give each query a first k-th score,
so that no task starts from nothing. Any SEED vectors give right results; they decide only how much is pruned.

Distribution. Queries are cut into blocks of bounded bytes, each broadcast in turn to one pass over all candidates; a
pass keeps at most k rows per query and task, which a partial aggregation merges. No vector is left out.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as candidate or query;
repeated vectors and scores are ordered by id, smaller first; fewer than k candidates give fewer rows; null ids take
no part; vectors of different lengths are compared only with those of their own length; extra columns are not read.
Components are whole numbers of at most 2^63; scores are exact while they stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = ((0, 1), (0, 4), (0, 2), (0.75, 1))  # share of leading axes that stand alone; axes to a segment of the rest (1: one segment in all)
SEED = 4096
BLOCK_BYTES = 16 << 20
ROWS = 4096


def cuts(d: int, level: tuple[float, int]) -> np.ndarray:
    """The bounds of a level's segments over d axes."""
    alone, wide = int(level[0] * d), level[1]
    rest = np.arange(alone, d, wide) if wide > 1 else np.array([alone])
    return np.r_[np.arange(alone), rest, d]


def statistics(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row the scaled means sqrt(L)*m of the segments, then their deviations; a product of two rows is the bound."""
    length = np.diff(bounds).astype(float)
    means = np.add.reduceat(x, bounds[:-1], axis=1) / length
    squares = np.add.reduceat((x - np.repeat(means, length.astype(int), axis=1)) ** 2, bounds[:-1], axis=1)
    return np.concatenate([means * np.sqrt(length), np.sqrt(squares)], axis=1)


def principal(seeds: np.ndarray) -> np.ndarray:
    """Axes of the vectors as columns, the heaviest first; an orthogonal matrix whatever the vectors are."""
    d = seeds.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        square = seeds.T @ seeds
    if not len(seeds) or not np.isfinite(square).all():
        return np.eye(d)
    return np.linalg.eigh(square)[1][:, ::-1]


def first_scores(ids: np.ndarray, x: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Per query its k-th best score among the seeds other than itself, -inf where there are fewer."""
    out = np.full(len(ids), -np.inf)
    if len(seeds) >= k:
        for a in range(0, len(ids), 1024):
            score = np.where(ids[a : a + 1024, None] == seed_ids, -np.inf, x[a : a + 1024] @ seeds.T)
            out[a : a + 1024] = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    return out


class Block:
    """A block of query vectors of one length, with their statistics, first scores and best scores so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, first: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.x, self.first, self.turn, self.k = ids, vectors, first, turn, k
        turned = vectors @ turn
        bounds = {len(c): c for c in (cuts(vectors.shape[1], x) for x in LEVELS)}
        self.levels = [(c, statistics(turned, c)) for _, c in sorted(bounds.items())]
        self.norm = np.linalg.norm(vectors, axis=1)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take in a block of candidates."""
        near = np.maximum(self.scores[:, -1], self.first)
        if np.isneginf(near).any():  # nothing to compare with yet: score all
            q, c = np.divmod(np.arange(len(self.ids) * len(ids)), len(ids))
        else:
            q = c = None
            least = near - 1e-9 * self.norm * np.linalg.norm(x, axis=1).max() - 1e-6
            turned = x @ self.turn
            for bounds, level in self.levels:
                own = statistics(turned, bounds)
                if q is None or len(q) > level.shape[0] * len(own) // 4:
                    keep = level @ own.T >= least[:, None]
                    if q is not None:
                        before = np.zeros(keep.shape, bool)
                        before[q, c] = True
                        keep &= before
                    q, c = np.nonzero(keep)
                else:
                    bound = np.empty(len(q))
                    for a in range(0, len(q), 1 << 16):
                        bound[a : a + (1 << 16)] = np.einsum("ij,ij->i", level[q[a : a + (1 << 16)]], own[c[a : a + (1 << 16)]])
                    keep = bound >= least[q]
                    q, c = q[keep], c[keep]
        other = self.ids[q] != ids[c]
        q, c = q[other], c[other]
        score = np.empty(len(q))
        for a in range(0, len(q), 1 << 16):
            score[a : a + (1 << 16)] = np.einsum("ij,ij->i", self.x[q[a : a + (1 << 16)]], x[c[a : a + (1 << 16)]])
        keep = score >= near[q]
        self._merge(q[keep], ids[c[keep]], score[keep])

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(q)
        if not len(touched):
            return
        q = np.concatenate([q, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.found[touched].ravel()])
        score = np.concatenate([score, self.scores[touched].ravel()])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        take = starts[:, None] + np.arange(self.k)
        self.scores[touched], self.found[touched] = score[take], ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(~np.isneginf(self.scores))
        return self.ids[q], self.found[q, r], self.scores[q, r].astype(np.int64)


def quantised(column: str, scale: int):
    """floor(scale * x) of each component, as whole numbers in double."""
    return F.transform(F.col(column), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))


def matrices(ids: list, flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length."""
    ids, ends = np.asarray(ids, np.int64), np.cumsum(lengths)
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        yield ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)]


def gathered(rows: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Collected rows (id, v) as ids and vectors by length."""
    return list(matrices([r.id for r in rows], np.array([x for r in rows for x in r.v], float), np.array([len(r.v) for r in rows]))) if rows else []


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best other rows by the whole-number inner product.

    is_query is a Column condition. The driver holds one block of queries at a time (BLOCK_BYTES); the number of passes
    grows with the queries, and each pass reads the candidates once.
    """
    spark = vectors.sparkSession
    whole = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = rows.where("asks").drop("asks")
    size = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    seeds = {x.shape[1]: (ids, x) for ids, x in gathered(rows.select("id", "v").limit(SEED).collect())} if blocks else {}
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        kept = []
        for ids, x in gathered(own):
            seed_ids, seed = seeds.get(x.shape[1], (np.empty(0, np.int64), np.empty((0, x.shape[1]))))
            kept.append((ids, x, first_scores(ids, x, seed_ids, seed, k), principal(seed)))
        found = pass_over(rows.drop("asks"), spark.sparkContext.broadcast(kept), k)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pass_over(rows: DataFrame, kept, k: int) -> DataFrame:
    """The k best candidates of each task for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[Block]] = {}
        for ids, x, first, turn in kept.value:
            own[x.shape[1]] = [Block(ids[a : a + 1024], x[a : a + 1024], first[a : a + 1024], turn, k) for a in range(0, len(ids), 1024)]
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                v = part.column("v")
                for ids, x in matrices(part.column("id").to_pylist(), v.flatten().to_numpy(), v.value_lengths().to_numpy()):
                    for block in own.get(x.shape[1], []):
                        at = 0
                        while at < len(ids):
                            step = 256 if np.isneginf(np.maximum(block.scores[:, -1], block.first)).any() else ROWS
                            block.add(ids[at : at + step], x[at : at + step])
                            at += step
        for block in (b for x in own.values() for b in x):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in block.rows()], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
