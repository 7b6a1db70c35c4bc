"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are taken from the whole text alone (never from language, source, id or labels). They are standardised and
sent through D random Fourier features, which approximate a Gaussian kernel; each task sums its part of the normal
equations, the sums are added by index, and the driver solves a system of D + 1 unknowns. The raw scores of a
set-aside part of the fitting rows give the isotonic steps (pool adjacent violators), so scores read as chances.

Fitting takes at most FIT_ROWS labelled rows, those of the smallest hash of the id; every row is scored.

Edge cases: null and empty texts get the statistics of an empty text and a score like any other; rows without a label
are scored only; null labels are ignored and several labels of one id are averaged; without any usable label every
score is 0.5; repeated rows and ids give a row each; null ids are scored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, text_or_empty
from .shingles import buffers, words

FIT_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-3
SEED = 20240501
_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "stop": np.isin(_BYTE, list(b".,;:?'")),
    "symbol": np.isin(_BYTE, list(b"!\"#$%&()*+-/<=>@[\\]^_`{|}~")),
    "space": np.isin(_BYTE, [9, 10, 11, 12, 13, 32]),
    "line": _BYTE == 10,
    "wide": _BYTE >= 128,
}
STATISTICS = 15


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS numbers per text."""
    data, offsets = buffers(texts)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    count = {}
    for name, table in _CLASSES.items():
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        count[name] = np.diff(total[offsets]).astype(float)
    h, at = words(data, offsets)
    n = np.diff(at)
    some = np.maximum(n, 1).astype(float)

    def shares(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(h) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[at]) / some

    def again(gap: int) -> np.ndarray:
        same = np.zeros(len(h), bool)
        same[gap:] = h[gap:] == h[:-gap] if len(h) > gap else False
        return shares(same)

    different = np.array([len(np.unique(h[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], float)
    letters = np.maximum(count["upper"] + count["lower"] + count["wide"], 1)
    return np.column_stack([
        np.log1p(n), (size - count["space"]) / some, count["upper"] / letters, count["digit"] / size, count["stop"] / some, count["symbol"] / some, count["symbol"] / size,
        count["space"] / size, np.log1p(count["line"]), np.log1p(some / (1 + count["line"])), count["wide"] / letters, again(1), again(2), different / some, np.log1p(different) / np.log1p(some),
    ])


class Model:
    """Standardised statistics to a calibrated score."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit, as points to interpolate between: the middle and level of each block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # level, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            level, weight, at = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + level * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += at
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model | None:
    """The model from at most `rows` labelled documents outside the held-out part; None without usable labels."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # Bounded by `rows`, so the join never moves texts.
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(own), "id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            stats = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(stats.tolist(), pa.list_(pa.float64())), batch.column("label"), batch.column("part")], ["x", "label", "part"])

    parted = source.select("text", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int").alias("part"))
    fitted = cut(parted.mapInArrow(described, "x array<double>, label double, part int"))
    at = [F.col("x")[i] for i in range(STATISTICS)]
    said = fitted.agg(*(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at), F.min("label"), F.max("label")).first()
    if said[0] is None:
        return None
    model = Model(np.array(said[:STATISTICS]), np.array(said[STATISTICS : 2 * STATISTICS]))
    if said[-1] == said[-2]:
        model.y = np.array([said[-1]])
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(batch.column("x").flatten().to_numpy().reshape(-1, STATISTICS))
            y = batch.column("label").to_numpy()
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "value"])

    parts = fitted.where("part <> 0").select("x", "label").coalesce(16).mapInArrow(sums, "i long, value double")
    total = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for r in parts.groupBy("i").agg(F.sum("value").alias("value")).collect():
        total[r.i] = r.value
    total = total.reshape(FEATURES + 1, FEATURES + 2)
    count = max(1.0, total[-1, FEATURES])
    penalty = RIDGE * count * np.eye(FEATURES + 1) / FEATURES
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    rest = fitted.where("part = 0").select("x", "label").collect()  # a quarter of `rows`
    if rest:
        model.x, model.y = isotonic(model.raw(np.array([r.x for r in rest])), np.array([r.label for r in rest]))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = F.struct(*keep) if keep else F.lit(0)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), held_out(id_col).alias("held_out"), kept.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            scores = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "held_out", "kept")), pa.array(scores)], ["id", "held_out", "kept", "score"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, kept {source.schema['kept'].dataType.simpleString()}, score double")
    columns = [F.col(f"kept.{c}").alias(c) for c in keep]
    return out.select(F.col("id").alias(id_col), *columns, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
