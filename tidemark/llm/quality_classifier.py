"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document is described by ``STATISTICS`` numbers taken of its whole text.  They are
standardised on the training rows and mapped to ``FEATURES`` random Fourier features
sqrt(2/D) cos(w x + b), which approximate a Gaussian kernel.  The normal equations are
summed over ``PARTS`` partitions of the first half of the training rows and solved on
the driver; the other half calibrates the raw scores by isotonic regression (pool
adjacent violators), read off by interpolation.

The training rows are a bounded sample of the labelled ones: about ``SAMPLE_ROWS``,
picked by a hash of the id (all, where there are fewer).  Their ids are broadcast, so
no text is shuffled.  Scoring is one pass over the documents.

Defined results: null and empty texts are described by zeros and scored like any
other; labels with a null quality or id are ignored; ids labelled twice count twice;
with no usable labels every score is 0.5; with one class alone every score is that
class; repeated rows get equal scores; ids may be of any type; very long texts take
time and memory in proportion; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, lowered, run_hashes, store, trimmed, window_hashes

SAMPLE_ROWS = 20_000
FEATURES = 192
GAMMA = 0.15
RIDGE = 1e-2
PARTS = 8
SEED = 20240607
THRESHOLD = 0.3
STATISTICS = ("words", "word_length", "upper", "digit", "symbol", "bar", "stop", "shout", "wide", "fresh_words", "fresh_windows", "stutter", "lines", "fresh_lines")

_KINDS = np.full(256, 7, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>_=+~^@/\\", b"|", b".,;:'-", b"!?")):
    _KINDS[list(_chars)] = _k
_KINDS[192:] = 6


def statistics(block: Block) -> np.ndarray:
    """One row for each document of a block (not lower-cased)."""
    starts, ends = block.words()
    cuts = block.bounds(starts)
    low = lowered(block)
    hashes = run_hashes(low.buf, starts, ends)
    windows = window_hashes(hashes, 3)
    lens = ends - starts
    kinds = _KINDS[block.buf]
    out = np.zeros((block.docs, len(STATISTICS)))
    for i in range(block.docs):
        a, b = int(cuts[i]), int(cuts[i + 1])
        n = b - a
        if not n:
            continue
        chars = float(lens[a:b].sum())
        lo, hi = int(block.offsets[i]), int(block.offsets[i + 1])
        counts = np.bincount(kinds[lo:hi], minlength=8) / chars
        h = hashes[a:b]
        lines = [x for x in low.bytes(i).split(b"\n") if x.strip()]
        out[i] = (
            np.log1p(n), chars / n, counts[0], counts[1], counts[2], counts[3], counts[4], counts[5], counts[6],
            len(np.unique(h)) / n, len(np.unique(windows[a : b - 2])) / (n - 2) if n > 2 else 1.0, (h[1:] == h[:-1]).mean() if n > 1 else 0.0,
            np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        )
    return out


class Model:
    """Standardisation, random features, weights and the calibration's knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0) if len(x) else np.zeros(0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step fit of y on x: one at the middle of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order], y[order]):
        pools.append([float(b), 1.0, float(a)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _described(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named and x array<double>."""
    kinds = dict(docs.dtypes)
    kinds["text"] = "string"

    def run(batches):
        for batch in batches:
            rows = [statistics(b) for b in blocks(batch.column(batch.num_columns - 1))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cells], names=[*keep, "x"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", x array<double>")


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """Learns ``quality`` (0 or 1) of the labels for which ``usable``, a function of doc_id, holds."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null").where(usable)
    n = known.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000))
    sample = known.where(part < int(min(1.0, SAMPLE_ROWS / n) * 1_000_000)).withColumn("half", (part % 2).cast("int"))
    # About SAMPLE_ROWS rows of 20 bytes, whatever the number of labels.
    rows = F.broadcast(sample.select(F.col("doc_id").alias("labelled"), "y", "half"))
    joined = docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("labelled"))
    table = store(_described(joined, "y", "half").repartition(PARTS)).df
    if table.isEmpty():
        return None

    def moments(batches):
        s = np.zeros((3, len(STATISTICS)))
        for batch in batches:
            x = _matrix(batch, 2)
            s += np.vstack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    count, total, square = sum(np.frombuffer(bytes(r["s"])).reshape(3, -1) for r in table.coalesce(PARTS).mapInArrow(trimmed(moments), "s binary").collect())
    mean = total / count
    model = Model(mean, np.sqrt(np.maximum(square / count - mean**2, 1e-6)))

    def normal(batches, model=model):
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            use = batch.column(1).to_numpy(zero_copy_only=False) == 0
            f = model.features(_matrix(batch, 2)[use])
            y = batch.column(0).to_numpy(zero_copy_only=False)[use]
            a += f.T @ np.hstack([f, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["s"])

    a = sum(np.frombuffer(bytes(r["s"])).reshape(FEATURES + 1, -1) for r in table.coalesce(PARTS).mapInArrow(trimmed(normal), "s binary").collect())
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    model.beta = np.linalg.solve(a[:, :-1] + ridge, a[:, -1])
    held = table.where("half = 1").select("y", "x").collect()
    if not held:
        held = table.select("y", "x").collect()
    held = sorted(held, key=lambda r: (r["x"], r["y"]))
    model.knots = isotonic(model.raw(np.array([r["x"] for r in held])), np.array([r["y"] for r in held]))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(statistics(b)) for b in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    return narrow.mapInArrow(trimmed(run), f"doc_id {dict(narrow.dtypes)['doc_id']}, score double")
