"""Quality classifier: naive Bayes support vectors (NBSVM).

A text's features are indicators of hashed n-grams: words, word pairs, and, for patterns that single words don't show
(symbols stuck to words, shouting, one word again and again), pairs of word shapes together with the power of two that
their share of the text reaches. Each indicator is scaled by the log of the ratio of its smoothed counts in
the two classes, rows are scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate descent; a
logistic curve fitted to its margins gives the score.

Fitting uses at most `max_train` labelled rows, those of least crc32 of their id: a bounded sample, and the only thing that
reaches the driver. Scoring is one pass over whole texts with no shuffle.

Edge cases: a null, empty or wordless text is scored by the bias alone; several labels of one document count as their
mean, null labels not at all; with no labels, or of one class only, the score is the smoothed share of label 1;
repeated rows each get a row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import SPACED, U, Words, grams, mix, words

BUCKETS = 1 << 16
#: Byte classes of a shape: letters, digits, sentence marks, other symbols.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 0
_CLASS[48:58] = 1
_CLASS[[44, 46, 59]] = 2


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each row, and each row's bounds in them."""
    n = w.last - w.first
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    pair, ok = grams(w, 2)
    last, first = w.end - 1, w.start
    same = np.zeros(len(w.hash), U)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    shape = _CLASS[w.low[last]] + U(4) * _CLASS[w.low[np.maximum(last - 1, first)]] + U(16) * _CLASS[w.low[first]] + U(64) * same + U(128) * np.minimum(w.end - w.start, 3).astype(U)
    shapes = np.concatenate([shape, shape[:-1][ok] + U(512) * (shape[1:][ok] + U(1))])
    rows = np.concatenate([w.row, w.row[1:][ok]])
    key, count = np.unique(rows.astype(U) << U(20) | shapes, return_counts=True)
    share = np.log2(count / w.count[(key >> U(20)).astype(np.int64)]).astype(np.int64)
    binned = mix((key & U(0xFFFFF)) * U(64) + (-share).astype(U))
    bucket = np.concatenate([w.hash, pair[ok], binned]) & U(BUCKETS - 1)
    both = np.unique((np.concatenate([w.row, w.row[1:][ok], (key >> U(20)).astype(np.int64)]).astype(np.int64) << 16) | bucket.astype(np.int64))
    return both & (BUCKETS - 1), np.searchsorted(both, np.arange(n + 1) << 16)


@dataclass
class Model:
    weight: np.ndarray  # by bucket, ratios included
    square: np.ndarray  # of the ratios
    bias: float
    slope: float
    offset: float

    def score(self, w: Words) -> np.ndarray:
        f, head = features(w)
        cum = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[head])
        norm = np.sqrt(cum(self.square[f]))
        margin = cum(self.weight[f]) / np.where(norm > 1e-9, norm, 1.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of each indicator's smoothed, normalised counts in the two classes."""
    count = [np.bincount(np.concatenate([f for f, t in zip(rows, y, strict=True) if t == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + smooth for k in (-1, 1)]
    r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    r[(count[0] + count[1]) <= 2 * smooth + 1] = 0.0  # seen once: says nothing
    return r


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, dim: int, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum of c_i max(0, 1 - y_i (w x_i + b)), b as a feature of value 1."""
    w, b, alpha, rng = np.zeros(dim), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    q = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + b) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and offset of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([np.sum((p - t) * margin), np.sum(p - t)])
        v = p * (1 - p)
        h = np.array([[np.sum(v * margin * margin), np.sum(v * margin)], [np.sum(v * margin), np.sum(v)]]) + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = max(1e-3, a - d[0]), b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 20) -> Model:
    """y: 1 or -1. Each class gets half of the total cost."""
    zero = np.zeros(BUCKETS)
    if len(set(y.tolist())) < 2:
        share = (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    r = ratios(rows, y)
    scaled = [r[f] / max(1e-9, np.sqrt(r[f] @ r[f])) for f in rows]
    c = cost * len(y) / 2 / np.where(y > 0, np.sum(y > 0), np.sum(y < 0))
    w, b = dual_descent(rows, scaled, y, c, BUCKETS, epochs)
    margin = np.array([w[f] @ v + b for f, v in zip(rows, scaled, strict=True)])
    slope, offset = logistic(margin, y)
    return Model((w * r), r * r, b, slope, offset)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 6000) -> Model:
    """Fit on the labelled rows whose id's crc32 modulo 3 isn't 1; of more than max_train, those of least crc32."""
    known = labels.groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).alias("y")).filter("y is not null")
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    chosen = known.filter(crc % 3 != 1).orderBy(crc, "id").limit(max_train)  # so few that every task can hold it

    def run(batches):
        for b in batches:
            for w in words(b.column(0), SPACED):
                f, head = features(w)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(head.astype(np.int32)), pa.array(f.astype(np.int32))), b.column(1).slice(w.first, w.last - w.first), b.column(2).slice(w.first, w.last - w.first)], ["f", "y", "id"])

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y", "id")
    got = texts.mapInArrow(run, f"f array<int>, y double, id {kind}").toArrow().sort_by("id")
    if not got.num_rows:
        return fit([], np.zeros(0))
    y = np.where(got["y"].to_numpy() >= 0.5, 1, -1)
    flat, at = got["f"].combine_chunks(), 0
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    bounds, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return fit([values[bounds[i] : bounds[i + 1]].astype(np.int64) for i in range(len(y))], y)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for w in words(b.column(1), SPACED):
                out[w.first : w.last] = m.score(w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose text scores at least 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for w in words(b.column(b.schema.get_field_index(text)), SPACED):
                keep[w.first : w.last] = m.score(w) >= 0.5
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
