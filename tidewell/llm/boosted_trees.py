"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training reads a bounded sample of labelled documents (``SAMPLE`` rows in the order of a hash of
doc_id); trees are complete and flattened into arrays, so a batch of documents walks all of them
with a few numpy operations. Labels, language, source and doc_id are never inputs.

Null and empty texts have all-zero statistics and get a score like any other. Without labels
every score is 0.5; with labels of one class only it is that class. Documents with several labels count once a label.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, text_bytes

SAMPLE, BINS, TREES, DEPTH, RATE = 20_000, 64, 80, 4, 0.15
_CLASS = np.zeros(256, dtype=np.int64)  # 0 others
for _i, _group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"|", b"$%&*#@~^", b"<>{}[]\\/_=+", bytes(range(128, 256))), 1):
    _CLASS[list(_group)] = _i
_ENDS = frozenset(b"!|$%&*#@~^<>{}[]\\/_=+")


def statistics(text: bytes) -> list[float]:
    """Figures of a text: sizes, shares of kinds of characters, repetition of words and lines."""
    counts = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=13)
    n = max(len(text), 1)
    words = text.split()
    many = max(len(words), 1)
    kinds = Counter(words)
    top = kinds.most_common(3)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    again = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    lines = [x for x in text.split(b"\n") if x]
    line_kinds = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in line_kinds.items() if c > 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), float(lengths.max()),
        *(counts / n).tolist(), len(kinds) / many, np.log1p(len(kinds)), (top[0][1] if top else 0) / many, sum(c for _, c in top) / many,
        again / many, sum(w[-1] in _ENDS for w in words) / many, sum(w.isupper() for w in words) / many, sum(len(w) <= 2 for w in words) / many,
        np.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(line_kinds) / max(len(lines), 1), repeated / n,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64)


class Trees:
    """Complete trees in arrays: feature and threshold of inner nodes, value of leaves."""

    def __init__(self, base: float, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray):
        self.base, self.features, self.thresholds, self.values = base, features, thresholds, values

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1] if len(self.features) else 0
        for feature, threshold, value in zip(self.features, self.thresholds, self.values, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, penalty: float = 1.0) -> Trees:
    """Boost trees on the logistic loss; splits are found on histograms of binned features."""
    none = np.zeros((0, 0))
    if not len(y):
        return Trees(0.0, none, none, none)
    share = (y.sum() + 1e-3) / (len(y) + 2e-3)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(base, none, none, none)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    inner = 2**depth - 1
    offsets = np.arange(d) * bins
    total = np.full(len(y), base)
    features, thresholds, values = (np.zeros((trees, m)) for m in (inner, inner, inner + 1))
    features = features.astype(np.int64)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), dtype=np.int64)
        thresholds[t] = np.inf
        for level in range(depth):
            low = 2**level - 1
            width = 2**level
            cell = ((at - low)[:, None] * (d * bins) + offsets + binned).ravel()
            g, h = (np.bincount(cell, np.repeat(w, d), minlength=width * d * bins).reshape(width, d, bins).cumsum(2) for w in (gradient, hessian))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            f, b = np.divmod(best, bins)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for node in np.flatnonzero(good).tolist():
                if b[node] < len(edges[f[node]]):
                    features[t, low + node], thresholds[t, low + node] = f[node], edges[f[node]][b[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), features[t, at]] > thresholds[t, at])
        leaf = at - inner
        g, h = (np.bincount(leaf, w, minlength=inner + 1) for w in (gradient, hessian))
        values[t] = -rate * g / (h + penalty)
        total += values[t][leaf]
    return Trees(base, features, thresholds, values)


def remainder(parts: int):
    """crc32 of doc_id as text, by which rows are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = matrix(text_bytes(batch.column(2)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["place", "quality", "x"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents whose crc32 modulo 3 is not 1.

    The sample is the first labels in the order of a hash of doc_id, then the first of their documents in the order
    of a hash of doc_id and text, so neither bound prefers any kind of text. Repeated doc_ids count once a label and row.
    """
    prepare(documents.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(3) != 1)).select(F.col("doc_id").alias("label_doc"), F.col("quality").cast("int").alias("label"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("label_doc"), "label_doc", "label").limit(sample))
    told = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_doc")).select(F.xxhash64("doc_id", "text").alias("place"), "label", "text")
    rows = map_batches(told, _measure, "place long, quality int, x array<double>")
    rows = rows.orderBy("place", "quality", "x").limit(sample).toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64)
    return fit(x, (rows.column("quality").to_numpy() == 1).astype(np.float64))


def score(documents: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.predict(matrix(text_bytes(batch.column(2))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``documents`` that are not rejected; verdict and row stay in one batch."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.predict(matrix(text_bytes(batch.column(at)))) >= 0.5))

    return map_batches(documents, run, documents.schema)
