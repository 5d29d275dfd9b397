"""Language identification by a convolutional network over bytes.

Filters of several widths slide over byte embeddings, their maxima over a window feed a softmax. It is
trained in numpy on windows of a bounded sample of labelled documents (``PER_LANGUAGE`` documents a
language in the order of a hash of doc_id). For scoring, filters become tables over byte pairs; each
text is cut into windows of fixed length that cover all of it, and their log-probabilities are averaged by length.
Of equal probabilities the language that sorts first wins. Documents that repeat a doc_id may each be in the sample.

The prediction is ``und`` with score 0 if the text is null or has no letter, or if nothing was learnt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boosted_trees import remainder
from .common import bounded, map_batches, prepare

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, WINDOWS_PER_DOC, EPOCHS, BATCH = 1000, 4, 3, 128
SPARE, LOTS = 2, 1 << 30


def has_letter(text: str) -> bool:
    """Whether a character is a letter; digits and numbers in other forms are none."""
    return any(map(str.isalpha, text))


def cut(text: bytes) -> np.ndarray:
    """All windows of a text, the last filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Embedding, filters by width, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.dense, self.bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Of each width: a table over byte pairs for each two columns, over bytes for an odd last one."""
        out = []
        for kernel in self.filters:
            single = [self.embed @ k for k in kernel]
            pairs = [(single[i][:, None, :] + single[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, len(single) - 1, 2)]
            out.append(pairs + ([single[-1]] if len(single) % 2 else []))
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        pairs = windows[:, :-1].astype(np.int64) * 256 + windows[:, 1:]
        features = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            n = WINDOW - width + 1
            total = np.take(parts[0], pairs[:, :n], axis=0)
            for i, part in enumerate(parts[1:], 1):
                total += np.take(part, pairs[:, 2 * i : 2 * i + n] if len(part) == 65536 else windows[:, 2 * i : 2 * i + n], axis=0)
            features.append(total.max(1))
        z = np.maximum(np.concatenate(features, 1), 0) @ self.dense + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        e = self.embed[x]
        pooled, places = [], []
        for kernel, width in zip(self.filters, WIDTHS, strict=True):
            n = WINDOW - width + 1
            out = sum(e[:, j : j + n] @ kernel[j] for j in range(width))
            at = out.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        active = np.maximum(h, 0)
        z = active @ self.dense + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.dense.T) * (h > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        rows = np.arange(len(x))[:, None]
        for i, (kernel, width) in enumerate(zip(self.filters, WIDTHS, strict=True)):
            dk, g = np.zeros_like(kernel), dh[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(width):
                seen = x[rows, places[i] + j]  # the byte under column j at each filter's maximum
                dk[j] = np.einsum("bfe,bf->ef", self.embed[seen], g)
                np.add.at(d_embed, seen, g[:, :, None] * kernel[j].T[None])
            d_filters.append(dk)
        return [d_embed, *d_filters, active.T @ p, p.sum(0)]


def fit(windows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> Network:
    """Train with Adam on shuffled batches."""
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(max(epochs, -(-100 * BATCH // max(len(y), 1)))):
        order = rng.permutation(len(y))
        for low in range(0, len(y), BATCH):
            some = order[low : low + BATCH]
            step += 1
            for p, g, m, v in zip(net.parameters(), net.gradients(windows[some], y[some]), first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _samples(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows spread evenly over each text."""
    langs, out = [], []
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text and has_letter(text):
            windows = cut(text.encode())
            for i in sorted({int(x) for x in np.linspace(0, len(windows) - 1, WINDOWS_PER_DOC)}):
                langs.append(lang)
                out.append(windows[i].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Fit on at most ``per_language`` documents a language whose crc32 modulo 4 is not 2.

    A language with many documents is thinned by the hash of doc_id first, to ``SPARE`` times the bound in expectation,
    so that ranking them is a small task for every language.
    """
    prepare(documents.sparkSession)
    known = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
    counts = known.groupBy("lang").agg(F.count("*").alias("held")).checkpoint()
    counts = bounded(counts.withColumnRenamed("lang", "_lang"), counts.count())
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(LOTS)) * F.col("held") < F.lit(LOTS * SPARE * per_language)
    thin = known.select("doc_id", "lang").join(counts, F.col("lang") == F.col("_lang")).where(lot).select("doc_id", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = thin.withColumn("place", place).where(F.col("place") <= per_language).select(F.col("doc_id").alias("of"), F.col("lang").alias("of_lang")).checkpoint()
    chosen = bounded(chosen, chosen.count())
    rows = map_batches(known.join(chosen, (known.doc_id == chosen.of) & (known.lang == chosen.of_lang)).select("lang", "text"), _samples, "lang string, bytes binary").orderBy("lang", "bytes").toArrow()
    if not rows.num_rows:
        return None
    languages = sorted(set(rows.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), dtype=np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([number[x] for x in rows.column("lang").to_pylist()]), languages)


WINDOWS_AT_ONCE = 512


def predict(documents: DataFrame, model: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    ready: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = shared.value
        if net is not None and not ready:
            ready.append(net.tables())
        texts = batch.column(2).to_pylist()
        pred, best = ["und"] * len(texts), np.zeros(len(texts))
        told = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
        cuts = [cut(texts[i].encode()) for i in told]
        if told:
            flat = np.concatenate(cuts)
            logs = np.concatenate([net.log_probabilities(flat[a : a + WINDOWS_AT_ONCE], ready[0]) for a in range(0, len(flat), WINDOWS_AT_ONCE)]).astype(np.float64)
            weights = (flat != 0).sum(1)[:, None].astype(np.float64)
            first = np.cumsum([0] + [len(c) for c in cuts[:-1]])
            mean = np.add.reduceat(logs * weights, first) / np.maximum(np.add.reduceat(weights, first), 1)
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, which, value in zip(told, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                pred[i], best[i] = net.languages[which], value
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
