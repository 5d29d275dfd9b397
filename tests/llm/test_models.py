"""The trained models against plain versions: statistics, splits, gradients, averages over windows, and whole queries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import boosted_trees, byte_cnn, queries
from tidewell.llm.common import table

GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "|", "$%&*#@~^", "<>{}[]\\/_=+")
TEXTS = ["", "a", "One two two. THREE!\nOne two two. THREE!\n\nlast|line <b>", "éé ß 12 12 12", "  \n\n ", "x" * 300, "A B c d. e!\nA B c d. e!\nA B"]


def plain_statistics(text):
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, many = max(len(raw), 1), max(len(words), 1)
    shares = [0.0] * 13
    for byte in raw:
        group = 12 if byte >= 128 else next((i for i, g in enumerate(GROUPS, 1) if chr(byte) in g), 0)
        shares[group] += 1 / n
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    kinds = Counter(words)
    top = sorted(kinds.values(), reverse=True)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)), max(lengths), *shares,
        len(kinds) / many, math.log1p(len(kinds)), (top[0] if top else 0) / many, sum(top[:3]) / many, sum(a == b for a, b in zip(words, words[1:])) / many,
        sum(chr(w[-1]) in "!|$%&*#@~^<>{}[]\\/_=+" for w in words) / many, sum(w.isupper() for w in words) / many, sum(len(w) <= 2 for w in words) / many,
        math.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(len(x) * (c - 1) for x, c in Counter(lines).items()) / n,
    ]


def test_statistics():
    for text in TEXTS:
        assert boosted_trees.statistics(text.encode()) == pytest.approx(plain_statistics(text)), text


def test_splits_have_the_greatest_gain():
    """Every node of one tree against all features and all their edges; leaves against their rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.5)).astype(float)
    model = boosted_trees.fit(x, y, trees=1, depth=2, bins=8, rate=0.5, penalty=1.0)
    share = (y.sum() + 1e-3) / (len(y) + 2e-3)
    assert model.base == pytest.approx(math.log(share / (1 - share)))
    p = np.full(len(y), share)
    g, h = p - y, p * (1 - p)
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    at = np.zeros(len(y), dtype=int)
    for node in range(3):
        rows = np.flatnonzero(at == node)
        gains = {}
        for j in range(3):
            for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])):
                left, right = rows[x[rows, j] <= edge], rows[x[rows, j] > edge]
                if h[left].sum() >= 1 and h[right].sum() >= 1:
                    gains[j, float(edge)] = score(left) + score(right) - score(rows)
        j, edge = int(model.features[0, node]), float(model.thresholds[0, node])
        assert gains[j, edge] == pytest.approx(max(gains.values()))
        at[rows] = 2 * node + 1 + (x[rows, j] > edge)
    for leaf in range(4):
        rows = np.flatnonzero(at == 3 + leaf)
        assert model.values[0, leaf] == pytest.approx(-0.5 * g[rows].sum() / (h[rows].sum() + 1.0))


def test_quality_query(spark, data):
    """The query against the same steps without Spark: the learnable labels, their documents' statistics, boosting, scores."""
    documents = {r.doc_id: (r.text or "", r.place) for r in table(spark, data, "documents").withColumn("place", F.xxhash64("doc_id", "text")).collect()}
    crc = lambda d: zlib.crc32(str(d).encode()) % 3
    told = sorted((documents[r.doc_id][1], r.quality, plain_statistics(documents[r.doc_id][0])) for r in table(spark, data, "labels").collect() if r.quality is not None and crc(r.doc_id) != 1)
    model = boosted_trees.fit(np.array([x for *_, x in told]), np.array([float(q == 1) for _, q, _ in told]))
    want = model.predict(np.array([plain_statistics(t) for t, _ in documents.values()]))
    got = {r.doc_id: r for r in queries.op9_boosted_trees(spark, data).collect()}
    assert len(got) == len(documents)
    close = 0
    for d, p in zip(documents, want):
        close += abs(got[d].score - p) < 1e-6
        assert got[d].held_out == (crc(d) == 1) and got[d].predicted == int(got[d].score >= 0.5)
    assert close >= 0.99 * len(documents)  # a statistic that lies on an edge may be rounded to either side


def test_gradients_are_those_of_the_loss():
    net = byte_cnn.Network(["a", "b", "c"], seed=2)
    net.embed, net.dense, net.bias = (p.astype(np.float64) for p in (net.embed, net.dense, net.bias))
    net.filters = [p.astype(np.float64) for p in net.filters]
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 256, (5, byte_cnn.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        h = []
        for kernel, width in zip(net.filters, byte_cnn.WIDTHS):
            n = byte_cnn.WINDOW - width + 1
            h.append(sum(net.embed[x][:, j : j + n] @ kernel[j] for j in range(width)).max(1))
        z = np.maximum(np.concatenate(h, 1), 0) @ net.dense + net.bias
        return -np.mean(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1)))

    for p, g in zip(net.parameters(), net.gradients(x, y)):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in {*rng.integers(0, len(flat), 12).tolist(), int(np.abs(slope).argmax())}:
            kept = flat[i]
            values = []
            for step in (1e-5, -1e-5):
                flat[i] = kept + step
                values.append(loss())
            flat[i] = kept
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(slope[i], rel=1e-3, abs=1e-7)


def test_texts_are_averaged_over_all_windows(spark):
    """The prediction of a text is the mean of its windows' log-probabilities, weighed by their bytes."""
    net = byte_cnn.Network(["de", "en", "fr"], seed=9)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdé .\n"), n)) for n in (5, 256, 257, 900, 3000)] + [None, "", "123 ²", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in byte_cnn.predict(docs, net).collect()}
    for i, text in enumerate(texts):
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        raw = text.encode()
        total, weight = np.zeros(3), 0
        for low in range(0, len(raw), byte_cnn.WINDOW):
            part = raw[low : low + byte_cnn.WINDOW]
            window = np.frombuffer(part + bytes(byte_cnn.WINDOW - len(part)), dtype=np.uint8)[None]
            total += net.log_probabilities(window)[0].astype(float) * len(part)
            weight += len(part)
        p = np.exp(total / weight)
        p /= p.sum()
        assert got[i][0] == net.languages[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-5)
