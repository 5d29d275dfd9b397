"""Hard negatives against a plain scan of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives, queries
from tidewell.llm.common import table

LONG = 2**63


def plain(rows, every, k=5, n=5, percent=80):
    """rows: (vec_id, label, vector or None)."""
    kept = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        clip = lambda x: max(-LONG, min(LONG - 1, x))
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [clip(int(np.floor(256 * float(x)))) for x in v]))
    out = []
    for i, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        scored = [(-max(-LONG, min(LONG - 1, sum(x * y for x, y in zip(v, w)))), c, other) for j, (c, other, w) in enumerate(kept) if j != i and len(w) == len(v)]
        for p, pos, _ in sorted(s for s in scored if s[2] == label)[:k]:
            low = [s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p]
            out += [(a, pos, rank, c, -p, -s) for rank, (s, c, _) in enumerate(sorted(low)[:n], 1)]
    return sorted(out)


def mined(df, every, **sizes):
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.prepared(df), f"vec_id % {every} = 0", **sizes).collect()))


def test_query(spark, data):
    rows = [(r.vec_id, r.label, r.embedding) for r in table(spark, data, "embeddings").collect()]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, data).collect())) == plain(rows, 100)


@pytest.mark.parametrize("shard_rows, block_rows", [(8192, 1024), (30, 7)])
def test_odd_rows(spark, shard_rows, block_rows):
    """Clusters, ties, repeated rows and ids, null and non-finite parts, other lengths, null vectors, scores beyond doubles and longs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8)) * 3
    rows = [(i, int(rng.integers(0, 10)), (centres[rng.integers(0, 4)] + rng.normal(size=8) * rng.choice([0.0, 0.1, 1.0])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(10, 3, rows[10][2]), (10, 3, rows[10][2]), (20, None, rows[1][2]), (None, 1, rows[1][2]), (30, 1, None), (40, 1, [1.0, None]), (50, 2, [float("nan")] * 8), (60, 2, [float("inf")] * 8)]
    rows += [(500 + i, i % 3, [0.0] * 8) for i in range(12)] + [(600 + i, i % 3, [1.0, float(i % 2)]) for i in range(12)] + [(700 + i, i % 2, []) for i in range(12)]
    rows += [(800 + i, i % 2, [float(2**18), float(i), float(2**22 + i)]) for i in range(12)] + [(900 + i, i % 2, [1e12, float(i), 1.0, float(1e30) * (-1) ** i]) for i in range(12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, row int").repartition(4)
    plain_rows = [(a, b, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for a, b, v in rows]
    got = mined(df, 10, shard_rows=shard_rows, block_rows=block_rows)
    assert got == plain(plain_rows, 10) and len(got) > 100
    assert mined(df.limit(0), 10) == []
    assert mined(df.where(F.col("vec_id") % 10 != 0), 10) == []


def test_walks_end_early():
    """A member far from most candidates opens a small part of the list."""
    rng = np.random.default_rng(1)
    vectors = np.rint(np.concatenate([rng.normal(size=(5000, 16)) * 20 + 300 * np.eye(16)[i] for i in range(4)]))
    members = vectors[:50]
    shared = hard_negatives.SharedList(members, vectors)
    scores = hard_negatives.inner_products(members, vectors)
    kth = np.sort(scores, 1)[:, -5]
    who = np.arange(len(members))
    ends = next(at for at in range(0, len(vectors), 100) if not shared.open(at, kth, who).any())
    assert ends <= 6000
    # no candidate is above its bound
    assert (scores[:, shared.order] <= shared.lengths[:, None] * shared.bounds + 1e-6).all()
