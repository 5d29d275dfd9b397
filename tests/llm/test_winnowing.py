"""Fingerprints against a plain version, and the guarantees of winnowing."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import queries, winnowing
from tidewell.llm.common import table


def plain_winnow(text, k, window):
    """(position, hash) kept, window by window; the hash of a gram is taken on its own."""
    points = [ord(c) for c in text]
    k = min(k, len(points))
    if not k:
        return []
    hashes = []
    for i in range(len(points) - k + 1):
        h = 0
        for p in points[i : i + k]:
            h = (h * int(winnowing._BASE) + p + 1) % 2**64
        hashes.append(int(winnowing._mixed(np.array([h], np.uint64))[0]))
    w = min(window, len(hashes))
    kept = {max((j for j in range(i, i + w)), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - w + 1)}
    return [(j, hashes[j]) for j in sorted(kept)]


def plain_rows(rows, k=winnowing.GRAM, window=winnowing.WINDOW, winnow=None):
    winnow = winnow or (lambda t: plain_winnow(t, k, window))
    text_of = lambda f: " ".join(f"{h:016x}@{p}" for p, h in f)

    def alike(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, other = winnow(text), winnow(edited), winnow(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(new), alike(own, new), alike(own, other)))
    return sorted(out, key=repr)


def test_query(spark, data):
    rows = sorted(((r.doc_id, r.text or "") for r in table(spark, data, "documents").collect()), reverse=True)
    whole = lambda t: list(zip(*(x.tolist() for x in winnowing.winnow(t))))
    got = sorted(map(tuple, queries.op13_winnowing(spark, data).collect()), key=repr)
    assert got == plain_rows(rows, winnow=whole)
    few = {r[0]: r[3] for r in got}
    for doc, text in rows[:20]:
        assert few[doc] == " ".join(f"{h:016x}@{p}" for p, h in plain_winnow(text, winnowing.GRAM, winnowing.WINDOW))


@pytest.mark.parametrize("block_chars", [30, 4_000_000])
def test_odd_rows(spark, block_chars):
    """Null and repeated ids, null, empty and repeated texts, characters beyond 16 bits, columns with clashing names, many and few blocks."""
    rng = random.Random(2)
    rows = [(rng.randint(-50, 50), "".join(rng.choice("ab \U0001f600é") for _ in range(rng.randint(0, 90)))) for _ in range(120)]
    rows = list({d: (d, t) for d, t in rows}.values()) + [(2**53 + 1, "x" * 100), (2**53 + 2, None), (2**53 + 3, "")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, block int, visitor boolean").repartition(5)
    want = plain_rows(sorted(((d, t or "") for d, t in rows), reverse=True))
    assert sorted(map(tuple, winnowing.compared(df, block_chars=block_chars).collect()), key=repr) == want
    assert winnowing.compared(df.limit(0)).count() == 0
    one = winnowing.compared(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    nulls = spark.createDataFrame([(None, "abc"), (None, None), (None, "abc"), (3, "abc"), (3, "abc"), (3, "zz"), (1, "")], "doc_id long, text string")
    got = winnowing.compared(nulls, block_chars=block_chars).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=repr) == sorted([(None, 3), (None, 0), (None, 3), (3, 3), (3, 3), (3, 2), (1, 0)], key=repr)
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=120), st.integers(1, 9), st.integers(1, 9), st.integers(1, 40))
def test_windows(text, k, window, piece):
    positions, hashes = winnowing.winnow(text, k, window, piece)
    assert list(zip(positions.tolist(), hashes.tolist())) == plain_winnow(text, k, window)


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=60), st.text("abcd", max_size=60), st.text("abcd", min_size=20, max_size=20))
def test_shared_passages_share_a_hash(left, right, passage):
    """Any ``window + k - 1`` shared code points are found."""
    a, b = (set(winnowing.winnow(t, 8, 13)[1].tolist()) for t in (left + passage + right, right + passage + left))
    assert a & b
