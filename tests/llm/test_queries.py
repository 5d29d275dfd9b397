"""Every registered text query against a plain version, an exact round trip or held-out labels."""

import duckdb
import numpy as np
import pytest

from tests.llm import brute
from tidewell.llm import host_reputation, packing
from tidewell.llm.queries import QUERIES


def read(data, name, columns="*"):
    import os

    path = f"{data}/{name}.parquet"
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')").fetchall()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_jaccard_join(spark, data):
    got = {r[0]: r[1:] for r in rows(QUERIES["op3_jaccard_join"](spark, data), "doc_id", "n_shingles", "component_id")}
    assert got == brute.jaccard(read(data, "documents", "doc_id, text"), 4, 85, 100)


def test_rlz_dedup(spark, data):
    got = {r[0]: r[1:] for r in rows(QUERIES["op6_rlz_dedup"](spark, data), "doc_id", "n_words", "n_removed", "kept_sha256")}
    want = brute.repeats(read(data, "documents", "doc_id, text"))
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_wu_manber(spark, data):
    got = {r[0]: r[1:] for r in rows(QUERIES["op7_wu_manber"](spark, data), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    want = brute.leaks(read(data, "documents", "doc_id, text"), read(data, "benchmark", "item_id, text"))
    assert got == want
    assert any(w[4] for w in want.values())


def test_ball_tree(spark, data):
    got = rows(QUERIES["op4_ball_tree"](spark, data), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == sorted(brute.top_k(read(data, "embeddings", "vec_id, embedding"), lambda q: q % 50 == 0))


def test_packing(spark, data):
    from tokenizers import Tokenizer
    from zlib import crc32

    encode = Tokenizer.from_file(packing.default_path()).encode
    got = rows(QUERIES["op5_packing"](spark, data), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = set()
    for doc, text in read(data, "documents", "doc_id, text"):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(doc, n, at, len(ids[at : at + 2048]), crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))}
    assert {r[:5] for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r[3] for r in got]), 2048) + 1


def test_length_histogram(spark, data):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_path()).encode
    n = np.array([len(encode(t or "", add_special_tokens=False).ids) for (t,) in read(data, "documents", "text")])
    got = {r[0]: r[1:] for r in rows(QUERIES["op8_length_histogram"](spark, data), "length", "n_docs", "n_longer", "n_tokens", "n_kept", "rank")}
    assert set(got) == set(n.tolist())
    for limit, row in got.items():
        assert row[:4] == ((n == limit).sum(), (n > limit).sum(), n.sum(), np.minimum(n, limit).sum())
        assert row[4] == pytest.approx((n <= limit).mean())


def test_boosted_trees(spark, data):
    quality = dict(read(data, "labels", "doc_id, quality"))
    got = rows(QUERIES["op9_boosted_trees"](spark, data), "doc_id", "held_out", "score", "predicted")
    assert all(h == (brute.held(d, 3) == 1) and 0 <= s <= 1 and p == (s >= 0.5) for d, h, s, p in got)
    out = [(quality[d], p) for d, h, _, p in got if h and d in quality]
    assert np.mean([q == p for q, p in out]) > 0.95
    assert np.mean([p for q, p in out if q]) > 0.97


def test_byte_cnn(spark, data):
    lang = dict(read(data, "documents", "doc_id, lang"))
    got = rows(QUERIES["op10_byte_cnn"](spark, data), "doc_id", "held_out", "lang_pred", "score")
    assert all(h == (brute.held(d, 4) == 2) and 0 <= s <= 1 for d, h, _, s in got)
    assert np.mean([lang[d] == x for d, h, x, _ in got if h]) > 0.97


def test_host_reputation(spark, data):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    got = rows(QUERIES["op2_host_reputation"](spark, data), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got, key=str) == sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({host_reputation.ORACLE_SQL})").fetchall(), key=str)
    assert {r[4] for r in got} == {"allow", "block"}


def test_html_diff(spark, data):
    import html
    import re

    got = {r[0]: r[1:] for r in rows(QUERIES["op1_html_diff"](spark, data), "page_id", "url", "text", "n_chars")}
    for page, url, source in read(data, "pages", "page_id, url, html"):
        body = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n\n".join(b for b in blocks if b)
        assert got[page] == (url, want, len(want))
