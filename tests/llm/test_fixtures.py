"""Operators on fixtures beyond the given tables: against their own SQL, and with clashing names."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ball_tree, hard_negatives, host_reputation, length_histogram, packing


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reputation_against_its_sql(spark):
    """Several documents a host, null and repeated labels, labels without a page, pages without a label or host."""
    pages = [(i, f"http://{'bad' if i % 3 else 'good'}.site{i % 2}.net/p/{i}.html") for i in range(120)]
    pages += [(200 + i, u) for i, u in enumerate([None, "no host", "http://", "HTTP://Bad.Site1.NET/p/7", "https://www.example.org/es/x", "http://a.fr?x", "http://alone.org/9"])] + [(5, "http://bad.site1.net/p/5.html"), (None, "http://x.de/1")]
    labels = [(i, 0 if i % 3 and i % 7 else 1, None) for i in range(0, 120, 2)] + [(i, None, 1) for i in range(1, 60, 6)] + [(4, 1, 0), (4, 0, 0), (None, 0, 1), (9, None, None), (9999, 0, 0)]
    got = _rows(host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    con = duckdb.connect()
    frame = lambda rows, names: pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names if n != "url"})
    con.register("pages", frame(pages, ["page_id", "url"]))
    con.register("labels", frame(labels, ["doc_id", "quality", "toxic"]))
    want = con.execute(host_reputation.ORACLE_SQL)
    order = [[c[0] for c in want.description].index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert {"block", "allow"} == {r[4] for r in got if r[3] is None}


@pytest.mark.parametrize("names", [["part", "row", "settled", "length", "piece", "sequence_id"], ["shard", "block", "dim", "query", "home", "floor", "cluster", "rank", "score"]])
def test_clashing_names(spark, names):
    extra = lambda df: df.select(*(F.lit("extra").alias(n) for n in names), *df.columns)
    docs = spark.createDataFrame([(i, "some words " * (i + 1)) for i in range(20)], "doc_id long, text string")
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(packing.pack(extra(docs))) == key(packing.pack(docs))
    assert _rows(length_histogram.at_limits(extra(docs))) == _rows(length_histogram.at_limits(docs))
    vectors = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, label int, embedding array<float>")
    top = lambda df: _rows(ball_tree.top_k(ball_tree.quantised(df), ball_tree.quantised(df).where("vec_id % 10 = 0"), 3, shard_rows=20, block_rows=4))
    assert top(extra(vectors)) == top(vectors)
    mined = lambda df: _rows(hard_negatives.mine(hard_negatives.prepared(df), "vec_id % 10 = 0", shard_rows=20, block_rows=4))
    assert mined(extra(vectors)) == mined(vectors)
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.net/{i}") for i in range(10)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert _rows(host_reputation.judge(extra(pages), extra(labels))) == _rows(host_reputation.judge(pages, labels))
