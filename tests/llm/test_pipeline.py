"""The corpus pipeline, stage by stage, against the plain versions; nulls, repeats, empties and extra columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidewell.llm import boosted_trees, packing, rlz_dedup, tokens

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def small(data):
    return data.replace("sf0.01", "sf0.001")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def first_of_groups(docs):
    return {d for d, (_, top) in brute.jaccard(docs.items(), 5, 80, 100).items() if d == top}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = texts(docs)
    model = boosted_trees.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    for name in ("quality", "near_duplicates", "repeated_passages", "benchmark_leaks"):
        out = STAGES[name](spark, docs, small).checkpoint()
        assert out.columns == docs.columns
        got = texts(out)
        assert len(got) == out.count()
        if name == "quality":
            want = {d: t for d, t in left.items() if model.predict(boosted_trees.matrix([t.encode()]))[0] >= 0.5}
            assert 0 < len(want) < len(left)
        elif name == "near_duplicates":
            keep = first_of_groups(left)
            want = {d: t for d, t in left.items() if d in keep}
        elif name == "repeated_passages":
            found = brute.repeats(left.items())
            gone = {d for d, (n, removed, _) in found.items() if removed == n and n}
            assert set(got) == set(left) - gone
            for d, t in got.items():
                import hashlib

                assert hashlib.sha256(" ".join(brute.WORD.findall(t)).encode()).hexdigest() == found[d][2]
            want = got
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
            want = {d: t for d, t in left.items() if not brute.leaks([(d, t)], items)[d][4]}
        assert got == want
        docs, left = out, got
    cache = tokens.cache_for(packing.default_path())
    pieces = set()
    for d, t in left.items():
        ids = cache.packed([t])[0] + b"\0\0\0\0"
        pieces |= {(d, n, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for n, at in enumerate(range(0, len(ids), 8192))}
    rows = STAGES["sequences"](spark, docs, small).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_run_is_its_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).select("doc_id", "piece", "ids_crc32").collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).checkpoint()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_edge_rows(spark, small):
    """Null ids and texts, empty texts, repeated rows and an extra column pass through every stage."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c", 1), (None, None, 1), (1, None, 1), (2, "", 1), (3, passage, 1), (3, passage, 1), (4, passage + " end", 1), (5, "some " * 400, 1), (5, "another text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first long").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert name == "sequences" or out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), small).count() == 0
    kept = STAGES["near_duplicates"](spark, docs, small)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted({(d, t) for d, t, _ in rows if d != 4}, key=str)
    cut = STAGES["repeated_passages"](spark, docs, small)
    assert {(r.doc_id, r.text) for r in cut.where("doc_id >= 3").collect()} == {(3, passage), (4, " end".strip()), (5, "some " * 400), (5, "another text")}
    assert rlz_dedup.digest(docs).count() == len(rows)
