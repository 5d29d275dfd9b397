"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import ball_tree, boosted_trees, byte_cnn, host_reputation, html_diff, jaccard_join, length_histogram, packing, rlz_dedup, tokens, wu_manber

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, uid string, label_doc int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base, passage = words(rng, 300), words(rng, 60)
    out = [None, "", " \t\n", "one", "One two", "ONE TWO", base, base, base.upper(), words(rng, 30_000)]
    for i in range(30):
        w = base.split()
        for _ in range(i % 7):
            w[rng.randrange(300)] = words(rng, 1)
        out.append(" ".join(w))
    out += [f"{words(rng, 20)} {passage}\n{words(rng, 40)}" for _ in range(8)] + [passage, passage + " " + passage, words(rng, 49), "\ud7ff \u0130\u00df \x1c"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 3) for i, t in enumerate(texts())], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def plain():
    return list(enumerate(texts()))


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard(docs, k, num, den):
    assert got(jaccard_join.jaccard_components(docs, k, num, den), "doc_id", "n_shingles", "component_id") == brute.jaccard(plain(), k, num, den)


@pytest.mark.parametrize(
    "limits",
    [
        {"REGION": 2, "DENSE": 0},  # dense neighbourhoods
        {"WIDEST": 3},  # neighbourhoods too wide to hold
        {"CELL_SETS": 6, "PIVOTS": 3},  # groups divided by pivots
        {"CELL_SHINGLES": 900, "PIVOTS": 2, "ROUNDS": 2},
        {"CELL_SETS": 4, "ROUNDS": 0},  # pairs of blocks
        {"MANY": 1},  # every pivot fetches its wider ball
    ],
)
@pytest.mark.parametrize("k,num,den", [(2, 40, 100)])
def test_jaccard_limits(docs, monkeypatch, limits, k, num, den):
    """No limit of size changes the groups."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    assert got(jaccard_join.jaccard_components(docs, k, num, den), "doc_id", "n_shingles", "component_id") == brute.jaccard(plain(), k, num, den)


def test_jaccard_region_against_all_pairs():
    """Links inside a region, with and without its triangle windows, against all pairs; chains of near copies among strangers."""
    import numpy as np

    rng = np.random.default_rng(3)
    sets, base = [], rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    for i in range(150):
        if i % 30 == 0:
            base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
        base = base.copy()
        base[rng.integers(0, 200, 6)] = rng.integers(0, 1 << 60, 6, dtype=np.uint64)
        sets.append(np.unique(base))
    sets += [np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64)) for n in (1, 2, 3, 500)]
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    a, b = jaccard_join.Region(sets, 85, 100).links()
    found = list(range(len(sets)))
    for x, y in zip(a.tolist(), b.tolist()):
        found[y] = x
    assert found == top


def test_jaccard_runs():
    import numpy as np
    import pyarrow as pa

    rows = [(t, n, s) for t in range(3) for n, s in [(1, 100), (2, 100), (3, 101), (4, 300)][: t + 2]]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["token", "node", "n"])
    whole = {(a, b) for x in jaccard_join._regions(85, 100)([batch(rows)]) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    split = {(a, b) for x in jaccard_join._regions(85, 100)([batch([r]) for r in rows]) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    assert whole == split == {(1, 2), (1, 3), (2, 3)}
    assert np.array_equal(jaccard_join.needed_overlap(100, 100, 85, 100), 92)


def test_keep_first(docs):
    out = jaccard_join.keep_first(docs, 4, 85, 100)
    assert out.columns == docs.columns
    want = brute.jaccard(plain(), 4, 85, 100)
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, (_, top) in want.items() if d == top)


def test_keep_first_repeated_ids(spark):
    """A doc_id on unlinked texts keeps each; linked texts with one doc_id, and repeated rows, keep one."""
    far, near, other = "a b c d e f g h", " ".join(f"w{i}" for i in range(60)), "p q r s t u v w"
    rows = [(1, "x y z"), (1, "u v"), (1, far), (1, far), (0, other), (1, other), (2, near), (2, near + " w60"), (3, near)]
    out = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    got = sorted((r.doc_id, r.text) for r in out)
    assert [x for x in got if x[0] != 2] == sorted([(1, "x y z"), (1, "u v"), (1, far), (0, other)])
    assert len([x for x in got if x[0] == 2]) == 1


@pytest.mark.parametrize("small", [True, False])
def test_dedup(docs, spark, monkeypatch, small):
    """The same results whether the index goes to the documents or the blocks are shuffled to it."""
    monkeypatch.setattr(rlz_dedup, "INDEX_ROWS", 100_000 if small else 0)
    want = brute.repeats(plain())
    assert got(rlz_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    out = {r.doc_id: r for r in rlz_dedup.remove_spans(docs).collect()}
    for i, t in plain():
        if want[i][1] == 0:
            assert out[i].text == t and out[i].n_chars == 1
        elif want[i][1] == want[i][0]:
            assert i not in out
        else:
            import hashlib

            kept = out[i].text
            assert hashlib.sha256(" ".join(brute.WORD.findall(kept)).encode()).hexdigest() == want[i][2] and out[i].n_chars == len(kept)


def test_decontamination(docs, spark):
    some = texts()
    items = [(1, " ".join(some[6].split()[40:60])), (2, "one"), (3, None), (4, "..."), (5, " ".join(some[-4].split()[:12])), (5, "two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(plain(), items)
    assert got(wu_manber.digest(wu_manber.occurrences(docs, benchmark)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = wu_manber.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}


@pytest.mark.parametrize("per_pass", [1, 100])
def test_decontamination_in_passes(spark, per_pass):
    """Null and repeated doc_ids with texts of one length stay rows of their own in any number of passes."""
    texts = [(None, "a b"), (None, "c d"), (None, "a b"), (1, "c d"), (1, "e f"), (1, "e f"), (2, None), (2, "")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a b"), (None, "d"), (3, "c"), (5, None)], "item_id long, text string")
    out = wu_manber.occurrences(documents, benchmark, items_per_pass=per_pass).collect()
    want = {"a b": ([0, 1], ["1", "2", "4"]), "c d": ([0, 1], ["3", "3", None]), "e f": ([], [])}
    assert sorted(((r.doc_id, r.n_words, r.hits, sorted(r.item_ids, key=str)) for r in out), key=str) == sorted(
        ((d, len((t or "").split()), *(want[t] if t else ([], []))) for d, t in texts), key=str
    )


def test_packing(docs):
    import numpy as np

    rows = packing.pack(docs, size=64, partition_pieces=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 64 and sorted(p)[0][0] == 0 for p in by.values())
    cache = tokens.cache_for(packing.default_path())
    for i, t in plain():
        ids = cache.packed([t])[0] + b"\0\0\0\0"
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) // 4 and all(crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in own)
    assert packing.lower_bound(np.array([40, 40, 40, 20]), 64) == 3


def test_loosest_bins_meet(spark):
    """Certified partitions don't keep one loose bin each: in all there is hardly more than the bound over all pieces."""
    import numpy as np

    docs = spark.createDataFrame([(i, "word " * (5 + i % 37)) for i in range(600)], "doc_id long, text string")
    rows = packing.pack(docs, size=64, partition_pieces=25).collect()
    assert len(rows) == 600 and sorted(r.doc_id for r in rows) == list(range(600))
    bound = packing.lower_bound(np.array([r.length for r in rows]), 64)
    assert bound <= len({r.sequence_id for r in rows}) <= bound + 8
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64


def test_length_histogram(docs, nothing):
    assert sum(r.n_docs for r in length_histogram.at_limits(docs).collect()) == len(texts())
    assert length_histogram.at_limits(nothing).count() == 0


def test_scores(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = boosted_trees.train(docs, labels)
    out = boosted_trees.score(docs, model).collect()
    assert len(out) == len(texts()) and all(0 <= r.score <= 1 for r in out)
    assert boosted_trees.keep_good(docs, model).columns == docs.columns
    assert [r.score for r in boosted_trees.score(docs, boosted_trees.train(docs, labels.limit(0))).collect()] == [0.5] * len(texts())
    assert boosted_trees.score(nothing, model).count() == 0


def test_language(spark, docs, nothing):
    net = byte_cnn.train(docs)
    out = got(byte_cnn.predict(docs, net), "doc_id", "lang_pred", "score")
    assert all(out[i][0] == ("en" if t and any(c.isalpha() for c in t) else "und") for i, t in plain())
    assert byte_cnn.train(nothing) is None and {r.lang_pred for r in byte_cnn.predict(docs, None).collect()} == {"und"}


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, [-1.0, -2.0]), (8, [1.0]), (50, [0.5, 0.1]), (100, [3.0]), (150, []), (None, [1.0, 1.0])]
    rows += [(200 + i, [float(i % 7) / 3, float(i % 5) / 4]) for i in range(300)]
    vectors = ball_tree.quantised(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int"))
    out = ball_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=40, block_rows=3)
    assert sorted(map(tuple, out.collect())) == sorted(brute.top_k([r for r in rows if r[0] is not None], lambda q: q % 50 == 0))


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/1?x"), (2, "https://example.org/en/12"), (3, "x://fr.com/fr/#a"), (4, "://com/de/"), (5, None), (6, "no url"), (7, "http://org"), (8, "http://xexample.org/es/"), (9, "http://de.COM/de/9"), (9, "http://de.COM/de/9")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert out[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and out[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[3] == ("fr.com", "/fr/", "com/fr/", "allow") and out[4] == ("com", "/de/", "com/de/", "block")
    assert out[5] == out[6] == ("", "", None, "allow") and out[7] == ("org", "", None, "allow") and out[8][2] == "org/" and out[9][3] == "block"


def test_pages(spark):
    nav, main = "<nav>menu</nav>", "<article class=post><h1>T &amp; t</h1><p>a\n  b<br>c<p>d &lt;e&gt;<div class='ad-box'>buy</div><form>f</form><section id=comments><p>nice</p></section></article>"
    plain_page = "<div>site name</div><div>text {}</div><div class=sidebar>links</div><div>all rights</div>"
    rows = [(1, "http://h.org/a/1", f"<html><head><title>x</title><script>var a='</p>';</script></head>{nav}{main}<footer>c</footer>"), (2, "http://h.org/b/1", plain_page.format("one")), (3, "http://h.org/b/2", plain_page.format("two")), (4, None, None), (5, "http://z.org/", ""), (None, "http://h.org/b/3", "<p>x</p>"), (7, "http://h.org/c", "<p>1 < 2 <!-- no --> and")]
    out = {r.page_id: (r.text, r.n_chars) for r in html_diff.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, near int")).collect()}
    assert out[1][0] == "T & t\n\na b c\n\nd <e>"
    assert out[2][0] == "text one" and out[3][0] == "text two"
    assert out[4] == out[5] == ("", 0) and out[None][0] == "x" and out[7][0] == "1 < 2 and"
    assert html_diff.common_lines([1, 2, 3, 4, 2], [2, 3, 9, 2]) == [2, 3, 2]


def test_empty_tables(nothing, spark):
    empty_pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_join.jaccard_components(nothing).count() == 0
    assert rlz_dedup.digest(nothing).count() == 0
    assert packing.pack(nothing).count() == 0
    assert wu_manber.occurrences(nothing, nothing.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert html_diff.extract(empty_pages).count() == 0
    assert host_reputation.judge(empty_pages, labels).count() == 0
    vectors = ball_tree.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ball_tree.top_k(vectors, vectors).count() == 0


def test_packing_keeps_ids(spark):
    """Ids beyond double precision beside a null one."""
    rows = [(None, "a b"), (9007199254740993, "c"), (5, "d"), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [5, 9007199254740993, None, None]


def test_top_k_of_repeated_queries(spark):
    """Rows with one vec_id have each their own answer; scores beyond doubles and longs are exact or the nearest long."""
    rows = [(50, [1.0, 2.0]), (50, [2.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    vectors = ball_tree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = sorted((r.rank, r.vec_id, r.score) for r in ball_tree.top_k(vectors, vectors.where("vec_id = 50"), 2, shard_rows=2, block_rows=1).collect())
    unit = 256 * 256
    assert out == [(1, 1, 6 * unit), (1, 2, 6 * unit), (2, 1, 3 * unit), (2, 2, 3 * unit)]
    big = [(0, [2.0**19, 3.0, 2.0**19 + 1]), (1, [2.0**19, 1.0, 2.0**19]), (2, [2.0**19 + 1, 1.0, 2.0**19]), (3, [1e30, 0.0, 1.0]), (4, [-1e30, 0.0, 1.0])]
    vectors = ball_tree.quantised(spark.createDataFrame(big, "vec_id long, embedding array<float>"))
    out = {r.vec_id: r.score for r in ball_tree.top_k(vectors, vectors.where("vec_id = 0"), 5).collect()}
    whole = [[int(256 * x) for x in v] for _, v in big[:3]]
    assert [out[i] for i in (1, 2)] == [sum(x * y for x, y in zip(whole[0], whole[i])) for i in (1, 2)]
    assert out[3] == 2**63 - 1 and out[4] == -(2**63)


def test_shards_that_no_query_needs(spark, monkeypatch):
    """Clustered shards whose ball lies below a query's floor are never opened; answers are those of a plain scan."""
    import numpy as np

    rng = np.random.default_rng(8)
    centres = 40 * np.eye(6)
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=6)]) for i in range(1200)] + [(2000 + i, [1.0] * (i % 3)) for i in range(30)]
    vectors = ball_tree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    pairs = spark.sparkContext.accumulator(0)
    inner = ball_tree._search

    def counting(k):
        run = inner(k)

        def wrapped(shard, queries):
            pairs.add(1 if len(shard) and len(queries) else 0)
            return run(shard, queries)

        return wrapped

    monkeypatch.setattr(ball_tree, "_search", counting)
    out = ball_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=100, block_rows=8).collect()
    whole = {i: np.floor(256 * np.array(v)) for i, v in rows}
    for q in range(0, 1200, 50):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == 6)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] == want
    shards = ball_tree._shards(vectors.withColumn("row", F.monotonically_increasing_id()), 100)[1]
    assert pairs.value < 3 * shards  # of 3 blocks and all shards; those of the home pass are among them


def test_letters():
    assert [byte_cnn.has_letter(t) for t in ("²", "½ ①", "_ 3", "", "é", "日", "a1")] == [False, False, False, False, True, True, True]


def test_adverts_and_comments_inside_articles():
    kept = lambda inner: [t for t, _ in html_diff.lines_of(f"<body><article><h1>Title</h1><p>Text of some length</p>{inner}</article></body>")][2:]
    for name in "google-ads adsbygoogle ad-leaderboard advert-300x250 in-article-ad mid-ad sticky-banner inline-promo related-stories commentlist fb-comments wp-block-comments guest-comments".split():
        assert kept(f'<div class="{name}"><p>gone</p></div>') == [] and kept(f'<ul class="{name}"><li>gone</li></ul>') == [], name
    assert kept('<section id="comments"><p>gone</p></section>') == []
    for inner in ('<h2 id="navigation">kept</h2>', '<h2 id="comments">kept</h2>', '<p id="menu">kept</p>', '<section id="subscription"><p>kept</p></section>', '<div class="ad-hoc"><p>kept</p></div>', '<div class="post has-comments"><p>kept</p></div>', '<p class="notice-period">kept</p>'):
        assert kept(inner) == ["kept"], inner
    teaser = "<article><h2>Elsewhere</h2></article>"
    assert [t for t, _ in html_diff.lines_of(f"<body><article><p>{'long text ' * 9}</p></article>{teaser}</body>")] == [("long text " * 9).strip()]
    assert [t for t, _ in html_diff.lines_of("<article><p>first part</p></article><article><p>other part</p></article>")] == ["first part", "other part"]


def test_alignment_in_linear_space(monkeypatch):
    import random

    rng = random.Random(3)
    lists = [([rng.randint(0, 6) for _ in range(rng.randint(0, 40))], [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]) for _ in range(150)]
    whole = [html_diff.common_lines(a, b) for a, b in lists]
    monkeypatch.setattr(html_diff, "_TABLE_CELLS", 9)
    for (a, b), want in zip(lists, whole):
        got = html_diff.common_lines(a, b)
        assert len(got) == len(want)
        for side in (a, b):
            left = iter(side)
            assert all(x in left for x in got)
    monkeypatch.undo()
    many = [i % 5000 for i in range(12_000)]
    assert len(html_diff.common_lines(many, many[1:] + [7])) >= 11_999  # a full table would hold 576 MB


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.component_id or -1) for r in jaccard_join.jaccard_components(docs).collect()) == [1, 1, 1, 1, 1]
    assert rlz_dedup.digest(docs).count() == 5 and packing.pack(docs).count() == 5


def test_maybe_among(spark):
    frame = spark.createDataFrame([(i, i * 7, f"text {i}") for i in range(3000)] + [(None, 5, None)], "doc_id long, uid long, text string")
    key = F.xxhash64("doc_id", "uid")
    some = frame.where("doc_id % 50 = 0 OR doc_id IS NULL")
    left = jaccard_join.maybe_among(frame, some, key)
    assert left.schema == frame.schema
    got = {tuple(r) for r in left.collect()}
    assert {tuple(r) for r in some.collect()} <= got <= {tuple(r) for r in frame.collect()}
    assert len(got) < 100  # the sketch errs rarely on so few
    assert jaccard_join.maybe_among(frame, some.where("false"), key).count() == 0


#: Names that the operators use inside.
INNER = "uid first first_doc first_uid drops quality label place label_doc node cell spans cut_text kept_text rest_0 rest_1 row part hits items n_words token counts chunk near host path x held salt"


def test_clashing_columns(spark):
    """Extra columns of any names change no result and come back unchanged where rows are kept."""
    plain_rows = [(1, "a b c d e f g h", 8), (2, "a b c d e f g h", 8), (3, " ".join(f"w{i}" for i in range(60)), 9), (4, " ".join(f"w{i}" for i in range(60)) + " x", 9)]
    bare = spark.createDataFrame(plain_rows, "doc_id long, text string, n_chars long")
    names = INNER.split()
    extra = bare.select(*(F.lit("extra").alias(n) for n in names), *bare.columns)
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").select("*", *(F.lit(1).alias(n) for n in names))
    for keep in (lambda d: jaccard_join.keep_first(d, 5, 80, 100), rlz_dedup.remove_spans, lambda d: wu_manber.clean(d, items)):
        out = keep(extra)
        assert out.columns == extra.columns and {x for r in out.select(*names).collect() for x in r} == {"extra"}
        assert sorted(map(tuple, out.select(*bare.columns).collect())) == sorted(map(tuple, keep(bare).collect()))


def test_clashing_columns_of_models(spark, docs):
    names = ["quality", "label", "place", "held", "_lang", "drops", "x", "of_page", "near"]
    extra = docs.select("*", *(F.lit("extra").alias(n) for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").withColumn("place", F.lit(1))
    model = boosted_trees.train(extra, labels)
    assert boosted_trees.keep_good(extra, model).columns == extra.columns
    assert {r.lang_pred for r in byte_cnn.predict(extra, byte_cnn.train(extra)).collect()} == {"en", "und"}
    pages = spark.createDataFrame([(1, "http://h/a", "<p>x</p>"), (2, "http://h/b", "<p>y</p>")], "page_id long, url string, html string").select("*", *(F.lit(0).alias(n) for n in names))
    assert {r.text for r in html_diff.extract(pages).collect()} == {"x", "y"}


def test_training_bound_prefers_no_text(spark):
    """Rows that repeat doc_ids beyond the bound are chosen by hash, not by what they say."""
    rows = [(1, "word " * n) for n in range(1, 201)]
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    seen = []
    fit = boosted_trees.fit
    try:
        boosted_trees.fit = lambda x, y: seen.append(x) or fit(x, y)
        boosted_trees.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=100)
    finally:
        boosted_trees.fit = fit
    assert len(seen[0]) == 100 and seen[0][:, 1].max() > 5  # long texts among them


def test_trees_against_a_plain_walk():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    model = boosted_trees.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20)

    def walk(row):
        total = model.base
        for feature, threshold, value in zip(model.features, model.thresholds, model.values):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    got = model.predict(x)
    assert np.allclose(got, [walk(r) for r in x])
    assert ((got > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_network_against_a_direct_convolution():
    import numpy as np

    net = byte_cnn.Network(["a", "b", "c"], seed=3)
    windows = np.random.default_rng(2).integers(0, 256, (4, byte_cnn.WINDOW), dtype=np.uint8)
    for window, got in zip(windows, net.log_probabilities(windows)):
        pooled = []
        for kernel, width in zip(net.filters, byte_cnn.WIDTHS):
            for f in range(byte_cnn.FILTERS):
                pooled.append(max(sum(float(net.embed[window[i + j]] @ kernel[j][:, f]) for j in range(width)) for i in range(byte_cnn.WINDOW - width + 1)))
        z = np.maximum(pooled, 0) @ net.dense + net.bias
        assert np.allclose(got, z - np.log(np.exp(z).sum()), atol=1e-4)


def test_limits_and_quantiles(spark):
    n = [0, 3, 3, 7, 20, 20, 3000]
    encoded = spark.createDataFrame([(x,) for x in n], "length long")
    table = length_histogram.length_table(encoded, limits=[0, 1, 5, 1024, 9999])
    for r in table.collect():
        assert (r.n_docs, r.n_longer, r.n_tokens, r.n_kept) == (n.count(r.length), sum(x > r.length for x in n), sum(n), sum(min(x, r.length) for x in n))
    assert {r.length for r in table.collect()} == {*n, 1, 5, 1024, 9999}
    found = {r.share: r.length for r in length_histogram.quantiles(table, [0.1, 0.5, 0.9, 1.0]).collect()}
    assert found == {0.1: 0, 0.5: 7, 0.9: 3000, 1.0: 3000}
    assert length_histogram.length_table(encoded.limit(0), limits=[5]).count() == 0


def test_top_k_ties_of_negative_scores(spark):
    vectors = ball_tree.quantised(spark.createDataFrame([(0, [10.0])] + [(i, [-10.0]) for i in range(1, 401)], "vec_id long, embedding array<float>"))
    out = ball_tree.top_k(vectors, vectors.where("vec_id = 0"), 5, shard_rows=100)
    assert sorted((r["rank"], r.vec_id) for r in out.collect()) == [(i, i) for i in range(1, 6)]


def test_reputation_blocks(spark):
    """A host with nothing but bad pages is blocked without any rule; the one with good pages beside it is not."""
    rows = [(i, f"http://bad.site.net/p/{i}") for i in range(40)] + [(100 + i, f"http://good.site.net/p/{100 + i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 0 if i < 40 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = {(r.host, r.rule, r.verdict) for r in host_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert out == {("bad.site.net", None, "block"), ("good.site.net", None, "allow")}


def test_page_names_and_malformed_pages():
    lines = lambda page: [t for t, _ in html_diff.lines_of(page)]
    assert lines("<article><p class='notice-period'>a</p><p id=related-work>b <math><mi>x</mi></math></p><div class=ad-box>c</div><div class=notice>d</div><ul class='comment list'><li>e</ul>f</article>") == ["a", "b x", "f"]
    for page in ("<a " * 100_000, "<" + "a" * 100_000, "<a '> 'b" * 20_000, "<div>" * 50_000 + "</p>" * 50_000, "<a \"" * 50_000 + ">", "<p " + "a" * 100_000 + ">x"):
        lines(page)  # in one pass each


def test_index_of_blocks():
    import numpy as np
    import pyarrow as pa

    index = rlz_dedup.Index(pa.table({"a": [5, 6, 7, 8], "b": [1, 1, 2, -3], "least": [0, 1, 2, 3], "split": [True, False, True, False]}))
    at = index.find(np.array([6, 5, 9, 8, 7]), np.array([1, 1, 1, -3, 4]))
    assert [int(index.least[i]) if i >= 0 else None for i in at] == [1, 0, None, 3, None]


def test_factors():
    span = lambda start, words: {"start": start, "words": words}
    assert rlz_dedup.factors(None) == []
    # next windows follow without a gap: one factor; a missing window ends it
    assert rlz_dedup.factors([span(10, 52), span(13, 50)]) == [(10, 53)]
    assert rlz_dedup.factors([span(14, 50), span(10, 52)]) == [(10, 52), (14, 50)]
    assert rlz_dedup.covered(70, [span(14, 50), span(10, 52)]).sum() == 54


def test_differencing_covers_every_page(spark):
    """Pages with an article are differenced over all of their lines; the check by containers comes after it."""
    page = "<nav>menu</nav><article><p>text {0}</p><p>in both</p></article><div class=ad>advert {0}</div><footer>foot</footer>"
    rows = [(1, "http://h.org/a/1", page.format("one")), (2, "http://h.org/a/2", page.format("two")), (3, "http://h.org/b", "<div>menu</div><div>plain</div>"), (4, "http://z.org/", page.format("four")), (None, "http://h.org/a/3", page.format("none")), (6, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    of = lambda *lines: {html_diff.line_hash(x) for x in lines}
    both = of("menu", "in both", "foot")
    assert {r.page_id: (r.near, set(r.shared)) for r in html_diff.template_lines(pages).collect()} == {1: (2, both), 2: (1, both), 3: (2, of("menu"))}
    out = {r.page_id: tuple(r)[2:] for r in html_diff.extract(pages).collect()}
    assert out[1] == ("text one\n\nin both", 17, 2, 5, 3) and out[2] == ("text two\n\nin both", 17, 1, 5, 3)
    assert out[3] == ("plain", 5, 2, 2, 1) and out[4] == ("text four\n\nin both", 18, None, 5, 0)
    assert out[None] == ("text none\n\nin both", 18, None, 5, 0) and out[6] == ("", 0, None, 0, 0)
