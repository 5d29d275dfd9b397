"""Ordered scans, counted values, vectors and diagnostics on hand-made rows, against plain versions."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import models, normal
from tidewell.operators import diagnostics, dists, etl, metrics, posterior, ranks, series, vectors
from tidewell.operators.scans import Scan

NAN = float("nan")


def _series(seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = [("long", float(t), float(rng.normal())) for t in rng.permutation(n)] + [("short", 1.0, 2.0), ("short", 3.0, 4.0), (None, 1.0, 5.0), (None, 2.0, None)]
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_over_ranges(spark, parts):
    """A long series lies in many ranges; values, sums, numbers and integrals go on from one to the next."""
    rows = _series()
    df = spark.createDataFrame(rows, "gene string, time double, y double").repartition(5)
    given = F.when(F.pmod(F.col("time").cast("long"), F.lit(90)) == 5, F.col("time"))
    scan = Scan(df, ["gene"], ["time"], parts)
    got = scan.carry(given, "before").carry(given, "after", down=True).total(F.lit(1), "upto").number("i").whole(F.lit(1), "n").trapezoid("time", "time", "area").result().collect()
    if parts > 1:
        assert scan.placed.where("gene = 'long'").select("_part").distinct().count() > 1
    assert len(got) == len(rows)
    for r in got:
        own = sorted(t for g, t, _ in rows if g == r.gene)
        marks = [t for t in own if int(t) % 90 == 5]
        assert r.before == max((t for t in marks if t <= r.time), default=None) and r.after == min((t for t in marks if t >= r.time), default=None)
        assert r.upto == r.i == own.index(r.time) + 1 and r.n == len(own)
        assert r.area == pytest.approx((r.time**2 - own[0] ** 2) / 2)


def test_regrid_and_exposure_in_ranges(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(1)
        knots = np.unique(rng.uniform(0, 100, 150).round(3))
        values = rng.normal(size=len(knots))
        asked = np.concatenate([rng.uniform(-10, 110, 200), knots[:5]])
        rows = spark.createDataFrame([("a", float(t), float(y)) for t, y in zip(knots, values)] + [("b", 1.0, 1.0), ("a", 50.0, NAN)], "gene string, time double, y double")
        grid = spark.createDataFrame([("a", float(t)) for t in asked] + [("c", 1.0)], "gene string, time double")
        got = {(r.gene, r.time): r.y for r in series.regrid(rows, grid).collect()}
        assert got["c", 1.0] is None
        for t in asked:
            want = np.interp(t, knots, values)
            assert got["a", float(t)] is None if not knots[0] <= t <= knots[-1] else got["a", float(t)] == pytest.approx(want)
        area = {r.time: r.exposure for r in series.exposure(rows.where("gene = 'a' AND NOT isnan(y)"), "y").collect()}
        want = np.concatenate([[0], np.cumsum(np.diff(knots) * (values[1:] + values[:-1]) / 2)])
        assert [area[float(t)] for t in knots] == pytest.approx(want.tolist())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_values_are_one_row(spark):
    """90 % of one value: no task holds them, ranks and percentiles are those of all rows."""
    values = [("k", 5.0)] * 9000 + [("k", float(i)) for i in range(1000)]
    rows = spark.createDataFrame(values, "k string, v double").repartition(8)
    counted = ranks.counted(rows, ["k"], "v")
    assert counted.count() == 1000
    assert {r.v: (r.held, r.before, r.n) for r in counted.where("v IN (4, 5, 6)").collect()} == {4.0: (1, 4, 10000), 5.0: (9001, 5, 10000), 6.0: (1, 9006, 10000)}
    all_ = np.sort([v for _, v in values])
    out = ranks.percentiles(rows, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95, "lo": 0.0, "hi": 1.0}).first()
    assert tuple(out)[1:] == pytest.approx(tuple(np.quantile(all_, [0.05, 0.5, 0.95, 0, 1])))
    signed = spark.createDataFrame([("k", -0.0), ("k", 0.0), ("k", NAN), ("k", None)], "k string, v double")
    assert [tuple(r) for r in ranks.counted(signed, ["k"], "v").select("v", "held", "n").collect()] == [(0.0, 2, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_intervals_of_tied_values(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {g: rng.integers(0, 12, rng.integers(1, 80)).astype(float) for g in "abcdef"}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "k string, v double").repartition(3)
    got = {r.k: (r.hdi_lo, r.hdi_hi) for r in ranks.shortest_interval(rows, ["k"], "v", 0.7).collect()}
    for g, vs in groups.items():
        s = np.sort(vs)
        k = min(int(math.floor(0.7 * len(s))), len(s) - 1)
        i = int((s[k:] - s[: len(s) - k]).argmin())
        assert got[g] == (s[i], s[i + k])


def test_rank_correlation_and_vectors_agree(spark):
    """Counted ranks, folds over arrays and numpy give the same metrics, with ties, flat sides, and missing values."""
    rng = np.random.default_rng(2)
    data = {g: (rng.integers(1, 6, n).astype(float), rng.integers(1, 6, n).astype(float)) for g, n in (("a", 40), ("b", 7), ("c", 3), ("d", 2), ("e", 1))} | {"flat": (np.ones(5), np.arange(5.0))}
    rows = [(g, float(t), float(o), float(p)) for g, (os, ps) in data.items() for t, (o, p) in enumerate(zip(os, ps))]
    rows += [("a", 100.0, None, 3.0), ("a", 101.0, 2.0, NAN), ("none", 1.0, None, 1.0), (None, 1.0, 1.0, 2.0), (None, 2.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "gene string, time double, obs double, pred double").repartition(4)
    whole = {r.gene: r.asDict() for r in metrics.fit_metrics(df, ["gene"]).collect()}
    folded = {r.gene: r.asDict() for r in vectors.fold_metrics(vectors.vectors(df, ["gene"], ["time", "obs", "pred"])).collect()}
    assert set(whole) == set(folded) == {*data, "none", None}
    for g in whole:
        for c in whole[g]:
            assert folded[g][c] == (pytest.approx(whole[g][c]) if isinstance(whole[g][c], float) else whole[g][c]), (g, c)
    diag = {r.gene: r for r in metrics.residual_diagnostics(df.where("obs IS NOT NULL AND NOT isnan(pred)"), ["gene"]).collect()}
    like = {r.gene: r for r in metrics.likelihood(df, ["gene"], 0.5, 3).collect()}
    for g in ("a", "b", "c"):
        assert folded[g]["variance_ratio"] == pytest.approx(diag[g].variance_ratio) and folded[g]["autocorrelation"] == pytest.approx(diag[g].autocorrelation)
        assert folded[g]["log_likelihood"] == pytest.approx(like[g].log_likelihood) and folded[g]["bic"] == pytest.approx(like[g].bic)
    average = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    for g in ("a", "b"):
        assert folded[g]["spearman"] == pytest.approx(np.corrcoef(*(average(x) for x in data[g]))[0, 1])
    assert folded["flat"]["spearman"] is None and folded["flat"]["nrmse_range"] is None and folded["none"]["n"] == 0
    assert like["a"].n == 40  # rows with one side only count nowhere


def test_dense_vectors(spark):
    rows = spark.createDataFrame([("a", 2.0, 1.0), ("a", 0.5, NAN), ("b", 1.0, 3.0), (None, 9.0, 1.0), ("b", None, 1.0), ("b", NAN, 1.0)], "gene string, time double, y double")
    got = {r.gene: [tuple(p) for p in r.series] for r in vectors.dense(rows, "gene", "time", "y").collect()}
    assert got == {"a": [(0.5, None), (1.0, None), (2.0, 1.0)], "b": [(0.5, None), (1.0, 3.0), (2.0, None)]}
    plan = vectors.fold_metrics(vectors.vectors(rows.select("gene", "time", F.col("y").alias("obs"), F.col("y").alias("pred")), ["gene"], ["time", "obs", "pred"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Window" not in plan


@pytest.mark.parametrize("most", [2, 100_000])
def test_densify_without_nested_loops(spark, monkeypatch, most):
    monkeypatch.setattr(etl, "MOST_INDEXES", most)
    rows = spark.createDataFrame([("a", float(i), 1.0) for i in range(5)] + [("b", 7.0, 2.0), ("b", NAN, 3.0)], "gene string, time double, y double")
    out = etl.densify(rows, "gene", "time", "y")
    assert out.count() == 12 and {(r.gene, r.time) for r in out.where("y IS NOT NULL").collect()} == {("a", float(i)) for i in range(5)} | {("b", 7.0)}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_missing_values_in_distributions(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 6)] + [("a", NAN), ("a", None), ("a", 100.0)], "k string, v double")
    box = dists.box(rows, ["k"], "v").first()
    assert box.fliers == 1 and (box.lo, box.hi) == (1.0, 5.0)
    assert {r.v: r.cdf for r in dists.ecdf(rows, "k", "v").collect()} == {1.0: 1 / 6, 2.0: 2 / 6, 3.0: 3 / 6, 4.0: 4 / 6, 5.0: 5 / 6, 100.0: 1.0}


def test_normal_distribution(spark):
    points = [x / 10 for x in range(-90, 91)]
    for r in spark.createDataFrame([(x,) for x in points], "x double").select("x", normal.cdf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(-r.x / math.sqrt(2)) / 2, rel=1e-7)
    shares = [1e-12, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.9, 0.999999]
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in [*shares, 0.0, 1.0]], "p double").select("p", normal.quantile(F.col("p")).alias("x")).collect()}
    assert got[0.0] is None and got[1.0] is None
    assert [got[p] for p in shares] == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in shares])


def test_smooth_cumulative_against_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    x = rng.gamma(2.0, 3.0, 3000)
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("a", NAN), ("one", 2.0), ("one", 2.0)], "k string, v double")
    out = sorted(dists.smooth_cumulative(rows, ["k"], "v", 20).collect(), key=lambda r: r.i)
    assert len(out) == 20
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in out:
        assert r.cdf == pytest.approx(np.mean([math.erfc(-(r.x - v) / h / math.sqrt(2)) / 2 for v in x]), abs=1e-6)


def plain_convergence(chains):
    """The published definitions, chain by chain; all chains of one length."""
    half = len(chains[0]) // 2
    norm = statistics.NormalDist()

    def scores(x):
        flat = np.concatenate(x)
        order = np.sort(flat)
        rank = (np.searchsorted(order, flat, "left") + np.searchsorted(order, flat, "right") + 1) / 2
        z = np.array([norm.inv_cdf((r - 0.375) / (len(flat) + 0.25)) for r in rank]).reshape(len(x), -1)
        return np.concatenate([z[:, :half], z[:, -half:]])

    def rhat(z):
        within, between = z.var(1, ddof=1).mean(), z.mean(1).var(ddof=1)
        return math.sqrt(((half - 1) / half * within + between) / within)

    chains = np.array(chains)
    bulk, tails = scores(chains), scores(np.abs(chains - np.median(chains)))
    centred = bulk - bulk.mean(1, keepdims=True)
    cov = np.array([(centred[:, : half - t] * centred[:, t:]).sum(1).mean() / half for t in range(half)])
    within = cov[0] * half / (half - 1)
    over_all = within * (half - 1) / half + bulk.mean(1).var(ddof=1)
    rho = 1 - (within - cov) / over_all
    rho[0] = 1
    total, last = 0.0, np.inf
    for j in range(half // 2):
        p = rho[2 * j] + rho[2 * j + 1]
        if p < 0:
            break
        last = min(last, p)
        total += last
    size = bulk.size
    return max(rhat(bulk), rhat(tails)), size / max(2 * total - 1, 1 / math.log10(size))


def test_convergence(spark):
    rng = np.random.default_rng(7)
    walk = lambda n, a: np.array([x := 0.0] + [x := a * x + rng.normal() for _ in range(n - 1)])  # noqa: E731,F841
    keys = {"good": [rng.normal(size=200) for _ in range(4)], "slow": [walk(200, 0.9) for _ in range(4)], "apart": [rng.normal(size=201) + i for i in range(3)], "coarse": [rng.integers(0, 4, 100).astype(float) for _ in range(2)]}
    rows = [(k, c, i, float(v)) for k, chains in keys.items() for c, chain in enumerate(chains) for i, v in enumerate(chain)]
    rows += [("short", 0, i, float(i)) for i in range(5)] + [("still", c, i, 1.0) for c in range(2) for i in range(20)] + [("good", 0, 1000, NAN), ("good", 1, 1000, None)]
    got = {r.k: r for r in diagnostics.convergence(spark.createDataFrame(rows, "k string, chain int, draw int, value double").repartition(4), ["k"]).collect()}
    for k, chains in keys.items():
        rhat, ess = plain_convergence(chains)
        assert (got[k].rhat, got[k].ess) == (pytest.approx(rhat), pytest.approx(ess)), k
        assert (got[k].chains, got[k].n_draws) == (len(chains), len(chains[0]))
    assert got["apart"].rhat > 1.2 > 1.05 > got["good"].rhat and got["slow"].ess < 150 < got["good"].ess
    assert got["short"].rhat is None and got["still"].rhat is None


def test_thinned_and_prior_draws(spark):
    draws = spark.createDataFrame([("a", i) for i in range(0, 70, 7)] + [("b", 1)], "gene string, draw int")
    assert sorted((r.gene, r.draw) for r in posterior.thinned(draws, ["gene"], 5).collect()) == [("a", d) for d in (7, 21, 35, 49, 63)] + [("b", 1)]
    starts = spark.createDataFrame([("a", 2.0)], "gene string, beta0 double")
    got = posterior.prior_draws(starts, models.PRIORS["basic"], 500).collect()
    logs = np.log([r.beta for r in got])
    assert len(got) == 500 and logs.mean() == pytest.approx(math.log(2), abs=0.05) and logs.std() == pytest.approx(1.0, abs=0.05)
