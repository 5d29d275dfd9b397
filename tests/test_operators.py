"""Operators on hand-made rows: missing values, ties, flat series, repeats."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.functions import models, safe
from tidewell.jobs import infer
from tidewell.jobs.queries import ORACLE_SQL, QUERIES
from tidewell.operators import collect, compare, dists, etl, metrics, posterior, ranks, series
from tidewell.sources import reports, sinks

NAN = float("nan")


def test_series_from_wide(spark):
    wide = spark.createDataFrame([("g", "t1", 1.0, None, 3.0), ("g", "t2", 2.0, NAN, 4.0)], "ensembl_gene_id string, ensembl_transcript_id string, s1 double, s2 double, s3 double")
    samples = spark.createDataFrame([("s1", 0.0), ("s2", 0.0)], "sample_id string, time_hpf double")
    assert [tuple(r) for r in etl.series_from_wide(wide, samples).collect()] == [(0.0, "g", 1.5)]


def test_initial_values(spark):
    rows = spark.createDataFrame([("a", float(t), float(y)) for t, y in enumerate([4, 9, 2, 7, 5, 1, 3])] + [("b", 1.0, 2.0)], "gene string, time double, y double")
    out = {r.gene: r for r in series.initial_values(rows).collect()}
    assert (out["a"].m0, out["a"].z_ss0, out["a"].z_max0) == (4.0, 3.0, 7.0)
    assert out["b"].m0 is None and out["b"].z_max0 is None and out["b"].first == 2.0


def test_regrid(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0)], "gene string, time double, y double")
    grid = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 0.5, 2.0, 3.0)], "gene string, time double")
    assert {r.time: r.y for r in series.regrid(rows, grid).collect()} == {-1.0: None, 0.0: 0.0, 0.5: 1.0, 2.0: 4.0, 3.0: None}


def test_metrics_of_flat_series(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("a", 2.0, 1.0, 3.0), ("b", 1.0, 1.0, 1.0), ("b", 2.0, 2.0, 2.0), ("b", 3.0, 2.0, 2.0)], "gene string, time double, obs double, pred double")
    out = {r.gene: r for r in metrics.fit_metrics(rows, ["gene"]).collect()}
    assert out["a"].spearman is None and out["a"].nrmse_range is None and out["a"].mase is None
    assert out["b"].spearman == pytest.approx(1) and out["b"].mase == 0
    flags = spark.createDataFrame([(NAN, 0.1, 0.5), (None, 0.1, 0.5), (0.8, 0.1, 0.5), (0.7, 0.1, 0.5)], "spearman double, nrmse_range double, mase double")
    assert [r[0] for r in flags.select(compare.accepted()).collect()] == [False, False, True, False]


def test_hdi(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (0, 1, 2, 3, 100)] + [("b", 5.0), ("c", NAN)], "k string, v double")
    out = {r.k: (r.hdi_lo, r.hdi_hi) for r in posterior.hdi_by(rows, ["k"], "v", 0.6).collect()}
    assert out == {"a": (0.0, 3.0), "b": (5.0, 5.0), "c": (None, None)}


def test_packed_parameters(spark):
    rows = [("g", "b", "1.2e+05 ± 3.1e+04", 1), ("g", "a", "1 ± 2", 1), ("g", "a", "1e-05 ± 2e-06", 2), ("g", "c", "nan ± nan", 1), ("g", "", "1 ± 1", 1)]
    out = collect.parameters_wide(spark.createDataFrame(rows, "gene string, param string, value string, line int"), ["gene"], "line")
    assert out.columns == ["gene", "a_mean", "b_mean", "a_std", "b_std"] and tuple(out.first())[1:] == (1e-05, 1.2e05, 2e-06, 3.1e04)
    digits = spark.range(1).select(safe.significant(F.lit(123456.0)), safe.significant(F.lit(0.0012345)), safe.significant(F.lit(0.0))).first()
    assert digits[0] == 123000.0 and digits[1] == pytest.approx(0.00123) and digits[2] == 0


def test_report_files(spark, tmp_path):
    for gene, ll in (("ENSDARG00000000018", "-7.214646816253662"), ("ENSDARG00000000019", "")):
        (tmp_path / gene).mkdir()
        (tmp_path / gene / "goodness_of_fit.csv").write_text(f",y,model\nNRMSE,0.2338,\nLog-Likelihood,{ll},\nBIC,,34.662\n")
    rows = reports.goodness_of_fit(spark, str(tmp_path))
    assert [tuple(r) for r in rows.where("y IS NOT NULL AND gene_id LIKE '%18'").select("line", "metric", "y").collect()] == [(2, "NRMSE", 0.2338), (3, "Log-Likelihood", -7.214646816253662)]
    out = {r.gene_id: (r.nrmse, r.loglik, r.bic) for r in collect.goodness_wide(rows, ["gene_id"], "line").collect()}
    assert out == {"ENSDARG00000000018": (0.2338, -7.214646816253662, 34.662), "ENSDARG00000000019": (0.2338, None, 34.662)}
    assert -2 * -7.2146 + 7 * math.log(18) == pytest.approx(34.662, abs=1e-3)


def test_settings(spark):
    lines = spark.createDataFrame(list(enumerate(["[jax]", "rtol = 1e-4", "", "# no", "[params]", "beta = lognorm(scale=1.5, s=0.5)"], 1)), "line int, value string")
    out = reports.settings(lines)
    assert {(r.section, r.key): r.value for r in out.collect()} == {("jax", "rtol"): "1e-4", ("params", "beta"): "lognorm(scale=1.5, s=0.5)"}
    assert tuple(out.where("key = 'beta'").select(*reports.lognormal_terms(F.col("value"))).first()) == (1.5, 0.5)


def test_models_agree(spark):
    """The column expressions and the sampler's numpy curves are the same functions."""
    import numpy as np

    t = np.array([0.0, 2.0, 5.0, 12.0])
    p = {"alpha": 2.0, "beta": 1.0, "delta_z": 0.1, "delta_m": 0.35, "t_zga": 3.0, "dt_rep": 6.0}
    z = models.zygotic(F.col("t"), F.lit(0.1), lambda u: models.production(u, F.lit(1.0), F.lit(3.0), F.lit(2.0), F.lit(6.0)))
    rows = spark.createDataFrame([(float(x),) for x in t], "t double").select("t", (models.maternal(F.lit(4.0), F.lit(0.35), F.col("t")) + z).alias("y")).orderBy("t").collect()
    assert np.allclose([r.y for r in rows], infer.predict("rep_m", p, 4.0, t, n=1000), rtol=1e-6)


def test_fit_is_whole(spark, data, monkeypatch):
    """All models with the reference's chains, warm-up, draws and quadrature; failed chains stay as rows."""
    import inspect

    from tidewell.functions.models import PRIORS
    from tidewell.jobs import queries

    set_ = {k: p.default for k, p in inspect.signature(infer.sample).parameters.items()}
    assert (set_["warmup"], set_["draws"]) == (1000, 2000) and inspect.signature(infer.fit).parameters["chains"].default == 4
    assert inspect.signature(infer.predict).parameters["n"].default == 1000
    series = spark.createDataFrame([(g, float(i), 5.0 + i) for g, n in (("long", 5), ("short", 2)) for i in range(n)], "gene string, time double, y double")
    monkeypatch.setattr(queries, "table", lambda *_: None)
    monkeypatch.setattr(queries, "daily_series", lambda _: series)
    rows = queries.mcmc_fit(spark, data).collect()
    assert sorted((r.model, r.param) for r in rows if r.gene == "long") == sorted((m, p) for m in PRIORS for p in PRIORS[m])
    assert sorted((r.model, r.chain, r.error) for r in rows if r.gene == "short") == sorted((m, c, "fewer than three observations") for m in PRIORS for c in range(4))


def test_sampler_recovers_decay(spark):
    import numpy as np

    t = np.linspace(0, 30, 18)
    y = infer.predict("basic", {"beta": 1.0, "delta": 0.2}, 20.0, t)
    draws = infer.sample("basic", t, y, seed=1)
    assert np.median(draws["delta"]) == pytest.approx(0.2, rel=0.25) and np.median(draws["beta"]) == pytest.approx(1.0, rel=0.25)
    bad = spark.createDataFrame([("g", 0.0, 1.0)], "gene string, time double, y double")
    assert [r.error for r in infer.fit(bad, ["basic"], 1).collect()] == ["fewer than three observations"]


def test_reports_by_line(spark, tmp_path):
    """First metric and last parameter by line number in the file, whatever the order of the rows; nine columns."""
    gene = tmp_path / "a" / "ENSDARG00000000020"
    gene.mkdir(parents=True)
    ends = ("", " (95%-hdi[lower])", " (95%-hdi[upper])")
    lines = [f"{m}{e},{i}.5,{i}.25" for i, (m, e) in enumerate((m, e) for m in ("NRMSE", "Log-Likelihood", "BIC") for e in ends)]
    (gene / "goodness_of_fit.csv").write_text("\n".join([",y,model", *lines, "NRMSE,99,99", "n (data),18,18"]) + "\n")
    wide = collect.goodness_wide(reports.goodness_of_fit(spark, str(tmp_path)), ["gene_id"], "line").first()
    assert tuple(wide)[1:] == (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.25, 7.25, 8.25)
    (gene / "report_table_parameter_estimates.csv").write_text(",mean ± std\n be ta ,1 ± 2\n,3 ± 4\nbeta,1.2e+05 ± 3.1e+04\ngamma,nan ± nan\n")
    wide = collect.parameters_wide(reports.parameter_estimates(spark, str(tmp_path)), ["gene_id"], "line")
    assert wide.columns == ["gene_id", "beta_mean", "beta_std"] and tuple(wide.first()) == ("ENSDARG00000000020", 1.2e05, 3.1e04)
    assert reports.file_count(spark, str(tmp_path), "goodness_of_fit.csv") == 1


def test_lines_lists_and_settings(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/x/y/g1/\n\n z/g2\r\nlast")
    assert [tuple(r) for r in reports.numbered_lines(spark, str(tmp_path / "list.txt"), 3, 4).collect()] == [(3, " z/g2"), (4, "last")]
    assert [(r.line, r.name) for r in reports.path_list(spark, str(tmp_path / "list.txt")).collect()] == [(1, "g1"), (3, "g2"), (4, "last")]
    for name, value in (("a", "1"), ("b", "2")):
        (tmp_path / f"{name}.cfg").write_text(f"top = 0\n[jax]\nrtol = {value}\n")
    found = reports.settings(reports.file_lines(spark, str(tmp_path), "*.cfg")).collect()
    assert sorted(((r.path[-5:], r.section, r.key, r.value) for r in found), key=str) == sorted([("a.cfg", None, "top", "0"), ("a.cfg", "jax", "rtol", "1"), ("b.cfg", None, "top", "0"), ("b.cfg", "jax", "rtol", "2")], key=str)
    row = spark.range(1).select(reports.terms(F.lit("lognorm(scale=1.5, s=0.5)")).alias("a"), reports.terms(F.lit("y=0 z=x_1")).alias("b"), reports.lognormal_text(F.lit(1.5), F.lit(0.5)).alias("c"), reports.case_name(F.lit("m"), F.lit("nuts"), F.lit(120)).alias("d")).first()
    assert row.a == {"scale": "1.5", "s": "0.5"} and row.b == {"y": "0", "z": "x_1"} and row.c == "lognorm(scale=1.5, s=0.5)" and row.d == "m_nuts_120"


def test_tables_from_csv(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("ensembl_gene_id,ensembl_transcript_id,s1,s2\ng,t,1.5,\n")
    assert tuple(reports.wide_matrix(spark, str(tmp_path / "wide.csv")).first()) == ("g", "t", 1.5, None)
    (tmp_path / "samples.csv").write_text("x,sample_id,time_hpf\n1,s1,2.5\n1,s2,none\n")
    assert [tuple(r) for r in reports.sample_table(spark, str(tmp_path / "samples.csv")).collect()] == [("s1", 2.5), ("s2", None)]
    (tmp_path / "clusters.csv").write_text("ensembl_gene_id,cluster,type\na,1.0,maternal\nb,,zygotic\nc,-1,zygotic\nd,nan,zygotic\n")
    rows = reports.annotation(spark, str(tmp_path / "clusters.csv"))
    assert [r[0] for r in compare.clustered(rows).collect()] == ["a"] and [r[0] for r in compare.clustered(rows, noise=True).collect()] == ["a", "c"]
    paths = {}
    for m in ("x", "y"):
        (tmp_path / f"{m}.csv").write_text("GeneID,Spearman\ng1,0.5\nGeneID,Spearman\ng2,nan\n")
        paths[m] = str(tmp_path / f"{m}.csv")
    assert sorted(map(tuple, reports.summaries(spark, paths).collect()), key=str) == [("x", "g1", 0.5), ("x", "g2", None), ("y", "g1", 0.5), ("y", "g2", None)]


def test_merge_models(spark):
    metrics_ = spark.createDataFrame([("m1", "a", 0.5), ("m2", "a", 0.6), ("m1", "GeneID", None), ("m1", "b", 0.1)], "model string, gene_id string, spearman double")
    fits = spark.createDataFrame([("m1", "a", 1.0), ("m2", "a", 2.0), ("m1", "b", 3.0)], "model string, gene_id string, bic double")
    annotation = spark.createDataFrame([("a", 1.0), ("b", NAN), ("c", 2.0)], "ensembl_gene_id string, cluster double")
    out = compare.merge_models(metrics_, fits, annotation)
    assert sorted(map(tuple, out.select("model", "gene_id", "spearman", "bic", "cluster").collect())) == [("m1", "a", 0.5, 1.0, 1.0), ("m2", "a", 0.6, 2.0, 1.0)]
    assert {(r.gene_id, r.cluster) for r in compare.annotated(fits, annotation.where("ensembl_gene_id = 'a'")).collect()} == {("a", 1.0), ("b", None)}
    labelled = compare.labelled(spark.createDataFrame([(0,), (9,)], "c int"), "c", compare.CLUSTERS, "name")
    assert [tuple(r) for r in labelled.collect()] == [(0, "SD"), (9, None)]


def test_incomplete_rows_in_metrics(spark):
    """Rows without one side count nowhere; a series without complete rows stays with n = 0."""
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, None), ("a", 100.0, NAN), ("b", 1.0, None)], "gene string, obs double, pred double")
    out = {r.gene: r for r in metrics.fit_metrics(rows, ["gene"]).collect()}
    assert out["a"].n == 2 and out["a"].nrmse_range == pytest.approx(0.5**0.5) and out["a"].mase == 1 and out["a"].spearman == pytest.approx(1)
    assert out["b"].n == 0 and out["b"].spearman is None and out["b"].rmse is None
    assert {r.gene: (r.n, r.mase) for r in metrics.errors(rows, ["gene"]).collect()} == {"a": (2, 1)}


def test_densify_on_observed_times(spark):
    rows = spark.createDataFrame([("a", 0.25, 1.0), ("b", 2.0, 2.0), (None, 7.0, 1.0)], "gene string, time double, y double")
    assert sorted(map(tuple, etl.densify(rows, "gene", "time", "y").collect()), key=str) == [("a", 0.25, 1.0), ("a", 2.0, None), ("b", 0.25, None), ("b", 2.0, 2.0)]
    assert etl.densify(rows.limit(0), "gene", "time", "y").count() == 0


def test_regrid_of_long_series(spark):
    """Twice the knots take about twice the time, since no frame is read again for each row."""
    rows = spark.range(20_000).selectExpr("'a' AS gene", "CAST(id AS double) AS time", "CAST(id * 2 AS double) AS y")
    grid = spark.range(20_000).selectExpr("'a' AS gene", "id + 0.5 AS time").selectExpr("gene", "CAST(time AS double) AS time")
    import time

    began = time.time()
    out = series.regrid(rows, grid).where("y IS NOT NULL AND y = 2 * time").count()
    assert out == 19_999 and time.time() - began < 15


def test_ranks_of_hot_groups(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = [("hot", float(x)) for x in rng.normal(size=3000).round(2)] + [("cold", 1.0), ("cold", 2.0), ("none", None), (None, 4.0)]
    rows = spark.createDataFrame(values, "k string, v double").repartition(5)
    out = {r.k: r for r in ranks.percentiles(rows, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).collect()}
    hot = np.array([v for k, v in values if k == "hot"])
    assert (out["hot"].lo, out["hot"].mid, out["hot"].hi) == pytest.approx(tuple(np.quantile(hot, [0.05, 0.5, 0.95])))
    assert out["cold"].mid == 1.5 and out[None].mid == 4.0 and "none" not in out
    whole = ranks.percentiles(rows, [], "v", {"mid": 0.5}).first()[0]
    assert whole == pytest.approx(np.quantile([v for _, v in values if v is not None], 0.5))
    s = np.sort(hot)
    k = int(0.95 * len(s))
    widths = np.round(s[k:] - s[: len(s) - k], 9)
    at = int(widths.argmin())
    spans = {r.k: (r.hdi_lo, r.hdi_hi) for r in ranks.shortest_interval(rows, ["k"], "v").collect()}
    assert spans["hot"] == (s[at], s[at + k]) and spans["none"] == (None, None) and spans[None] == (4.0, 4.0)


def test_draws_to_goodness(spark):
    """The chain from draws to a report: predictions, scores of each draw, BIC = k ln n - 2 LL, means and intervals."""
    import numpy as np

    t, first = np.arange(1.0, 7.0), 10.0
    obs = first * np.exp(-0.3 * t) + 1.0
    draws = [("g", d, 0.5 + d / 50, 0.2 + d / 100, 0.4) for d in range(20)]
    times = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(t, obs)], "gene string, time double, obs double")
    frame = spark.createDataFrame(draws, "gene string, draw long, beta double, delta double, sigma double")
    curve = models.basic(F.lit(first), F.col("beta"), F.col("delta"), F.col("time"))
    scores = posterior.fit_of_draws(posterior.predictive(frame, times, ["gene"], curve), ["gene"], free=3)
    got = {r.draw: r for r in scores.collect()}
    for _, d, beta, delta, sigma in draws:
        pred = infer.predict("basic", {"beta": beta, "delta": delta}, first, t)
        r = np.log1p(obs) - np.log1p(pred)
        ll = (-0.5 * np.log(2 * np.pi * sigma**2) - r**2 / (2 * sigma**2)).sum()
        assert got[d].log_likelihood == pytest.approx(ll) and got[d].bic == pytest.approx(3 * np.log(6) - 2 * ll)
        assert got[d].nrmse == pytest.approx(np.sqrt(((obs - pred) ** 2).mean()) / np.ptp(obs))
    report = {r.metric: r for r in posterior.goodness_of_draws(scores, ["gene"]).collect()}
    assert report["bic"].mean == pytest.approx(np.mean([r.bic for r in got.values()])) and report["bic"].lower <= report["bic"].mean <= report["bic"].upper
    # the files of the published fits keep the same identity
    for k, ll, bic in ((3, -17.876699447631836, 44.424500964612825), (5, -22.904, 60.260), (7, -7.2146, 34.662)):
        assert k * math.log(18) - 2 * ll == pytest.approx(bic, abs=1e-2)
    noisy = lambda seed: {(r.draw, r.time): r.pred for r in posterior.predictive(frame, times, ["gene"], curve, F.col("sigma"), seed).collect()}
    a, b, plain = noisy(1), noisy(2), {(r.draw, r.time): r.pred for r in posterior.predictive(frame, times, ["gene"], curve).collect()}
    assert a == noisy(1) and a != b and abs(np.std([math.log1p(a[x]) - math.log1p(plain[x]) for x in a]) - 0.4) < 0.1


def test_fitted_draws_are_scored(spark):
    """Draws of the sampler, as columns, through the same chain for a model with a quadrature."""
    import numpy as np

    t = np.linspace(0, 30, 10)
    y = infer.predict("zga_m", {"beta": 1.0, "delta_z": 0.2, "delta_m": 0.3, "t_zga": 3.0}, 20.0, t)
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(t, y)], "gene string, time double, y double")
    wide = infer.wide_draws(infer.fit(rows, ["zga_m"], chains=2, warmup=300, draws=50), "zga_m")
    assert wide.count() == 100
    z = models.zygotic(F.col("time"), F.col("delta_z"), lambda u: models.production(u, F.col("beta"), F.col("t_zga")))
    curve = models.maternal(F.lit(20.0), F.col("delta_m"), F.col("time")) + z
    scores = posterior.fit_of_draws(posterior.predictive(wide, rows.withColumnRenamed("y", "obs"), ["gene"], curve), ["gene"], free=len(models.PRIORS["zga_m"]))
    assert scores.agg(F.avg("nrmse")).first()[0] < 0.2


def test_sinks_write_nothing_twice(spark, tmp_path):
    draws = spark.createDataFrame([("g", "m", 0, 0, "beta", 1.0, None), ("g", "m", 1, None, None, None, "bad"), ("h", "n", 0, 0, "beta", 2.0, None)], infer.DRAWS)
    path = str(tmp_path / "fits")
    todo = draws.select("gene", "model", "chain").distinct()
    assert sinks.pending_fits(todo, path).count() == 3
    sinks.write_fits(draws.where("gene = 'g'"), path)
    assert [tuple(r) for r in sinks.pending_fits(todo, path).collect()] == [("h", "n", 0)]
    for _ in range(2):
        sinks.write_fits(draws, path)
    assert reports.posterior(spark, f"{path}/draws").count() == 2 and reports.posterior(spark, f"{path}/errors", model="m").count() == 1
    assert reports.posterior(spark, f"{path}/draws", model="n", genes=["h"]).first().value == 2.0
    table = spark.createDataFrame([("m", "g", 0.5), ("n", "g", 0.6)], "model string, gene string, spearman double")
    assert sinks.append_new(table, str(tmp_path / "t"), ["model", "gene"], ["model"]) == 2
    assert sinks.append_new(table, str(tmp_path / "t"), ["model", "gene"], ["model"]) == 0
    sinks.write_merged(table, str(tmp_path / "merged"))
    sinks.write_report(table, str(tmp_path / "report"), ["model"])
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2 and (tmp_path / "merged" / "model=m").is_dir()


def test_residuals_have_an_inverse(spark):
    row = spark.createDataFrame([(3.0, 5.0)], "obs double, pred double").select(models.observe(models.residual(F.col("obs"), F.col("pred")), F.col("pred")).alias("back")).first()
    assert row.back == pytest.approx(3.0)


def test_shared_edges_and_grids(spark):
    rows = spark.createDataFrame([("m", "x", 0.0), ("m", "x", 5.0), ("m", "y", 10.0), ("m", "y", NAN), ("n", "x", 1.0)], "model string, hue string, v double")
    got = {(r.model, r.hue, r.bin): r.n for r in dists.histogram(rows, ["model", "hue"], "v", 10, edges=["model"]).collect()}
    assert got == {("m", "x", 1): 1, ("m", "x", 6): 1, ("m", "y", 10): 1, ("n", "x", 1): 1}
    assert {(r.hue, r.bin): r.n for r in dists.histogram(rows, ["hue"], "v", 10, edges=[]).collect()} == {("x", 1): 1, ("x", 2): 1, ("x", 6): 1, ("y", 10): 1}
    grid = {(r.hue, r.i): (r.x, r.cdf) for r in dists.cumulative(rows, ["hue"], "v", 5).collect()}
    assert grid["x", 0] == (0.0, pytest.approx(1 / 3)) and grid["x", 2] == (5.0, 1.0) and grid["y", 3] == (7.5, 0.0) and grid["y", 4] == (10.0, 1.0)
    counts = {(r.hue, r.model): (r.place, r.n) for r in compare.ordered_counts(rows, ["hue"], "model", ["m", "z"]).collect()}
    assert counts == {("x", "m"): (1, 2), ("x", "z"): (2, 0), ("y", "m"): (1, 2), ("y", "z"): (2, 0)}
    assert {r.variable: (r.min, r.max) for r in dists.extremes(rows, ["v"]).collect()} == {"v": (0.0, 10.0)}


def test_two_level_mean_in_tasks_by_rows(spark, data, monkeypatch):
    """The number of tasks goes with the rows, not with the session's partitions; a group of many samples is summed in parts."""
    monkeypatch.setattr(etl, "TASK_ROWS", 5000, raising=False)
    lines, orders = (spark.read.parquet(f"{data}/{name}.parquet").count() for name in ("lineitem", "orders"))
    out = QUERIES["gene_time_mean"](spark, data)
    assert out.rdd.getNumPartitions() == -(-(lines + orders) // 5000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT l_partkey, time, y FROM ({ORACLE_SQL['gene_time_mean']})").fetchall())
    rows = [("a", i % 3000, float(i)) for i in range(6000)] + [("b", 1, None), ("b", 1, float("nan")), ("c", 1, 2.0), ("c", 2, 5.0), (None, 1, 1.0), ("c", None, 1.0)]
    long = spark.createDataFrame(rows, "g string, sample long, v double")
    plain, dealt = ({r.g: r.y for r in etl.two_level_mean(long, ["g"], "sample", "v", tasks=t).collect()} for t in (None, 7))
    assert plain == dealt == {"a": 5999.0, "b": 0.0, "c": 3.5}
