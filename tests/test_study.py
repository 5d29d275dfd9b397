"""The whole study from series to the merged table, and contracts checked on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import models
from tidewell.jobs import infer, study
from tidewell.operators import checks, series
from tidewell.sources import reports, sinks


def test_study(spark, tmp_path):
    t = np.array([0.0, 1.0, 2.0, 3.5, 5.0, 8.0, 12.0, 20.0])
    curves = {"ENSDARG01": infer.predict("basic", {"beta": 1.0, "delta": 0.2}, 20.0, t), "ENSDARG02": infer.predict("zga_z", {"beta": 2.0, "delta_z": 0.1, "delta_m": 1.0, "t_zga": 3.0}, 10.0, t)}
    rows = spark.createDataFrame([(g, float(a), float(b)) for g, y in curves.items() for a, b in zip(t, y)] + [("ENSDARG03", 0.0, 1.0)], "gene string, time double, y double")
    annotation = spark.createDataFrame([("ENSDARG01", 0.0, "maternal"), ("ENSDARG02", 2.0, "zygotic"), ("ENSDARG03", 1.0, "zygotic")], "ensembl_gene_id string, cluster double, type string")
    plan = study.Study(str(tmp_path / "study"), ("basic", "zga_z"), chains=2, warmup=300, draws=60, predictions=20, quadrature=100)
    out = {(r.model, r.gene): r for r in study.run(plan, rows, annotation).collect()}
    assert set(out) == {(m, g) for m in plan.models for g in curves}
    fit = out["basic", "ENSDARG01"]
    assert fit.accepted and fit.spearman > 0.9 and fit.nrmse_range < 0.1 and fit.nrmse_lower <= fit.nrmse <= fit.nrmse_upper and fit.type == "maternal"
    assert fit.bic == pytest.approx(3 * np.log(len(t)) - 2 * fit.loglik, rel=1e-6)
    fits, params = study.collected(plan, spark)
    assert fits.count() == 4 and {(r.model, r.t_zga_mean is None) for r in params.collect()} == {("basic", True), ("zga_z", False)}
    assert {r.model for r in params.where("delta_mean IS NOT NULL").collect()} == {"basic"}
    assert sinks.published(spark, plan.path + "/fits", "errors").where("gene = 'ENSDARG03'").count() == 4
    assert {(r.model, r.gene): r.bic for r in study.run(plan, rows, annotation).collect()} == {k: r.bic for k, r in out.items()}


def test_curves_are_those_of_the_sampler(spark):
    t = np.array([0.0, 2.0, 5.0, 12.0])
    given = {"alpha": 2.0, "beta": 1.0, "delta": 0.3, "delta_z": 0.1, "delta_m": 0.35, "t_zga": 3.0, "dt_rep": 6.0, "sigma": 0.5, "first": 4.0}
    area = np.concatenate([[0], np.cumsum(np.diff(t) * (np.clip(t - 3, 0, 1)[1:] + np.clip(t - 3, 0, 1)[:-1]) / 2)])
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, area)], "time double, exposure double").select("*", *(F.lit(v).alias(k) for k, v in given.items()))
    for name in models.PRIORS:
        got = [r.y for r in rows.select("time", models.curve(name).alias("y")).orderBy("time").collect()]
        assert np.allclose(got, infer.predict(name, {k: given[k] for k in models.PRIORS[name]}, 4.0, t), rtol=1e-6), name


def test_broken_contracts_name_their_key(spark):
    rows = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0), ("b", "m", None)], "gene string, model string, y double")
    assert checks.pivoted(rows, "gene", "model", "y", ["m", "n", "o"]).collect()[0].asDict() == {"gene": "a", "m": 1.0, "n": 2.0, "o": None}
    with pytest.raises(Exception, match="more than one value: gene = a, model = m"):
        checks.pivoted(rows.union(rows.where("gene = 'a'")), "gene", "model", "y", ["m", "n"]).collect()
    with pytest.raises(Exception, match="no y: gene = b"):
        checks.required(rows, "y", ["gene"]).collect()
    assert checks.required(rows.where("gene = 'a'"), "y", ["gene"]).count() == 2
    starts = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 1.0)], "gene string, time double, y double")
    assert series.initial_values(starts).where("m0 IS NULL").count() == 1
    with pytest.raises(Exception, match="no value at time 0: gene = b"):
        series.initial_values(starts, strict=True).collect()
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "gene string")
    assert sorted(r.model for r in checks.known(rows, ids("a"), "gene").collect()) == ["m", "n"]
    with pytest.raises(Exception, match="unknown gene: z"):
        checks.known(rows, ids("a", "z"), "gene").collect()
    obs = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 6.0)], "gene string, time double, obs double")
    pred = obs.withColumnRenamed("obs", "pred")
    assert sorted((r.time, r.obs, r.pred) for r in checks.paired(obs, pred, ["gene", "time"]).collect()) == [(1.0, 5.0, 5.0), (2.0, 6.0, 6.0)]
    with pytest.raises(Exception, match="not predicted once: gene = a, time = 2.0"):
        checks.paired(obs, pred.where("time < 2"), ["gene", "time"]).collect()
    with pytest.raises(Exception, match="not observed once: gene = a, time = 1.0"):
        checks.paired(obs.where("time > 1"), pred, ["gene", "time"]).collect()
    assert [r.gene for r in reports.without_file(ids("a", "q"), rows, "gene").collect()] == ["q"]
    seen_rows, seen = checks.watched(obs, "obs", F.max("time").alias("last"))
    seen_rows.collect()
    assert seen.get == {"rows": 2, "last": 2.0}
