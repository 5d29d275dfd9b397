"""Files in and out: matrices, summaries, the settings language, report trees, the store of fits."""

import pytest
from pyspark.sql import functions as F

from tidewell.jobs import infer
from tidewell.operators import collect
from tidewell.sources import reports, sinks


def test_matrix_by_name(spark, tmp_path):
    """Columns are found by their names, in whatever order the file and the caller have them."""
    (tmp_path / "wide.csv").write_text("ensembl_transcript_id,s1,ensembl_gene_id,s.2,s3\nt,1.5,g,x,nan\nu,2,h,4e1,\n")
    path = str(tmp_path / "wide.csv")
    got = reports.wide_matrix(spark, path, ["s.2", "s1"])
    assert got.columns == ["ensembl_gene_id", "ensembl_transcript_id", "s.2", "s1"]
    assert sorted(map(tuple, got.collect())) == [("g", "t", None, 1.5), ("h", "u", 40.0, 2.0)]
    assert [tuple(r)[2:] for r in reports.wide_matrix(spark, path).orderBy("ensembl_gene_id").collect()] == [(1.5, None, None), (2.0, 40.0, None)]
    with pytest.raises(ValueError, match="s9"):
        reports.wide_matrix(spark, path, ["s1", "s9"])


def test_summaries_keep_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text("GeneID,Spearman,type,model\ng1,0.5,maternal,other\nGeneID,Spearman,type,model\ng2,nan,zygotic,other\n")
    (tmp_path / "y.csv").write_text("GeneID,note,BIC\ng1,fine,1e3\n")
    out = reports.summaries(spark, {"x": str(tmp_path / "x.csv"), "y": str(tmp_path / "y.csv")}, (*reports.TEXT, "note"))
    assert sorted((r.model, r.GeneID, r.Spearman, r.type, r.note, r.BIC) for r in out.orderBy("model", "GeneID").collect()) == [("x", "g1", 0.5, "maternal", None, None), ("x", "g2", None, "zygotic", None, None), ("y", "g1", None, None, "fine", 1000.0)]
    assert reports.summaries(spark, {}).count() == 0


#: Lines of the three shipped settings files that use the small language, with what they say.
LINES = {
    "value=11.57115941 dims=[] prior=lognorm(scale=11.57115941,s=0.5) hyper=False free=True": {"value": "11.57115941", "dims": "[]", "prior": "lognorm(scale=11.57115941,s=0.5)", "hyper": "False", "free": "True"},
    "value=5 dims=[] hyper=False free=False": {"value": "5", "dims": "[]", "hyper": "False", "free": "False"},
    "dimensions=['time'] min=6.5564108 max=115.71159399999999 observed=True": {"dimensions": "['time']", "min": "6.5564108", "max": "115.71159399999999", "observed": "True"},
    "dimensions=['time'] min=nan max=nan observed=False": {"dimensions": "['time']", "min": "nan", "max": "nan", "observed": "False"},
    "M=6.5564108 Z=0.0": {"M": "6.5564108", "Z": "0.0"},
    "normal(loc=0,scale=sigma_y,obs=jnp.log1p(obs)-jnp.log1p(y),obs_inv=jnp.expm1(res+jnp.log1p(y)))": {"loc": "0", "scale": "sigma_y", "obs": "jnp.log1p(obs)-jnp.log1p(y)", "obs_inv": "jnp.expm1(res+jnp.log1p(y))"},
    "lognorm(scale=3.0,s=1.0)": {"scale": "3.0", "s": "1.0"},
    "t time interpolation results": {},
    "": {},
    "f(a = g(1, h(2, 3)), b=[4, 5]) ": {"a": "g(1, h(2, 3))", "b": "[4, 5]"},
    "a=1 b=2 a=3": {"a": "3", "b": "2"},
    "f(a=1) g(b=2)": {},
    "a==b c=": {"a": "=b", "c": ""},
}


def test_settings_language(spark):
    rows = spark.createDataFrame([(t,) for t in LINES], "value string")
    got = {r.value: r.terms for r in rows.select("value", reports.terms(F.col("value")).alias("terms")).collect()}
    for text, want in LINES.items():
        if text not in ("f(a=1) g(b=2)", "a==b c="):
            assert got[text] == want, text
    assert got["f(a=1) g(b=2)"] == {"f(a": "1)", "g(b": "2)"}  # two calls are none; each is split outside of brackets only
    assert spark.range(1).select(reports.terms(F.lit(None).cast("string"))).first()[0] is None


SETTINGS = """[case-study]
name = case
[data-structure]
y = dimensions=['time'] min=6.5 max=115.7 observed=True
M = dimensions=['time', 'batch'] min=nan max=nan observed=False
[model-parameters]
beta = value=1.64 dims=[] prior=lognorm(scale=1.64,s=0.5) hyper=False free=True
s = value=5 dims=[] hyper=False free=False
"""


def test_typed_settings(spark, tmp_path):
    (tmp_path / "settings.cfg").write_text(SETTINGS)
    rows = reports.settings(reports.file_lines(spark, str(tmp_path), "settings.cfg"))
    got = {r.name: (r.value, r.dims, r.median, r.sd, r.hyper, r.free) for r in reports.parameters(rows).collect()}
    assert got == {"beta": (1.64, [], 1.64, 0.5, False, True), "s": (5.0, [], None, None, False, False)}
    got = {r.name: (r.dimensions, r.min, r.max, r.observed) for r in reports.variables(rows).collect()}
    assert got == {"y": (["time"], 6.5, 115.7, True), "M": (["time", "batch"], None, None, False)}
    broken = spark.createDataFrame([("model-parameters", "beta", "value=1 prior=uniform(0, 1) free=True")], "section string, key string, value string")
    with pytest.raises(Exception, match="parameter beta is free"):
        reports.parameters(broken).collect()


def test_settings_there_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for gene in ("ENSDARG00000000018", "ENSDARG00000000019"):
        (tmp_path / "in" / gene).mkdir()
        (tmp_path / "in" / gene / "settings.cfg").write_text("top = 1\n" + SETTINGS.replace("case\n", f"{gene}\n"))
    rows = reports.settings(reports.file_lines(spark, str(tmp_path / "in"), "settings.cfg"))
    keyed = rows.select(F.regexp_extract("path", reports.GENE, 0).alias("gene"), "section", "key", "value")
    text = sinks.settings_text(keyed.withColumnRenamed("gene", "path")).withColumnRenamed("path", "gene")
    sinks.write_texts(text, str(tmp_path / "out"), "gene")
    back = reports.settings(reports.file_lines(spark, str(tmp_path / "out"), "*.txt")).select(F.regexp_extract("path", reports.GENE, 0).alias("gene"), "section", "key", "value")
    assert back.count() == keyed.count() == 12 and back.exceptAll(keyed).count() == 0


def test_reports_there_and_back(spark, tmp_path):
    """Report trees that are written are read back as they were, one folder a series."""
    genes = ("ENSDARG00000000001", "ENSDARG00000000002")
    fit = [(g, i + 2, m, y, model) for g in genes for i, (m, y, model) in enumerate((("NRMSE", 0.25, None), ("NRMSE (95%-hdi[lower])", 0.125, None), ("Log-Likelihood", -7.214646816253662, None), ("BIC", None, 34.5), ("n (data)", 18.0, None)))]
    goodness = spark.createDataFrame(fit, "gene_id string, line long, metric string, y double, model double").repartition(3)
    estimated = spark.createDataFrame([(genes[0], "beta", "1.2e+05 ± 3.1e+04"), (genes[0], "alpha", "1.0 ± 0.5")], "gene_id string, param string, packed string")
    path = str(tmp_path / "reports")
    for _ in range(2):  # a second run leaves the same tree
        sinks.write_reports(goodness, estimated, path, "gene_id")
    back = reports.goodness_of_fit(spark, f"{path}/goodness_of_fit", "*.txt")
    assert sorted(map(tuple, back.select("gene_id", "line", "metric", "y", "model").collect()), key=str) == sorted(fit, key=str)
    assert reports.file_count(spark, f"{path}/goodness_of_fit", "*.txt") == 2
    rows = reports.parameter_estimates(spark, f"{path}/parameter_estimates", "*.txt")
    assert sorted((r.gene_id, r.param, r.value) for r in rows.collect()) == sorted(map(tuple, estimated.collect()))
    assert tuple(collect.parameters_wide(rows, ["gene_id"], "line").first())[1:] == (1.0, 1.2e05, 0.5, 3.1e04)
    text = {r.gene_id: r.text for r in sinks.report_text(goodness, estimated, ["gene_id"]).collect()}
    assert "| NRMSE | 0.25" in text[genes[0]] and "| beta | 1.2e+05 ± 3.1e+04 |" in text[genes[0]] and "none" in text[genes[1]]


def test_fits_are_computed_once_and_shown_whole(spark, tmp_path, monkeypatch):
    """A run is computed once; a run that broke off shows nothing and is done again; a second call fits nothing."""
    path = str(tmp_path / "fits")
    series = spark.createDataFrame([(g, float(t), float(t) + 1) for g in ("a", "b") for t in range(5)] + [("bad", 0.0, 1.0), ("low", 0.0, -2.0), ("low", 1.0, 1.0), ("low", 2.0, 1.0)], "gene string, time double, y double")
    computed = spark.sparkContext.accumulator(0)
    inner = infer._fit

    def counting(warmup, draws):
        run = inner(warmup, draws)

        def wrapped(rows):
            computed.add(1)
            return run(rows)

        return wrapped

    monkeypatch.setattr(infer, "_fit", counting)
    assert infer.fit_pending(series, ["basic"], path, chains=2, warmup=50, draws=20) == 8 and computed.value == 8
    draws, errors = sinks.published(spark, path, "draws"), sinks.published(spark, path, "errors")
    assert draws.select("gene", "chain").distinct().count() == 4
    assert sorted({(r.gene, r.error) for r in errors.collect()}) == [("bad", "fewer than three observations"), ("low", "values must be above -1")]
    assert infer.fit_pending(series, ["basic"], path, chains=2, warmup=50, draws=20) == 0 and computed.value == 8
    # a run whose files are there but which no manifest names
    left = spark.createDataFrame([("c", 0, 0, "beta", 1.0, "broken", "basic")], "gene string, chain int, draw int, param string, value double, run string, model string")
    left.write.mode("append").partitionBy("run", "model").parquet(f"{path}/draws")
    assert sinks.published(spark, path, "draws").where("gene = 'c'").count() == 0
    more = series.union(series.where("gene = 'a'").withColumn("gene", F.lit("c")))
    assert infer.fit_pending(more, ["basic"], path, chains=2, warmup=50, draws=20) == 2 and computed.value == 10
    assert sinks.published(spark, path, "draws").where("gene = 'c'").select("chain").distinct().count() == 2
