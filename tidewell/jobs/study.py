"""A whole study: fit what is pending, score it, write reports, collect them, merge the models.

Every step reads what the one before has stored, so a study that broke off goes on where it was; a second run of a complete one fits
nothing and leaves the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions.stable import stable
from ..operators import collect, compare, posterior, series, vectors
from ..sources import reports, sinks
from . import infer


QUADRATURE = models.N


@dataclass(frozen=True)
class Study:
    """``path``: a folder that all executors share. ``predictions``: draws, evenly spaced over the chains, that curves are computed for."""

    path: str
    models: tuple[str, ...] = tuple(models.PRIORS)
    chains: int = 4
    warmup: int = 1000
    draws: int = 2000
    predictions: int = 100
    quadrature: int = QUADRATURE

    def at(self, part: str, model: str | None = None) -> str:
        return f"{self.path}/{part}" + (f"/model={model}" if model else "")


def observed(rows: DataFrame) -> DataFrame:
    """(gene, time, obs, first, exposure): each series with its start and the integral of the ramp up to each time."""
    known = series.exposure(rows.where("y IS NOT NULL AND gene IS NOT NULL").withColumn("f", models.ramp(F.col("time"))), "f")
    start = series.initial_values(known.select("gene", "time", "y")).select("gene", "first")
    return known.join(start, "gene").select("gene", "time", F.col("y").alias("obs"), "first", "exposure")


def predictions(study: Study, draws: DataFrame, times: DataFrame, model: str) -> DataFrame:
    """(gene, draw, time, obs, pred, sigma): the curves of the kept draws at the observed times."""
    wide = posterior.thinned(infer.wide_draws(draws.withColumn("error", F.lit(None).cast("string")), model), ["gene"], study.predictions)
    rows = posterior.predictive(wide, times, ["gene"], models.curve(model, study.quadrature))
    return rows.select("gene", "draw", "time", "obs", "pred", "sigma")


def report_rows(scores: DataFrame, free: int) -> DataFrame:
    """(gene, line, metric, y, model) of a report: metrics over the draws with their intervals, number of data and parameters."""
    found = posterior.goodness_of_draws(scores, ["gene"]).join(scores.groupBy("gene").agg(F.max("n").alias("n")), "gene")
    none, line = F.lit(None).cast("double"), 1
    each = []
    for metric, name, side in (("nrmse", "NRMSE", "y"), ("log_likelihood", "Log-Likelihood", "y"), ("n", "n (data)", "y"), ("k", "k (parameters)", "model"), ("bic", "BIC", "model")):
        for column, end in (("mean", ""), ("lower", " (95%-hdi[lower])"), ("upper", " (95%-hdi[upper])")) if metric not in ("n", "k") else ((metric, ""),):
            line += 1
            value = F.lit(float(free)) if metric == "k" else F.col(column).cast("double")
            row = F.struct(F.lit(line).cast("long").alias("line"), F.lit(f"{name}{end}").alias("metric"), (value if side == "y" else none).alias("y"), (value if side == "model" else none).alias("model"))
            each.append(F.when(F.col("metric") == ("bic" if metric in ("n", "k") else metric), row))
    return found.select("gene", F.explode(F.array_compact(F.array(*each))).alias("r")).select("gene", "r.*")


def score(study: Study, rows: DataFrame) -> None:
    """Reports and metrics of all models from the stored draws."""
    spark = rows.sparkSession
    draws = sinks.published(spark, study.path + "/fits", "draws")
    if draws is None:
        return
    times = stable(observed(rows))
    for model in study.models:
        own = draws.where(F.col("model") == model)
        curves = stable(predictions(study, own, times, model))
        goodness = stable(report_rows(posterior.fit_of_draws(curves, ["gene"], free=len(models.PRIORS[model])), len(models.PRIORS[model])))
        estimated = posterior.estimates(own, ["gene", "param"]).select("gene", "param", "packed")
        sinks.write_reports(goodness, estimated, study.at("reports", model), "gene")
        mean = curves.groupBy("gene", "time").agg(F.first("obs").alias("obs"), F.avg("pred").alias("pred"))
        found = vectors.fold_metrics(vectors.vectors(mean, ["gene"], ["time", "obs", "pred"]))
        sinks.write_metrics(found.select("gene", "n", "spearman", "nrmse_range", "mase").withColumn("model", F.lit(model)), study.at("metrics"))


def collected(study: Study, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The reports of all models read back: goodness of fit in one row a model and series, and its parameters."""
    gene, model = F.regexp_extract("path", r"/gene=([^/]+)/", 1), F.regexp_extract("path", r"/model=([^/]+)/", 1)
    named = lambda df: df.withColumn("gene", gene).withColumn("of", model)
    fits = [named(reports.goodness_of_fit(spark, f"{study.at('reports', m)}/goodness_of_fit", "*.txt")) for m in study.models]
    params = [named(reports.parameter_estimates(spark, f"{study.at('reports', m)}/parameter_estimates", "*.txt")) for m in study.models]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    wide = collect.goodness_wide(union(fits), ["of", "gene"], "line").withColumnRenamed("of", "model")
    names = sorted({p for m in study.models for p in models.PRIORS[m]})
    return wide, collect.parameters_wide(union(params), ["of", "gene"], "line", names).withColumnRenamed("of", "model")


def merge(study: Study, annotation: DataFrame) -> DataFrame:
    """All models' metrics, goodness of fit and annotation, with the acceptance of each fit; also written, by model."""
    spark = annotation.sparkSession
    metrics = spark.read.parquet(study.at("metrics"))
    out = compare.merge_models(metrics, collected(study, spark)[0], annotation, key="gene")
    out = out.withColumn("accepted", compare.accepted())
    sinks.write_merged(out, study.at("merged"))
    return spark.read.parquet(study.at("merged"))


def run(study: Study, rows: DataFrame, annotation: DataFrame) -> DataFrame:
    """Fit, score, report, collect and merge the series ``rows`` (gene, time, y); the merged table."""
    infer.fit_pending(rows, list(study.models), study.path + "/fits", study.chains, study.warmup, study.draws)
    score(study, rows)
    return merge(study, annotation)
