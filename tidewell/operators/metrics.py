"""Fit metrics of observed against predicted series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import residual
from ..functions.safe import correlation, divide, missing
from ..functions.stable import stable
from .ranks import average_rank, counted, same_keys


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, out: str = "spearman") -> DataFrame:
    """Rank correlation by group, null where a side is constant.

    Equal pairs are counted first and each side's distinct values ranked over ranges (``ranks.counted``), then joined back by key and
    value. The mean of average ranks is (n + 1) / 2 on both sides, so deviations are exact and their products are summed by key.
    """
    pairs = _complete(rows, a, b).select(*keys, (F.col(a) + 0.0).alias("_a"), (F.col(b) + 0.0).alias("_b")).groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_c"))
    pairs = stable(pairs)

    def deviations(side: str, name: str) -> DataFrame:
        ranked = counted(pairs, keys, side, F.col("_c"))
        return ranked.select(*keys, F.col("v").alias(side), (average_rank() - (F.col("n") + 1) / 2.0).alias(name))

    joined = pairs.alias("pairs")
    for side, name in (("_a", "_da"), ("_b", "_db")):
        joined = joined.join(deviations(side, name).alias("ranked"), same_keys("pairs", "ranked", [*keys, side])).select("pairs.*", *(["_da"] if name == "_db" else []), name).alias("pairs")
    times = lambda x, y: F.sum(F.col("_c") * F.col(x) * F.col(y))
    return joined.groupBy(*keys).agg(divide(times("_da", "_db"), F.sqrt(times("_da", "_da") * times("_db", "_db"))).alias(out))


def paired(observed: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Observations and predictions that meet by key, never by position; keys of one side only have no row."""
    return observed.join(predicted, keys)


def _complete(rows: DataFrame, obs: str, pred: str) -> DataFrame:
    """Rows whose sides are both there."""
    return rows.where(missing(F.col(obs)).isNotNull() & missing(F.col(pred)).isNotNull())


def _error_columns(obs: str, pred: str, mean: str) -> list[Column]:
    rmse = F.sqrt(F.avg(F.pow(F.col(obs) - F.col(pred), F.lit(2.0))))
    return [
        F.count("*").alias("n"),
        rmse.alias("rmse"),
        divide(rmse, F.max(obs) - F.min(obs)).alias("nrmse_range"),
        divide(rmse, F.avg(obs)).alias("nrmse_mean"),
        divide(rmse, F.stddev_pop(obs)).alias("nrmse_std"),
        divide(F.sum(F.abs(F.col(obs) - F.col(pred))), F.sum(F.abs(F.col(obs) - F.col(mean)))).alias("mase"),
    ]


def _deviating(rows: DataFrame, keys: list[str], obs: str) -> DataFrame:
    """``rows`` with the mean of their group, which comes back by an equi-join that a large group can be split for."""
    means = rows.groupBy(*keys).agg(F.avg(obs).alias("_mean"))
    return rows.alias("rows").join(means.alias("means"), same_keys("rows", "means", keys)).select("rows.*", "_mean")


def errors(rows: DataFrame, keys: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """n, rmse, nrmse_range, nrmse_mean, nrmse_std (population), mase by group, over rows with both sides.

    mase divides the absolute error by the absolute deviation from the group's own mean.
    """
    return _deviating(_complete(rows, obs, pred), keys, obs).groupBy(*keys).agg(*_error_columns(obs, pred, "_mean"))


def fit_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The errors and the rank correlation of each group, of any size; ``vectors.fold_metrics`` is for many short series.

    A group without any complete row is there with n = 0 and nulls.
    """
    rows = rows.withColumn("_ok", missing(F.col("obs")).isNotNull() & missing(F.col("pred")).isNotNull())
    for c in ("obs", "pred"):
        rows = rows.withColumn(c, F.when(F.col("_ok"), F.col(c)))
    found = _deviating(rows, keys, "obs").groupBy(*keys).agg(F.count("obs").alias("n"), *_error_columns("obs", "pred", "_mean")[1:])
    both = found.alias("found").join(spearman(rows, keys, "obs", "pred").alias("rho"), same_keys("found", "rho", keys), "left")
    return both.select("found.*", "spearman")


def residual_diagnostics(rows: DataFrame, keys: list[str], time: str = "time", lag: int = 1) -> DataFrame:
    """Local over global variance of residuals (three-point windows), and their autocorrelation at a lag."""
    w = Window.partitionBy(*keys).orderBy(time)
    near = w.rowsBetween(-1, 1)
    r = rows.withColumn("r", F.col("obs") - F.col("pred"))
    r = r.withColumn("_local", F.when(F.count("r").over(near) == 3, F.var_pop("r").over(near))).withColumn("_lag", F.lag("r", lag).over(w))
    full = r.groupBy(*keys).agg(divide(F.avg("_local"), F.var_pop("r")).alias("variance_ratio"))
    return full.join(r.where("_lag IS NOT NULL").groupBy(*keys).agg(correlation(F.col("r"), F.col("_lag")).alias("autocorrelation")), keys, "left")


def likelihood(rows: DataFrame, keys: list[str], sigma: float, free: int) -> DataFrame:
    """Log-likelihood of log1p residuals under a normal error, and the BIC for ``free`` parameters, over rows with both sides."""
    rows = _complete(rows, "obs", "pred")
    r = residual(F.col("obs"), F.col("pred"))
    each = -0.5 * F.log(F.lit(2.0 * 3.141592653589793 * sigma * sigma)) - r * r / (2.0 * sigma * sigma)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(each).alias("log_likelihood"))
    return out.withColumn("bic", F.lit(float(free)) * F.log(F.col("n").cast("double")) - 2.0 * F.col("log_likelihood"))
