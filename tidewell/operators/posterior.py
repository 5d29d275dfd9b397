"""Summaries of draws: mean, median, shortest intervals, percentile intervals, estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Prior, observe, residual
from ..functions.normal import quantile
from ..functions.safe import divide, missing, significant
from ..functions.stable import stable
from .ranks import counted, percentile_of, percentiles, shortest_interval
from .scans import Scan


def mean_median(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and exact median of each group; groups without values are not there."""
    mean = F.sum(F.col("v") * F.col("held")) / F.sum("held")
    return counted(draws, keys, value).groupBy(*keys).agg(mean.alias("mean"), percentile_of(0.5).alias("median"))


def hdi_by(draws: DataFrame, keys: list[str], value: str, mass: float = 0.95) -> DataFrame:
    """hdi_lo and hdi_hi of each group. Widths are compared at nine digits, so that equal widths tie on every engine."""
    return shortest_interval(draws, keys, value, mass)


def point_interval(rows: DataFrame, keys: list[str], value: str, mass: float = 0.9) -> DataFrame:
    """Median and the central percentile interval."""
    tail = (1 - mass) / 2
    return percentiles(rows, keys, value, {"median": 0.5, "lo": tail, "hi": 1 - tail})


def predictive(draws: DataFrame, times: DataFrame, keys: list[str], curve: Column, sigma: Column | None = None, seed: int = 10) -> DataFrame:
    """Predictions ``pred`` of every draw at every time of its series, an equi-join of draws and times on ``keys``.

    ``curve`` is a model's expression over the columns of both. With ``sigma``, normal noise is added on the log1p scale:
    these are new observations, otherwise the model's own curve. Noise hangs on the draw and the time alone, so a retried task repeats it.
    """
    both = draws.join(times, keys).withColumn("pred", curve)
    if sigma is None:
        return both
    u = lambda n: (F.pmod(F.xxhash64(*keys, "draw", "time", F.lit(seed + n)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    noise = F.sqrt(-2.0 * F.log(u(0))) * F.cos(6.283185307179586 * u(1))
    return both.withColumn("pred", observe(sigma * noise, F.col("pred")))


def thinned(draws: DataFrame, keys: list[str], count: int, draw: str = "draw") -> DataFrame:
    """``count`` evenly spaced draws of each key, in the order of ``draw``; all of them where there are no more."""
    numbered = Scan(draws.select(*keys, draw).distinct(), keys, [draw]).number("_i").whole(F.lit(1), "_n").result()
    step = lambda i: F.floor(i * count / F.col("_n"))
    kept = numbered.where((F.col("_n") <= count) | (step(F.col("_i")) > step(F.col("_i") - 1))).select(*keys, draw)
    return draws.join(kept, [*keys, draw], "left_semi")


def predictive_band(predicted: DataFrame, keys: list[str], mass: float = 0.95) -> DataFrame:
    """keys, mean, median, hdi_lo, hdi_hi, n of ``pred``: what a predictive check shows at each time."""
    middle = predicted.where(missing(F.col("pred")).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return mean_median(predicted, keys, "pred").join(shortest_interval(predicted, keys, "pred", mass), keys).join(middle, keys)


#: Steps of the quasi-random draws of each parameter: fractional parts of square roots of primes.
STEPS = tuple(math.sqrt(p) % 1 for p in (2, 3, 5, 7, 11, 13, 17))


def prior_draws(starts: DataFrame, priors: dict[str, Prior], count: int) -> DataFrame:
    """``starts`` with ``count`` draws of each parameter from its log-normal prior; medians given by name are columns of ``starts``.

    Draws are quasi-random, so they are the same for every series and in every run, and spread evenly.
    """
    rows = starts.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    share = lambda step: F.lit(0.5) + F.col("draw") * step - F.floor(F.lit(0.5) + F.col("draw") * step)
    median = lambda p: F.col(p.median) if isinstance(p.median, str) else F.lit(p.median)
    return rows.select("*", *((median(p) * F.exp(p.sd * quantile(share(step)))).alias(name) for (name, p), step in zip(priors.items(), STEPS)))


def fit_of_draws(predicted: DataFrame, keys: list[str], sigma: str = "sigma", free: int | Column = 3) -> DataFrame:
    """n, nrmse (by the observed range), log_likelihood and bic of every draw, of predictions beside ``obs``."""
    rows = predicted.where(missing(F.col("obs")).isNotNull() & missing(F.col("pred")).isNotNull())
    r, s = residual(F.col("obs"), F.col("pred")), F.col(sigma)
    each = -0.5 * F.log(6.283185307179586 * s * s) - r * r / (2.0 * s * s)
    out = rows.groupBy(*keys, "draw").agg(
        F.count("*").alias("n"),
        divide(F.sqrt(F.avg(F.pow(F.col("obs") - F.col("pred"), F.lit(2.0)))), F.max("obs") - F.min("obs")).alias("nrmse"),
        F.sum(each).alias("log_likelihood"),
    )
    k = F.lit(float(free)) if isinstance(free, int) else free
    return out.withColumn("bic", k * F.log(F.col("n").cast("double")) - 2.0 * F.col("log_likelihood"))


def goodness_of_draws(scores: DataFrame, keys: list[str], mass: float = 0.95) -> DataFrame:
    """(keys, metric, mean, lower, upper): mean and shortest interval over the draws of each metric of ``fit_of_draws``."""
    long = stable(scores).unpivot([*keys, "draw"], ["nrmse", "log_likelihood", "bic"], "metric", "value")
    by = [*keys, "metric"]
    means = long.groupBy(*by).agg(F.avg(missing(F.col("value"))).alias("mean"))
    spans = shortest_interval(long, by, "value", mass)
    return means.join(spans, by).select(*by, "mean", F.col("hdi_lo").alias("lower"), F.col("hdi_hi").alias("upper"))


def estimates(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation, and both packed as text with three significant figures."""
    out = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("packed", F.concat(significant(F.col("mean")).cast("string"), F.lit(" ± "), significant(F.col("sd")).cast("string")))
