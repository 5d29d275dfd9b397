"""Kinetic models as column expressions; a query evaluates them without any solver.

All systems are linear in their states, so M is a closed form and Z an integral of a known
forcing against an exponential kernel, taken by Simpson's rule over ``N`` intervals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N, STEEPNESS = 1000, 5.0


@dataclass(frozen=True)
class Prior:
    """Log-normal prior: median and standard deviation of the logarithm."""

    median: float | str
    sd: float


#: Free parameters by model; a median given by name is derived from the series.
PRIORS = {
    "basic": {"beta": Prior("beta0", 1.0), "delta": Prior(0.1, 1.0), "sigma": Prior(0.5, 0.5)},
    "zga_m": {"beta": Prior("beta0", 0.5), "delta_z": Prior(0.1, 1.0), "delta_m": Prior(0.35, 1.0), "t_zga": Prior(3.0, 1.0), "sigma": Prior(0.5, 0.5)},
    "zga_z": {"beta": Prior("beta0", 0.5), "delta_z": Prior(0.1, 1.0), "delta_m": Prior(1.4, 0.5), "t_zga": Prior(3.0, 1.0), "sigma": Prior(0.5, 0.5)},
    "rep_m": {"alpha": Prior("alpha0", 0.5), "beta": Prior("beta0", 0.5), "delta_z": Prior(0.1, 1.0), "delta_m": Prior(0.35, 1.0), "t_zga": Prior(3.0, 1.0), "dt_rep": Prior(6.0, 1.0), "sigma": Prior(0.5, 0.5)},
    "rep_z": {"alpha": Prior("alpha0", 0.5), "beta": Prior("beta0", 0.5), "delta_z": Prior(0.1, 1.0), "delta_m": Prior(1.4, 0.5), "t_zga": Prior(3.0, 1.0), "dt_rep": Prior(6.0, 1.0), "sigma": Prior(0.5, 0.5)},
}


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))


def ramp(t: Column, on: float = 3.0, off: float = 4.0) -> Column:
    """0 up to ``on``, linear to 1 at ``off``, then 1."""
    return F.least(F.greatest((t - on) / (off - on), F.lit(0.0)), F.lit(1.0))


def basic(m0: Column, beta: Column, delta: Column, t: Column) -> Column:
    return m0 * F.exp(-delta * t) + beta / delta * (1.0 - F.exp(-delta * t))


def maternal(m0: Column, delta_m: Column, exposure: Column) -> Column:
    """Decay over an exposure: the time itself, or the integral of a forcing up to it."""
    return m0 * F.exp(-delta_m * exposure)


def simpson(f: Callable[[Column], Column], t: Column, n: int = N) -> Column:
    """Integral of f over [0, t]."""
    step = t / float(n)
    weight = lambda i: F.when((i == 0) | (i == n), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda acc, i: acc + weight(i) * f(i.cast("double") * step))
    return total * step / 3.0


def activation(t: Column, t_zga: Column, s: float = STEEPNESS) -> Column:
    return sigmoid(F.lit(s) * (t - t_zga))


def production(t: Column, beta: Column, t_zga: Column, alpha: Column | None = None, dt_rep: Column | None = None) -> Column:
    """Zygotic production: beta once switched on; with repression alpha before and beta after it."""
    on = activation(t, t_zga)
    if alpha is None:
        return beta * on
    off = activation(t, t_zga + dt_rep)
    return alpha * on * (1.0 - off) + beta * off


def zygotic(t: Column, delta_z: Column, g: Callable[[Column], Column], n: int = N) -> Column:
    return simpson(lambda u: F.exp(-delta_z * (t - u)) * g(u), t, n)


def curve(name: str, n: int = N) -> Column:
    """The curve of a model over the columns of its parameters, ``first`` (the value at the start), ``time`` and, for Z-decay models, ``exposure``."""
    p, t = {k: F.col(k) for k in PRIORS[name]}, F.col("time")
    if name == "basic":
        return basic(F.col("first"), p["beta"], p["delta"], t)
    extra = (p["alpha"], p["dt_rep"]) if "alpha" in p else ()
    z = zygotic(t, p["delta_z"], lambda u: production(u, p["beta"], p["t_zga"], *extra), n)
    return maternal(F.col("first"), p["delta_m"], F.col("exposure") if name.endswith("_z") else t) + z


def time_grid(ends: DataFrame, end: str, points: int = 1001, number: str = "i") -> DataFrame:
    """``ends`` with a row for each of ``points`` even times from 0 to the column ``end``, and its number."""
    rows = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias(number))
    return rows.withColumn("time", F.col(number) * F.col(end) / float(points - 1))


def log_prior(x: Column, median: Column, sd: float) -> Column:
    """Log density of a log-normal with this median."""
    return -F.log(x * sd * 2.5066282746310002) - F.pow(F.log(x / median), F.lit(2.0)) / (2.0 * sd * sd)


def residual(observed: Column, predicted: Column) -> Column:
    return F.log1p(observed) - F.log1p(predicted)


def observe(residual_: Column, predicted: Column) -> Column:
    """Inverse of ``residual``."""
    return F.expm1(residual_ + F.log1p(predicted))
