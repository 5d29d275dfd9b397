"""Variational fit of the basic model as one fold over steps, inside a row of each series.

The posterior of the logarithms of beta, delta and sigma is taken as normal and independent. A state of means, logarithms of deviations
and Adam's two moments goes through ``steps`` updates by the gradient of the evidence bound, which is written down in closed form; no Python runs.
The random part of a step is quasi-random, the same for every series and run. The result is the mean state over the last half of the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import PRIORS
from ..functions.normal import quantile, quantile_sql
from ..functions.safe import bind, missing
from .posterior import STEPS
from .vectors import vectors

NAMES = tuple(PRIORS["basic"])
ITERATIONS, RATE = 20_000, 1e-3


def _noise(i: Column) -> Column:
    share = lambda step: F.lit(0.5) + i * step - F.floor(F.lit(0.5) + i * step)
    return F.array(*(quantile(share(step)) for step, _ in zip(STEPS, NAMES)))


def _slopes(x: Column, series: Column) -> Column:
    """Derivatives of the log-likelihood by the logarithms of beta, delta and sigma at the point x."""
    p = F.struct(F.exp(x[0]).alias("beta"), F.exp(x[1]).alias("delta"), F.exp(-2.0 * x[2]).alias("weight"))

    def summed(p: Column) -> Column:
        def add(acc: Column, o: Column) -> Column:
            decay = F.exp(-p["delta"] * o["time"])
            made = p["beta"] / p["delta"] * (1.0 - decay)
            value = F.struct(decay.alias("decay"), made.alias("made"), (o["first"] * decay + made).alias("f"))

            def of(v: Column) -> Column:
                r = F.log1p(o["y"]) - F.log1p(v["f"])
                pull = r * p["weight"] / (1.0 + v["f"])
                by_delta = (p["beta"] - p["delta"] * o["first"]) * o["time"] * v["decay"] - v["made"]
                return F.array(acc[0] + pull * v["made"], acc[1] + pull * by_delta, acc[2] + r * r * p["weight"] - 1.0)

            return bind(value, of)

        return F.aggregate(series, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), add)

    return bind(p, summed)


def fit(observed: DataFrame, starts: DataFrame, steps: int = ITERATIONS, rate: float = RATE) -> DataFrame:
    """gene, and <name>_mean, <name>_sd of the logarithm of each parameter.

    ``observed``: (gene, time, y); ``starts``: (gene, first, beta0), as ``series.initial_values`` gives. Missing values are left out, a series
    without values or start has no row; values at or below -1 have no logarithm and end in nulls.
    """
    usable = observed.where(missing(F.col("y")).isNotNull()).join(starts.select("gene", "first", "beta0"), "gene").where("first IS NOT NULL AND beta0 > 0")
    rows = vectors(usable, ["gene", "beta0"], ["time", "y", "first"])
    medians = [F.log(F.col(p.median) if isinstance(p.median, str) else F.lit(p.median)) for p in PRIORS["basic"].values()]
    rows = rows.withColumn("_prior", F.array(*medians)).withColumn("_ok", F.forall("series", lambda o: o["y"] > -1))
    zeros = F.array(*[F.lit(0.0)] * 6)
    start = F.struct(F.concat("_prior", F.array(*[F.lit(-2.0)] * 3)).alias("at"), zeros.alias("one"), zeros.alias("two"), zeros.alias("mean"))
    spread = F.array(*(F.lit(p.sd) for p in PRIORS["basic"].values()))

    def step(acc: Column, i: Column) -> Column:
        at = acc["at"]

        def moved(e: Column) -> Column:
            reach = F.array(*(F.exp(at[3 + j]) * e[j] for j in range(3)))

            def at_point(d: Column) -> Column:
                x = F.array(*(at[j] + d[j] for j in range(3)))

                def climb(x: Column) -> Column:
                    prior = [(F.col("_prior")[j] - x[j]) / (spread[j] * spread[j]) for j in range(3)]
                    slope = bind(_slopes(x, F.col("series")), lambda g: F.array(*(g[j] + prior[j] for j in range(3))))
                    return bind(slope, lambda g: _update(acc, F.array(*(g[j] for j in range(3)), *(g[j] * d[j] + 1.0 for j in range(3))), i, steps, rate))

                return bind(x, climb)

            return bind(reach, at_point)

        return bind(_noise(i), moved)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    out = rows.select("gene", F.when(F.col("_ok"), folded["mean"]).alias("_mean"))
    columns = [c for j, name in enumerate(NAMES) for c in (F.col("_mean")[j].alias(f"{name}_mean"), F.exp(F.col("_mean")[3 + j]).alias(f"{name}_sd"))]
    return out.select("gene", *columns)


def _update(acc: Column, gradient: Column, i: Column, steps: int, rate: float) -> Column:
    """The state after a step of Adam."""

    def with_gradient(g: Column) -> Column:
        one = F.zip_with(acc["one"], g, lambda m, x: 0.9 * m + 0.1 * x)
        two = F.zip_with(acc["two"], g, lambda v, x: 0.999 * v + 0.001 * x * x)

        def with_moments(m: Column) -> Column:
            move = F.zip_with(m["one"], m["two"], lambda a, b: rate * (a / (1.0 - F.pow(F.lit(0.9), i))) / (F.sqrt(b / (1.0 - F.pow(F.lit(0.999), i))) + 1e-8))
            to = F.zip_with(acc["at"], move, lambda a, b: a + b)
            mean = lambda t: F.when(i > steps // 2, F.zip_with(acc["mean"], t, lambda a, b: a + b / float(steps - steps // 2))).otherwise(acc["mean"])
            return bind(to, lambda t: F.struct(t.alias("at"), m["one"].alias("one"), m["two"].alias("two"), mean(t).alias("mean")))

        return bind(F.struct(one.alias("one"), two.alias("two")), with_moments)

    return bind(gradient, with_gradient)


def fit_sql(observed: str, starts: str, steps: int, rate: float) -> str:
    """``fit`` as SQL: a table ``variational`` that is built up step by step, for small tables."""
    share = lambda step: f"((0.5::DOUBLE + i * {step!r}::DOUBLE) - floor(0.5::DOUBLE + i * {step!r}::DOUBLE))"
    noise = ", ".join(quantile_sql(share(step)) for step, _ in zip(STEPS, NAMES))
    medians = ", ".join(f"ln({p.median if isinstance(p.median, str) else f'{p.median}::DOUBLE'})" for p in PRIORS["basic"].values())
    sds = [p.sd for p in PRIORS["basic"].values()]
    total = lambda body: f"list_sum(list_transform(pts, lambda p: {body}))"
    decay, made = "exp(-delta * p.time)", "(beta / delta * (1 - exp(-delta * p.time)))"
    f = f"(first * {decay} + {made})"
    r = f"(ln(1 + p.y) - ln(1 + {f}))"
    slopes = (total(f"{r} * weight / (1 + {f}) * {made}"), total(f"{r} * weight / (1 + {f}) * ((beta - delta * first) * p.time * {decay} - {made})"), total(f"{r} * {r} * weight - 1"))
    g = ", ".join(f"{s} + (prior[{j}] - x[{j}]) / {sds[j - 1] ** 2}::DOUBLE" for j, s in enumerate(slopes, 1))
    each = lambda body: "[" + ", ".join(body(j) for j in range(1, 7)) + "]"
    return f"""variational AS (SELECT gene, 0 AS i, list_sort(list({{'time': time, 'y': y}})) AS pts, any_value(first) AS first, [{medians}] AS prior,
  [{medians}, -2.0::DOUBLE, -2.0::DOUBLE, -2.0::DOUBLE] AS at_, {each(lambda j: "0.0::DOUBLE")} AS one, {each(lambda j: "0.0::DOUBLE")} AS two, {each(lambda j: "0.0::DOUBLE")} AS mean_
  FROM {observed} JOIN {starts} USING (gene) GROUP BY gene, beta0
UNION ALL SELECT gene, i, pts, first, prior, to_, one, two, CASE WHEN i > {steps // 2} THEN {each(lambda j: f"mean_[{j}] + to_[{j}] / {steps - steps // 2}")} ELSE mean_ END FROM (
 SELECT *, {each(lambda j: f"at_[{j}] + {rate}::DOUBLE * (one[{j}] / (1 - pow(0.9::DOUBLE, i))) / (sqrt(two[{j}] / (1 - pow(0.999::DOUBLE, i))) + 1e-8::DOUBLE)")} AS to_ FROM (
  SELECT gene, i, pts, first, prior, at_, mean_, {each(lambda j: f"0.9::DOUBLE * one[{j}] + 0.1::DOUBLE * g[{j}]")} AS one, {each(lambda j: f"0.999::DOUBLE * two[{j}] + 0.001::DOUBLE * g[{j}] * g[{j}]")} AS two FROM (
   SELECT * REPLACE ([g[1], g[2], g[3], g[1] * d[1] + 1, g[2] * d[2] + 1, g[3] * d[3] + 1] AS g) FROM (
    SELECT *, [{g}] AS g FROM (
     SELECT *, exp(x[1]) AS beta, exp(x[2]) AS delta, exp(-2 * x[3]) AS weight FROM (
      SELECT *, [at_[1] + d[1], at_[2] + d[2], at_[3] + d[3]] AS x FROM (
       SELECT *, [exp(at_[4]) * e[1], exp(at_[5]) * e[2], exp(at_[6]) * e[3]] AS d FROM (
        SELECT *, [{noise}] AS e FROM (SELECT * REPLACE (i + 1 AS i) FROM variational WHERE i < {steps}))))))))))"""
