"""Convergence of chains: rank-normalised split R-hat and effective sample size.

Ranks are taken over all draws of a key by ``ranks.counted``; the rest is folds over one array a chain, so a chain (some thousand
draws) and a key's chains lie in a row. Chains are cut into halves of the same length, a middle draw falls out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import quantile
from ..functions.safe import bind, divide, missing
from ..functions.stable import stable
from .ranks import average_rank, counted, percentile_of, same_keys


def _mean(x: Column) -> Column:
    return divide(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), F.size(x))


def _variance(x: Column) -> Column:
    """Sample variance of an array."""
    return bind(_mean(x), lambda m: divide(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)), F.size(x) - 1))


def _normal_scores(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the normal score of each value's average rank in its key."""
    score = quantile((average_rank() - 0.375) / (F.col("n") + 0.25))
    ranked = counted(rows, keys, value).select(*keys, F.col("v").alias("_v"), score.alias(out)).alias("ranked")
    same = [*same_keys("rows", "ranked", keys), F.col(f"rows.{value}") + 0.0 == F.col("ranked._v")]
    return rows.alias("rows").join(ranked, same).select("rows.*", out)


def _halves(column: str) -> Column:
    """The first and last halves of every chain of ``_chains``, each as long as half of the shortest chain."""
    chains = F.transform("_chains", lambda c: F.transform(c["points"], lambda p: p[column]))
    return F.flatten(F.transform(chains, lambda c: F.array(F.slice(c, F.lit(1), F.col("_half")), F.slice(c, F.size(c) - F.col("_half") + 1, F.col("_half")))))


def _reduction(halves: Column, n: Column) -> Column:
    """The square root of the variance over all halves by that within them."""
    within = _mean(F.transform(halves, _variance))
    between = _variance(F.transform(halves, _mean))
    return F.sqrt(divide((n - 1.0) / n * within + between, within))


def _effective(halves: Column, n: Column) -> Column:
    """Draws of the same worth without correlation: autocorrelations are summed in pairs of lags up to the first negative pair, none above the pair before."""
    deviations = F.transform(halves, lambda h: bind(_mean(h), lambda m: F.transform(h, lambda v: v - m)))
    lagged = lambda h, t: F.aggregate(F.zip_with(F.slice(h, F.lit(1), n - t), F.slice(h, t + 1, n - t), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) / n

    def total(d: Column) -> Column:
        covariance = lambda t: _mean(F.transform(d, lambda h: lagged(h, t)))
        within = covariance(F.lit(0)) * n / (n - 1.0)
        over_all = within * (n - 1.0) / n + _variance(F.transform(halves, _mean))

        def summed(scale: Column) -> Column:
            rho = lambda t: 1.0 - divide(scale["within"] - covariance(t), scale["over_all"])
            pair = lambda j: F.when(j == 0, 1.0 + rho(F.lit(1))).otherwise(rho(2 * j) + rho(2 * j + 1))
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("last"), F.lit(True).alias("open"))

            def step(acc: Column, j: Column) -> Column:
                def take(p: Column) -> Column:
                    kept = F.least(p, acc["last"])
                    good = F.coalesce(p >= 0, F.lit(False))
                    return F.struct(F.when(good, acc["sum"] + kept).otherwise(acc["sum"]).alias("sum"), F.when(good, kept).otherwise(acc["last"]).alias("last"), good.alias("open"))

                return F.when(acc["open"], bind(pair(j), take)).otherwise(acc)

            return F.aggregate(F.sequence(F.lit(0), (n / 2).cast("int") - 1), start, step)["sum"]

        return bind(F.struct(within.alias("within"), over_all.alias("over_all")), summed)

    size = F.size(halves) * n
    tau = F.greatest(bind(deviations, total) * 2.0 - 1.0, 1.0 / F.log10(size.cast("double")))
    return divide(size.cast("double"), tau)


def convergence(draws: DataFrame, keys: list[str], value: str = "value", chain: str = "chain", draw: str = "draw") -> DataFrame:
    """keys, chains, n_draws (of the shortest chain), rhat, ess of every key.

    ``rhat`` is the greater of the values of the draws and of their distances from the median, both rank-normalised. Missing draws are
    left out; keys whose shortest chain has fewer than eight draws, or whose draws are all equal, have nulls.
    """
    rows = draws.select(*keys, F.col(chain).alias("_chain"), F.col(draw).alias("_draw"), missing(F.col(value)).alias("_x")).where("_x IS NOT NULL")
    rows = stable(rows)
    middle = counted(rows, keys, "_x").groupBy(*keys).agg(percentile_of(0.5).alias("_middle"))
    folded = rows.alias("rows").join(middle.alias("middle"), same_keys("rows", "middle", keys)).select("rows.*", F.abs(F.col("_x") - F.col("_middle")).alias("_far"))
    scored = _normal_scores(_normal_scores(folded, keys, "_x", "z"), keys, "_far", "far")
    by_chain = scored.groupBy(*keys, "_chain").agg(F.sort_array(F.collect_list(F.struct("_draw", "z", "far"))).alias("points"))
    by_key = by_chain.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chain", "points"))).alias("_chains"), F.min(F.size("points")).alias("n_draws"), F.count("*").alias("chains"))
    by_key = by_key.withColumn("_half", (F.col("n_draws") / 2).cast("int"))
    cut = by_key.select(*keys, "chains", F.col("n_draws").cast("long").alias("n_draws"), "_half", _halves("z").alias("_z"), _halves("far").alias("_f"))
    n, enough = F.col("_half"), F.col("_half") >= 4
    rhat = F.greatest(_reduction(F.col("_z"), n), _reduction(F.col("_f"), n))
    return cut.select(*keys, "chains", "n_draws", F.when(enough, rhat).alias("rhat"), F.when(enough, _effective(F.col("_z"), n)).alias("ess"))
