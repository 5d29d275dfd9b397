"""Distributions: histograms, cumulative distributions, kernel densities, box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import cdf
from ..functions.safe import divide, missing
from ..functions.stable import stable
from .ranks import counted, percentiles


def _edges(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """lo and hi of each group; without keys one row over all."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ends if keys else ends.withColumn("_one", F.lit(1))


def histogram(rows: DataFrame, key: str | list[str], value: str, bins: int = 50, edges: list[str] | None = None) -> DataFrame:
    """Counts in equal bins; the last bin includes the maximum.

    Bins lie between the extremes of each group of ``edges`` (by default of ``key``), so that groups that differ in other keys
    share them. Missing values are in no bin.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = keys if edges is None else edges
    rows = rows.withColumn(value, missing(F.col(value))).where(F.col(value).isNotNull())
    width = (F.col("hi") - F.col("lo")) / float(bins)
    bin_ = F.least(F.coalesce(F.floor(divide(F.col(value) - F.col("lo"), width)), F.lit(0)) + 1, F.lit(bins)).cast("long")
    rows = rows if by else rows.withColumn("_one", F.lit(1))
    return rows.join(_edges(rows, by, value), by or "_one").groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def cumulative(rows: DataFrame, keys: list[str], value: str, points: int = 50, common: list[str] | None = None) -> DataFrame:
    """(keys, i, x, cdf): the exact cumulative share of each group on a grid that all groups of ``common`` have in common.

    Values fall in the cells of the grid by partial aggregation; the sums over the few cells follow.
    """
    by = common or []
    rows = rows.withColumn(value, missing(F.col(value))).where(F.col(value).isNotNull()).withColumn("_one", F.lit(1))
    step = (F.col("hi") - F.col("lo")) / float(points - 1)
    placed = rows.join(_edges(rows, by, value), by or "_one").withColumn("i", F.coalesce(F.ceil(divide(F.col(value) - F.col("lo"), step)), F.lit(0)).cast("long"))
    # rounding may put a value one cell off its grid point; compare with the point itself
    at = lambda i: F.col("lo") + i * step
    cell = F.when(F.col(value) > at(F.col("i")), F.col("i") + 1).when((F.col("i") > 0) & (F.col(value) <= at(F.col("i") - 1)), F.col("i") - 1).otherwise(F.col("i"))
    counts = placed.withColumn("i", F.least(cell, F.lit(points - 1).cast("long"))).groupBy(*keys, "lo", "hi", "i").agg(F.count("*").alias("_n"))
    wide = counts.groupBy(*keys, "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("i", "_n"))).alias("_cells"), F.sum("_n").alias("_all"))
    up_to = lambda i: F.aggregate(F.sequence(F.lit(0).cast("long"), i), F.lit(0).cast("long"), lambda acc, j: acc + F.coalesce(F.try_element_at(F.col("_cells"), j), F.lit(0)))
    grid = wide.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("i"))
    return grid.select(*keys, "i", at(F.col("i")).alias("x"), (up_to(F.col("i")) / F.col("_all")).alias("cdf"))


def violin(rows: DataFrame, keys: list[str], value: str, points: int = 50) -> DataFrame:
    """(keys, i, x, density, q1, q2, q3): density of the values themselves with the quartiles of each group."""
    rows = stable(rows.select(*keys, value))  # they are read for the ranks, the extremes and the sums
    q = percentiles(rows, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return kde(rows, keys, value, points, log=False).join(q, keys)


def ecdf(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Share of a group's values at or below each of its distinct ones; missing values are none."""
    return counted(rows, [key], value).select(key, F.col("v").alias(value), ((F.col("before") + F.col("held")) / F.col("n")).alias("cdf"))


def kde(rows: DataFrame, key: str | list[str], value: str, points: int = 50, log: bool = True, cut: float = 0.0) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth, each group on its own.

    Of positive values the log10 is taken, or with ``log=False`` all values as they are; the grid reaches ``cut`` bandwidths beyond the
    extremes. Every row adds its kernel to a grid held as columns of sums, so grid and sample never multiply into rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    v = missing(F.col(value))
    x = rows.where(v > 0).select(*keys, F.log10(v).alias("x")) if log else rows.where(v.isNotNull()).select(*keys, v.alias("x"))
    ends = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.stddev_samp("x") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"), F.count("*").alias("n"))
    ends = ends.where("h > 0").withColumn("lo", F.col("lo") - cut * F.col("h")).withColumn("hi", F.col("hi") + cut * F.col("h"))
    kernel = lambda i: F.exp(-0.5 * F.pow((F.col("lo") + (F.col("hi") - F.col("lo")) * i / float(points - 1) - F.col("x")) / F.col("h"), F.lit(2.0)))
    sums = x.join(ends, keys).groupBy(*keys, "lo", "hi", "h", "n").agg(*(F.sum(kernel(i)).alias(f"k{i}") for i in range(points)))
    each = F.posexplode(F.array(*(F.col(f"k{i}") for i in range(points)))).alias("i", "k")
    out = sums.select(*keys, "lo", "hi", "h", "n", each)
    return out.select(*keys, F.col("i").cast("long").alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / float(points - 1)).alias("x"), (F.col("k") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


def smooth_cumulative(rows: DataFrame, keys: list[str], value: str, points: int = 50, cells: int = 65_536) -> DataFrame:
    """(keys, i, x, cdf): the integral of the Gaussian kernel density of each group on an even grid between its extremes.

    Values are first spread over the two nearest of ``cells`` even places, by partial aggregation, so the distribution function is evaluated
    for points times cells at most and not for every row. That changes the curve by about (span / cells / bandwidth)^2 / 8, below 1e-6 here.
    Groups with one distinct value have no bandwidth and no curve.
    """
    x = rows.select(*keys, missing(F.col(value)).alias("x")).where("x IS NOT NULL")
    ends = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.stddev_samp("x") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"), F.count("*").alias("n"))
    ends = ends.where("h > 0")
    at = F.col("at") - F.floor("at")
    both = F.array(F.struct(F.floor("at").alias("cell"), (1.0 - at).alias("w")), F.struct((F.floor("at") + 1).alias("cell"), at.alias("w")))
    placed = x.join(ends, keys).withColumn("at", (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * float(cells - 1))
    binned = placed.select(*keys, "lo", "hi", "h", "n", F.inline(both)).groupBy(*keys, "lo", "hi", "h", "n", "cell").agg(F.sum("w").alias("w"))
    span = F.col("hi") - F.col("lo")
    grid = lambda i: F.col("lo") + span * i / float(points - 1)
    centre = F.col("lo") + span * F.col("cell") / float(cells - 1)
    each = binned.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    each = each.select(*keys, "n", F.col("i").cast("long").alias("i"), grid(F.col("i")).alias("x"), (F.col("w") * cdf((grid(F.col("i")) - centre) / F.col("h"))).alias("part"))
    return each.groupBy(*keys, "n", "i", "x").agg(F.sum("part").alias("part")).select(*keys, "i", "x", (F.col("part") / F.col("n")).alias("cdf"))


def box(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of fliers; missing values are none of them."""
    rows = rows.withColumn(value, missing(F.col(value)))
    q = percentiles(rows, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    v = F.when(inside, F.col(value))
    return rows.join(q, keys).groupBy(*keys, "q1", "q2", "q3").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(~inside).alias("fliers"))


def extremes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, min, max) of each column, as a settings file has them."""
    each = F.array(*(F.struct(F.lit(c).alias("variable"), F.min(missing(F.col(c))).alias("min"), F.max(missing(F.col(c))).alias("max")) for c in columns))
    return rows.agg(each.alias("_each")).select(F.inline("_each"))
