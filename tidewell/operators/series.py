"""Per-series operators: slices, initial values, re-gridding by linear interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import missing
from . import checks
from .scans import RANGE_ROWS, Scan, counted_ranges


def time_slice(rows: DataFrame, low: float, high: float, time: str = "time") -> DataFrame:
    """Rows with low <= time <= high, both ends included."""
    return rows.where(F.col(time).between(low, high))


def points(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed ids, and the ids without any row."""
    return rows.join(ids, key, "left_semi"), ids.join(rows, key, "left_anti")


def initial_values(rows: DataFrame, high: float | None = None, strict: bool = False) -> DataFrame:
    """gene, n, m0, first, z_ss0, z_max0, beta0, alpha0, t_min, t_max of each series, after slicing to ``high``.

    m0 is the value at time 0 (null if there is none; with ``strict`` that is an error which names the series), z_ss0 the mean of the last three, z_max0 the
    maximum without the first and last two (null for up to four observations).
    """
    rows = (rows if high is None else time_slice(rows, 0.0, high)).withColumn("y", missing(F.col("y")))
    up = Window.partitionBy("gene").orderBy("time")
    placed = rows.withColumn("up", F.row_number().over(up)).withColumn("n", F.count("*").over(Window.partitionBy("gene")))
    down = F.col("n") - F.col("up") + 1
    out = placed.groupBy("gene").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("time") == 0, F.col("y"))).alias("m0"),
        F.min_by("y", "time").alias("first"),
        F.avg(F.when(down <= 3, F.col("y"))).alias("z_ss0"),
        F.max(F.when((F.col("up") > 2) & (down > 2), F.col("y"))).alias("z_max0"),
        F.min("time").alias("t_min"),
        F.max("time").alias("t_max"),
    )
    out = checks.required(out, "m0", ["gene"], "no value at time 0") if strict else out
    return out.withColumn("beta0", F.col("z_ss0") * 0.1 + 1e-8).withColumn("alpha0", F.col("z_max0") * 0.1 + 1e-8)


def regrid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """y of each series at the (gene, time) rows of ``grid``, linearly between its neighbours, null outside.

    Knots and asked times meet in one ordered scan by ranges of time, so no task holds a series.
    """
    known = rows.where(missing(F.col("y")).isNotNull()).select("gene", "time", "y", F.col("time").alias("knot"), F.lit(False).alias("asked"))
    asked = grid.select("gene", "time", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("knot"), F.lit(True).alias("asked"))
    point = F.when(F.col("knot").isNotNull(), F.struct("knot", "y"))
    # the knot after a time is the last one before it from the other end
    both = Scan(known.union(asked), ["gene"], ["time"]).carry(point, "_k0").carry(point, "_k1", down=True).result()
    both = both.select("gene", "time", "asked", *(F.col(f"_k{i}.{c}").alias(f"{name}{i}") for i in (0, 1) for c, name in (("knot", "t"), ("y", "y"))))
    lerp = F.when(F.col("t0") == F.col("t1"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("time") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0)))
    return both.where("asked").select("gene", "time", lerp.alias("y"))


def exposure(rows: DataFrame, value: str, out: str = "exposure") -> DataFrame:
    """Cumulative trapezoid of a column over time in each series, by ranges of time."""
    return Scan(rows, ["gene"], ["time"]).trapezoid("time", value, out).result()


def chunks(rows: DataFrame, key: str, size: int = 500, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number of each row in key order, from 1, and its chunk of ``size`` rows.

    Rows are numbered inside key ranges, as many as the counted rows need, and shifted by the sizes of the ranges before.
    """
    out = Scan(rows, [], [key], counted_ranges(rows, range_rows)).number("rn").result()
    return out.withColumn("chunk", F.floor((F.col("rn") - 1) / size) + 1)
