"""Report rows to wide tables: metrics by name, packed parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import unpack_deviation, unpack_mean

#: Metric name in a report, column of the value, name in the wide table; each metric with the ends of its interval.
GOODNESS = tuple(
    (f"{metric}{end}", value, f"{name}{suffix}")
    for metric, value, name in (("NRMSE", "y", "nrmse"), ("Log-Likelihood", "y", "loglik"), ("BIC", "model", "bic"))
    for end, suffix in (("", ""), (" (95%-hdi[lower])", "_lower"), (" (95%-hdi[upper])", "_upper"))
)


def first_by(name: str, metric: str, value: str, order: str) -> Column:
    """The first value under a metric name."""
    return F.min_by(F.when(F.col(metric) == name, F.col(value)), F.when(F.col(metric) == name, F.col(order)))


def goodness_wide(rows: DataFrame, keys: list[str], order: str, metrics: tuple = GOODNESS) -> DataFrame:
    """One row a series, in the order of the keys; the first of repeated metrics counts, absent ones are null."""
    return rows.groupBy(*keys).agg(*(first_by(name, "metric", value, order).alias(out) for name, value, out in metrics)).orderBy(*keys)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no result yet."""
    return todo.join(done, keys, "left_anti")


def parameters_wide(rows: DataFrame, keys: list[str], order: str, params: list[str] | None = None) -> DataFrame:
    """<param>_mean columns and then <param>_std columns, sorted; the last of repeated parameters counts.

    White space inside a name is dropped; rows are in the order of the keys.

    Values that don't read as "mean ± deviation" are left out. The parameters' names become columns, so they are few.
    """
    rows = rows.withColumn("param", F.regexp_replace("param", r"\s", "")).where(F.col("param") != "").withColumns({"mean": unpack_mean(F.col("value")), "std": unpack_deviation(F.col("value"))}).where("mean IS NOT NULL AND std IS NOT NULL")
    names = params if params is not None else [r[0] for r in rows.select("param").distinct().orderBy("param").collect()]
    last = lambda p, c: F.max_by(F.when(F.col("param") == p, F.col(c)), F.when(F.col("param") == p, F.col(order)))
    if not names:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*(last(p, c).alias(f"{p}_{c}") for c in ("mean", "std") for p in names)).orderBy(*keys)
