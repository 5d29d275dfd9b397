"""Contracts that are checked where the data flow, at no job of their own: what breaks one ends the query with its key named.

A check is part of a column that the result needs, so it is neither pruned nor run twice. ``watched`` counts rows on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _key(keys: list[str], frame: str | None = None) -> Column:
    of = lambda k: F.coalesce(F.col(f"{frame}.{k}" if frame else k).cast("string"), F.lit("null"))
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), of(k)) for k in keys))


def failing(condition: Column, message: str, keys: list[str], value: Column, kind: str) -> Column:
    """``value``, or an error with ``message`` and the row's keys where ``condition`` holds."""
    told = F.raise_error(F.concat(F.lit(f"{message}: "), _key(keys)))
    return F.when(condition, told.cast(kind)).otherwise(value)


def required(rows: DataFrame, column: str, keys: list[str], message: str | None = None) -> DataFrame:
    """``rows`` whose ``column`` is never null."""
    kind = dict(rows.dtypes)[column]
    return rows.withColumn(column, failing(F.col(column).isNull(), message or f"no {column}", keys, F.col(column), kind))


def known(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the listed ids; an id without any row is an error. One join finds both."""
    listed = ids.select(F.col(key).alias("_asked")).distinct()
    both = listed.join(rows.withColumn("_there", F.lit(True)), F.col("_asked") == F.col(key), "left")
    told = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col("_asked").cast("string")))
    kind = dict(rows.dtypes)[key]
    return both.withColumn(key, F.when(F.col("_there").isNull(), told.cast(kind)).otherwise(F.col(key))).select(*rows.columns)


def pivoted(rows: DataFrame, key: str, column: str, value: str, order: list) -> DataFrame:
    """Long to wide, ``order`` across; two rows for one cell are an error, a cell without a row is null, other columns are left out."""
    kind = dict(rows.dtypes)[value]
    cell = rows.where(F.col(column).isin(order)).groupBy(key, column).agg(F.count("*").alias("_rows"), F.first(value).alias("_value"))
    cell = cell.withColumn("_value", failing(F.col("_rows") > 1, "more than one value", [key, column], F.col("_value"), kind))
    return cell.groupBy(key).pivot(column, order).agg(F.first("_value")).orderBy(key)


def paired(observed: DataFrame, predicted: DataFrame, keys: list[str], value: str = "pred") -> DataFrame:
    """Observations beside predictions, all of both; a key that one side lacks, or has twice, is an error."""
    counted = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name), *(F.first(c).alias(c) for c in df.columns if c not in keys))
    both = counted(observed, "_observed").join(counted(predicted, "_predicted"), keys, "full")
    kind = dict(predicted.dtypes)[value]
    column = F.col(value)
    for name in ("_observed", "_predicted"):
        column = failing(F.coalesce(F.col(name), F.lit(0)) != 1, f"not {name[1:]} once", keys, column, kind)
    return both.withColumn(value, column).drop("_observed", "_predicted")


def watched(rows: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``rows`` and an observation that holds their number (and further aggregates) once an action has run over them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen
