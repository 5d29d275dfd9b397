"""Series as vectors: one row a series with an array of its points, and metrics as folds over that array.

For many series of moderate length (some thousand points): they are shuffled once, by key, and everything that follows is an expression
within a row. Series that are too long for a row go through ``metrics`` and ``scans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import residual
from ..functions.safe import bind, divide, missing


def vectors(rows: DataFrame, keys: list[str], columns: list[str], out: str = "series") -> DataFrame:
    """keys and ``out``: the named columns of each series' rows as an array of structs, sorted by them from the first on."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(out))


def dense(rows: DataFrame, key: str, index: str, value: str, out: str = "series") -> DataFrame:
    """key and ``out``: (index, value) at every index that any key has, sorted, null where a key has none; so place i is the same index in each row.

    Missing keys and indexes are left out; of repeated (key, index) rows the greatest value counts.
    """
    present = rows.select(F.col(key), missing(F.col(index).cast("double")).alias(index), missing(F.col(value).cast("double")).alias(value))
    present = present.where(F.col(key).isNotNull() & F.col(index).isNotNull())
    shared = present.select(index).distinct().agg(F.sort_array(F.collect_list(index)).alias("all"))
    held = present.groupBy(key, index).agg(F.max(value).alias(value)).groupBy(key)
    held = held.agg(F.map_from_entries(F.collect_list(F.struct(index, value))).alias("_held"))
    point = lambda t: F.struct(t.alias(index), F.try_element_at("_held", t).alias(value))
    return held.withColumn("_all", shared.scalar()).select(key, F.transform("_all", point).alias(out))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)


def centred_ranks(x: Column) -> Column:
    """Average ranks of an array's values less their mean, by the first and last place of each value in the sorted array."""
    sides = F.struct(F.array_sort(x).alias("up"), F.reverse(F.array_sort(x)).alias("down"))
    return bind(sides, lambda s: F.transform(x, lambda v: (F.array_position(s["up"], v) - F.array_position(s["down"], v)) / 2.0))


def _correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays, null where one is constant."""
    centred = lambda x: bind(_sum(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    times = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: u * v))
    both = F.struct(centred(a).alias("a"), centred(b).alias("b"))
    return bind(both, lambda d: divide(times(d["a"], d["b"]), F.sqrt(times(d["a"], d["a"]) * times(d["b"], d["b"]))))


def fold_metrics(series: DataFrame, column: str = "series", obs: str = "obs", pred: str = "pred", sigma: float = 0.5, free: int = 3) -> DataFrame:
    """``series`` with n, rmse, nrmse_range, nrmse_mean, nrmse_std, mase, spearman, variance_ratio, autocorrelation, log_likelihood and bic in
    place of the array, over points with both sides, in the array's order; a series without such points has n = 0 and nulls.
    """
    keys = [c for c in series.columns if c != column]
    whole = F.filter(column, lambda p: missing(p[obs].cast("double")).isNotNull() & missing(p[pred].cast("double")).isNotNull())
    rows = series.select(*keys, whole.alias("_s"))
    side = lambda c: F.transform("_s", lambda p: p[c].cast("double") + 0.0)
    rows = rows.select(*keys, side(obs).alias("_o"), side(pred).alias("_p"))
    rows = rows.select("*", F.size("_o").alias("n"), F.zip_with("_o", "_p", lambda x, y: x - y).alias("_r"), divide(_sum(F.col("_o")), F.size("_o")).alias("_mean"))
    rows = rows.select("*", centred_ranks(F.col("_o")).alias("_ro"), centred_ranks(F.col("_p")).alias("_rp"))
    o, r, n = F.col("_o"), F.col("_r"), F.col("n")
    square = lambda x: _sum(F.transform(x, lambda v: v * v))
    rmse = F.sqrt(divide(square(r), n))
    spread = F.transform(o, lambda v: v - F.col("_mean"))
    three = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.slice(r, i, F.lit(3)))
    variance = lambda x: bind(divide(_sum(x), F.size(x)), lambda m: divide(_sum(F.transform(x, lambda v: (v - m) * (v - m))), F.size(x)))
    local = F.when(n >= 3, divide(_sum(F.transform(three, variance)), n - 2))
    lagged = F.when(n >= 2, _correlation(F.slice(r, F.lit(2), n - 1), F.slice(r, F.lit(1), n - 1)))
    each = F.zip_with("_o", "_p", lambda x, y: -0.5 * F.log(F.lit(2.0 * 3.141592653589793 * sigma * sigma)) - F.pow(residual(x, y), F.lit(2.0)) / (2.0 * sigma * sigma))
    rows = rows.select("*", rmse.alias("rmse"), F.when(n > 0, _sum(each)).alias("log_likelihood"))
    return rows.select(
        *keys, n.cast("long").alias("n"), "rmse",
        divide(F.col("rmse"), F.array_max(o) - F.array_min(o)).alias("nrmse_range"),
        divide(F.col("rmse"), F.col("_mean")).alias("nrmse_mean"),
        divide(F.col("rmse"), F.sqrt(divide(square(spread), n))).alias("nrmse_std"),
        divide(_sum(F.transform(r, lambda v: F.abs(v))), _sum(F.transform(spread, lambda v: F.abs(v)))).alias("mase"),
        divide(_sum(F.zip_with("_ro", "_rp", lambda x, y: x * y)), F.sqrt(square(F.col("_ro")) * square(F.col("_rp")))).alias("spearman"),
        divide(local, variance(r)).alias("variance_ratio"), lagged.alias("autocorrelation"), "log_likelihood",
        F.when(n > 0, float(free) * F.log(n.cast("double")) - 2.0 * F.col("log_likelihood")).alias("bic"),
    )
