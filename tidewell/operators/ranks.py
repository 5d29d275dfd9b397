"""Order statistics of large groups: counted values, ranks, percentiles and shortest intervals.

Equal values are counted first, by partial aggregation, so a value that most rows have is one row. The distinct values are
range-partitioned by key and value and their counts added up over the ranges (``scans``); a value then stands for the ranks
from ``before`` to ``before + held - 1``. No task holds a group, whatever the share of one key or value, and the results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import missing
from .scans import Scan


def counted(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """keys, v, held (rows with this value), before (rows with lesser values) and n (size of the group) of every distinct value that is there.

    With ``weight`` a row counts that often.
    """
    values = rows.select(*keys, (missing(F.col(value)) + 0.0).alias("v"), (F.lit(1) if weight is None else weight).cast("long").alias("_weight")).where("v IS NOT NULL")
    counts = values.groupBy(*keys, "v").agg(F.sum("_weight").alias("held"))
    summed = Scan(counts, keys, ["v"]).total(F.col("held"), "_upto").whole(F.col("held"), "n").result()
    return summed.select(*keys, "v", "held", (F.col("_upto") - F.col("held")).alias("before"), "n")


def average_rank() -> Column:
    """The rank from 1 of a row of ``counted``; ties share their mean rank."""
    return F.col("before") + (F.col("held") + 1) / 2.0


def percentile_of(share: float) -> Column:
    """A percentile of the rows of ``counted``, linear between the two ranks around it; to be aggregated by key."""
    at = F.lit(share) * (F.col("n") - 1)
    low, part = F.floor(at), at - F.floor(at)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("held"))
    weight = F.when(holds(low), 1.0 - part).otherwise(0.0) + F.when(holds(low + 1), part).otherwise(0.0)
    return F.sum(F.when(weight > 0, F.col("v") * weight))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles of each group under the given names."""
    return counted(rows, keys, value).groupBy(*keys).agg(*(percentile_of(q).alias(name) for name, q in shares.items()))


def same_keys(left: str, right: str, keys: list[str]) -> list[Column]:
    """Equality of keys of two aliased frames; null keys meet each other."""
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def shortest_interval(rows: DataFrame, keys: list[str], value: str, mass: float = 0.95) -> DataFrame:
    """hdi_lo, hdi_hi: the shortest interval over floor(mass * n) ranks, the first of equals; null for groups without values.

    An interval that begins with a value is shortest from the value's first rank on, so each distinct value asks once for the value
    that holds the rank at its other end; asks and values meet in one ordered scan by rank.
    """
    r = counted(rows, keys, value)
    k = F.least(F.floor(F.lit(mass) * F.col("n")), F.col("n") - 1)
    none = F.lit(None).cast("double")
    asks = r.where(F.col("before") + k < F.col("n")).select(*keys, (F.col("before") + k).alias("at"), F.col("before").alias("i"), F.col("v").alias("lo"), none.alias("v"))
    runs = r.select(*keys, F.col("before").alias("at"), F.lit(None).cast("long").alias("i"), none.alias("lo"), "v")
    met = Scan(asks.union(runs), keys, ["at"]).carry(F.col("v"), "hi").result().where("i IS NOT NULL")
    width = F.struct(F.round(F.col("hi") - F.col("lo"), 9).alias("width"), "i", "lo", "hi")
    best = met.groupBy(*keys).agg(F.min(width).alias("best")).select(*keys, F.col("best.lo").alias("hdi_lo"), F.col("best.hi").alias("hdi_hi"))
    groups = rows.select(*keys).distinct().alias("groups")
    out = groups.join(best.alias("best"), same_keys("groups", "best", keys), "left") if keys else best
    return out.select(*(F.col(f"groups.{k}").alias(k) for k in keys), "hdi_lo", "hdi_hi")
