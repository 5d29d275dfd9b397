"""Arithmetic that treats NaN as missing and undefined quotients as null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: mean and deviation packed as "1.2e+05 ± 3.1e+04"; the class of characters includes the plus sign.
PACKED = r"^\s*([0-9eE.+-]+)\s*±\s*([0-9eE.+-]+)\s*$"


def missing(x: Column) -> Column:
    """NaN as null, so that no comparison accepts it."""
    return F.when(~F.isnan(x), x)


def divide(a: Column, b: Column) -> Column:
    """a / b, null for a zero or missing denominator."""
    return F.try_divide(a, b)


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: what a lambda only mentions is computed anew for every element."""
    return F.transform(F.array(x), f)[0]


def sum0(x: Column) -> Column:
    """Sum with 0 for a group of nulls only."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation, null where a side is constant."""
    return divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def significant(x: Column, digits: int = 3) -> Column:
    """x rounded to significant figures."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def unpack_mean(packed: Column) -> Column:
    return F.regexp_extract(packed, PACKED, 1).try_cast("double")


def unpack_deviation(packed: Column) -> Column:
    return F.regexp_extract(packed, PACKED, 2).try_cast("double")
