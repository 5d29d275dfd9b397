"""The normal distribution as column expressions: distribution function and its inverse, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of published rational approximations, fixed values, from the highest power down.
CDF_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def cdf(x: Column) -> Column:
    """The share of a standard normal distribution below x."""
    a = F.least(F.abs(x), F.lit(38.0))
    near = F.exp(-a * a / 2.0) * _polynomial(CDF_ABOVE, a) / _polynomial(CDF_BELOW, a)
    far = F.exp(-a * a / 2.0) / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def quantile(p: Column) -> Column:
    """The value that a standard normal distribution has the share p below; null unless 0 < p < 1."""
    q = p - 0.5
    r = 0.180625 - q * q
    ratio = lambda pair, t: _polynomial(pair[0], t) / _polynomial(pair[1], t)
    s = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    tail = F.when(s <= 5.0, ratio(TAIL, s - 1.6)).otherwise(ratio(FAR_TAIL, s - 5.0))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, r)).otherwise(F.signum(q) * tail))


def _polynomial_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    """``cdf`` as SQL text."""
    a = f"least(abs({x}), 38.0::DOUBLE)"
    near = f"exp(-{a} * {a} / 2) * {_polynomial_sql(CDF_ABOVE, a)} / {_polynomial_sql(CDF_BELOW, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE"
    tail = f"(CASE WHEN {a} < 7.07106781186547::DOUBLE THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def quantile_sql(p: str) -> str:
    """``quantile`` as SQL text."""
    q, ratio = f"({p} - 0.5::DOUBLE)", lambda pair, t: f"{_polynomial_sql(pair[0], t)} / {_polynomial_sql(pair[1], t)}"
    s = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {s} <= 5 THEN {ratio(TAIL, f'({s} - 1.6::DOUBLE)')} ELSE {ratio(FAR_TAIL, f'({s} - 5)')} END"
    return f"(CASE WHEN abs({q}) <= 0.425::DOUBLE THEN {q} * {ratio(CENTRE, f'(0.180625::DOUBLE - {q} * {q})')} ELSE sign({q}) * ({tail}) END)"
