"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.25


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def years_between(later: str | Column, earlier: str | Column) -> Column:
    """Day count divided by 365.25."""
    return F.datediff(col(later), col(earlier)) / F.lit(DAYS_PER_YEAR)


def parse_compact_date(c: str | Column) -> Column:
    """``yyyymmdd`` text or integer to DATE; anything unreadable becomes NULL."""
    text = F.trim(col(c).cast("string"))
    return F.when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation; NULL instead of an ANSI error when a side is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def share(flag: Column) -> Column:
    """Mean of a boolean (NULL flags do not count)."""
    return F.avg(flag.cast("double"))


def wilson_bounds(rate: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    z2 = z * z
    n = n.cast("double")
    centre = (rate + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


def two_rate_se(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    """Standard error of the difference of two independent rates."""
    return F.sqrt(
        p1 * (1 - p1) / F.greatest(n1, F.lit(1)) + p2 * (1 - p2) / F.greatest(n2, F.lit(1))
    )


def ladder(value: Column, edges: list[tuple[float, str]], otherwise: str) -> Column:
    """Label by the first ``upper`` (inclusive) that the value does not exceed."""
    expr = None
    for upper, label in edges:
        expr = F.when(value <= upper, label) if expr is None else expr.when(value <= upper, label)
    return expr.otherwise(otherwise)


def clip(value: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, value))
