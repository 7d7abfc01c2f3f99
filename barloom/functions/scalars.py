"""Scalar expressions. Missing is NULL throughout; NaN and infinities become NULL on entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == INF), None).otherwise(x)


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; a zero divisor, an infinity or a missing value gives the default."""
    q = finite(F.try_divide(a.cast("double"), b.cast("double")))
    return q if default is None else F.coalesce(q, F.lit(default))


def clip(x: Column, lo: float, hi: float) -> Column:
    """least and greatest skip NULL, so NULL is kept apart."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def positive_log(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a comparison with NULL is false."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def all_missing(*columns: str) -> Column:
    return F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNull()).cast("double")
