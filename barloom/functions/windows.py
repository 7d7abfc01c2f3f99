"""Row-frame windows over a symbol's bars.

Frames count rows, never time. Rolling values are NULL until the frame holds n non-null values.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, TIME = "symbol", "ts"


def ordered(key: str | list[str] = KEY, time: str = TIME) -> WindowSpec:
    return W.partitionBy(key).orderBy(time)


def last(n: int, key: str | list[str] = KEY, time: str = TIME) -> WindowSpec:
    return ordered(key, time).rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column, **over) -> Column:
    return F.when(F.count(x).over(last(n, **over)) == n, value)


def mean(x: Column, n: int, **over) -> Column:
    return full(x, n, F.avg(x).over(last(n, **over)), **over)


def total(x: Column, n: int, **over) -> Column:
    return full(x, n, F.sum(x).over(last(n, **over)), **over)


def deviation(x: Column, n: int, **over) -> Column:
    return full(x, n, F.stddev_pop(x).over(last(n, **over)), **over)


def zscore(x: Column, n: int, **over) -> Column:
    """Population z-score of the last value; NULL where the frame is constant."""
    sd = F.stddev_pop(x).over(last(n, **over))
    return full(x, n, F.try_divide(x - F.avg(x).over(last(n, **over)), F.when(sd > 1e-12, sd)), **over)


def mid_rank(x: Column, n: int, **over) -> Column:
    """2 * (values below + half of the equal ones) / n - 1 for the last value."""
    seen = F.collect_list(x).over(last(n, **over))
    below, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return full(x, n, 2 * (below + 0.5 * equal) / n - 1, **over)


def slope(x: Column, n: int, position: str = "pos", **over) -> Column:
    """Least-squares slope of the last n values over their row numbers."""
    return full(x, n, F.regr_slope(x, F.col(position).cast("double")).over(last(n, **over)), **over)


def median(x: Column, n: int, **over) -> Column:
    return full(x, n, F.percentile(x, 0.5).over(last(n, **over)), **over)
