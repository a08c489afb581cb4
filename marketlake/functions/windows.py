"""Rolling and ordered functions over one series per key. A rolling value needs a full window of non-null inputs.

All take the columns that make the series; used together on the same keys they share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.functions.numeric import ratio


def series(*keys: str, by: str = "date") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(by)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, x, n, w)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.stddev_samp, x, n, w)


def rolling_min(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.min, x, n, w)


def rolling_max(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.max, x, n, w)


def diff(x: Column, k: int, w: WindowSpec) -> Column:
    return x - F.lag(x, k).over(w)


def pct_change(x: Column, k: int, w: WindowSpec) -> Column:
    return ratio(x, F.lag(x, k).over(w)) - 1


def cumsum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(W.unboundedPreceding, 0))


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def from_end(w_keys: list[str], by: str = "date") -> Column:
    """1 for the last row of each series, 2 for the one before."""
    return F.row_number().over(W.partitionBy(*w_keys).orderBy(F.col(by).desc()))
