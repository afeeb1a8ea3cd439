"""Column expressions for long panels keyed by (symbol, date).

Rolling values need all rows of their window (`full`); cross-sections are windows over one date; deviations are sample
deviations; a zero deviation counts as 1, that of a single row is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """A finite double or null."""
    x = col(x).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def positive(x: Column | str) -> Column:
    return F.when(col(x) > 0, col(x))


def last_rows(n: int, until: int = 0) -> WindowSpec:
    return by_symbol().rowsBetween(until - n + 1, until)


def full(x: Column | str, n: int, how: str = "avg", until: int = 0) -> Column:
    """An aggregate of the last n rows, null unless all n have a value."""
    frame = last_rows(n, until)
    return F.when(F.count(col(x)).over(frame) == n, getattr(F, how)(col(x)).over(frame))


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def change(x: Column | str, n: int = 1, skip: int = 0) -> Column:
    """x[t - skip] / x[t - skip - n] - 1; gaps are not bridged."""
    return ratio(F.lag(col(x), skip).over(by_symbol()) if skip else col(x), F.lag(col(x), skip + n).over(by_symbol())) - 1


def unit(deviation: Column) -> Column:
    return F.when(deviation == 0, 1.0).otherwise(deviation)


def zscore(x: Column | str, over: WindowSpec | None = None) -> Column:
    x, over = col(x), over or by_date()
    return (x - F.avg(x).over(over)) / unit(F.stddev_samp(x).over(over))


def rank_share(x: Column | str, keys: Sequence[str] = ("date",)) -> Column:
    """Rank with ties averaged, as a share of the rows with a value."""
    x = col(x)
    group = Window.partitionBy(*keys, x.isNull()).orderBy(x)
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (F.rank().over(group) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def moment_corr(x: Column, y: Column, fold) -> Column:
    """Pearson correlation from sums; `fold` turns a column into its aggregate. Null where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n, sx, sy, sxy, sxx, syy = (fold(v) for v in (F.when(both, 1.0), x, y, x * y, x * x, y * y))
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(spread > 1e-18, (n * sxy - sx * sy) / F.sqrt(F.when(spread > 0, spread)))


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean of the values that are there."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return ratio(total, n)
