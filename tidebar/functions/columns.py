"""Column builders shared by all operators. Rows of a symbol are ordered by ts, windows count rows and look back only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BEFORE = Window.unboundedPreceding


def by_symbol(*more: str) -> WindowSpec:
    return Window.partitionBy("symbol", *more).orderBy("ts")


def frame(k: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The last k rows, this one included."""
    return (spec or by_symbol()).rowsBetween(-(k - 1), 0)


def so_far(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_symbol()).rowsBetween(BEFORE, 0)


def lag(x: Column | str, k: int = 1, spec: WindowSpec | None = None) -> Column:
    return F.lag(x, k).over(spec or by_symbol())


def roll(agg, x: Column, k: int, at_least: int | None = None, spec: WindowSpec | None = None) -> Column:
    """agg over the last k rows, null where fewer than at_least (k if not given) values are there."""
    w = frame(k, spec)
    return F.when(F.count(x).over(w) >= (k if at_least is None else at_least), agg(x).over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within bounds; null stays null."""
    low, high = (b if isinstance(b, Column) else F.lit(float(b)) for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def zscore(x: Column, k: int) -> Column:
    half = k // 2
    return ratio(x - roll(F.avg, x, k, half), roll(F.stddev_samp, x, k, half))


def skewness(x: Column, k: int, at_least: int) -> Column:
    """Bias-corrected, like the pandas and DuckDB ones."""
    n = F.count(x).over(frame(k)).cast("double")
    g = F.skewness(x).over(frame(k))
    return F.when(n >= max(at_least, 3), g * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column, k: int, at_least: int) -> Column:
    """Bias-corrected excess."""
    n = F.count(x).over(frame(k)).cast("double")
    g = F.kurtosis(x).over(frame(k))
    return F.when(n >= max(at_least, 4), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def pct_rank(x: Column, *keys: str) -> Column:
    """Average-tie rank among the values of a group, over their number; nulls have none."""
    group = Window.partitionBy(*keys)
    tied = F.count("*").over(Window.partitionBy(*keys, x))
    rank = F.rank().over(group.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (rank + (tied - 1) / 2) / F.count(x).over(group))


def mean_of(*xs: Column) -> Column:
    """Mean of the values that are there, in one row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    return ratio(total, reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs]))


def carried(x: Column, spec: WindowSpec | None = None) -> Column:
    """The last value that is not null."""
    return F.last(x, ignorenulls=True).over(so_far(spec))


def product(x: Column, spec: WindowSpec | None = None) -> Column:
    """Running product."""
    return F.product(x).over(so_far(spec))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def r6(x: Column | str) -> Column:
    """Six decimals, rounded the same way in any engine; no negative zero. For values below 9e12."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def stamp(x: Column | str = "ts") -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")
