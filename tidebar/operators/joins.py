"""Alignment of time series: as-of joins, calendars and panels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """left with the columns of the latest right row at or before each row's ts; a null value on the right is passed
    over. A union and one window: a single shuffle by key, and no row of left meets more than its own key's rows."""
    names = [f"_{c}" for c in columns]
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, ts, *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("*", *[F.last(n, ignorenulls=True).over(w).alias(c) for c, n in zip(columns, names, strict=True)])
    return filled.where("_side = 1").select(*left.columns, *columns)


def calendar(bars: DataFrame) -> DataFrame:
    """Every symbol at every ts that any symbol has. The symbols, one row each, are what is repeated."""
    return bars.select("ts").distinct().crossJoin(F.broadcast(bars.select("symbol").distinct()))


def on_calendar(bars: DataFrame, books: tuple[str, ...] = (), keyed: DataFrame | None = None) -> DataFrame:
    """(books, symbol, ts, close) on the calendar, once for each book of `keyed`; books are the variants that a caller lists."""
    out = calendar(bars).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    return out.crossJoin(F.broadcast(keyed.select(*books).distinct())) if books else out


def as_of_event(events: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """events with bar_ts: the first bar at or after each event; null where none follows and where a key or ts is null. A
    union and one window that runs backwards in time, so each row is visited once: a frame that ends at the last row would
    be read again for every row."""
    both = events.withColumn("_side", F.lit(0)).unionByName(bars.select(*keys, "ts", F.col("ts").alias("_bar"), F.lit(1).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "ts")])
    return both.withColumn("bar_ts", F.when(known, F.last("_bar", ignorenulls=True).over(w))).where("_side = 0").select(*events.columns, "bar_ts")


def without_overlap(rows: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows (ts, t1) that overlap no span (begin, end) of their key: t1 > begin and ts < end is an overlap."""
    own, other = rows.alias("r"), spans.alias("s")
    same = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in keys]
    return own.join(other, [*same, F.col("r.t1") > F.col("s.begin"), F.col("r.ts") < F.col("s.end")], "left_anti")


def densify(bars: DataFrame, series: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """series on the calendar of bars; gaps are filled with `fill`, or left null."""
    out = calendar(bars).join(series, ["symbol", "ts"], "left")
    return out if fill is None else out.na.fill(fill)


def panel(bars: DataFrame, field: str, symbols: list[str]) -> DataFrame:
    """Wide: a row for each ts, a column for each symbol in the order given."""
    return bars.where(F.col("symbol").isin(symbols)).groupBy("ts").pivot("symbol", symbols).agg(F.first(field))
