"""From signals to positions: volatility targets, caps, throttles, the kill switch and the orders that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import by_symbol, carried, clip, lag, log, ratio, roll, so_far
from tidebar.operators.joins import on_calendar
from tidebar.operators.kernels import ewm

BOOK = ("book",)


@dataclass(frozen=True)
class RiskConfig:
    target_annual_vol: float = 0.20
    max_gross_leverage: float = 2.0
    max_position_per_asset: float = 0.5
    vol_lookback: int = 72
    kelly_fraction: float = 0.25
    max_daily_loss: float = 0.03
    max_drawdown: float = 0.20
    bars_per_year: float = 8760.0


def vol_target_weights(bars: DataFrame, signal: DataFrame, risk: RiskConfig = RiskConfig(), max_scale: float = 5.0, books: tuple[str, ...] = ()) -> DataFrame:
    """(books, symbol, ts, weight) on the calendar of bars; books are key columns of signal, one portfolio for each value.

    A signal is divided by its symbol's weighted volatility; the book of these raw weights gives a volatility of its own,
    and the scale that brings it to the target holds from the next bar on. Then come the cap of each symbol and that of
    the whole book. Two recursions (one by symbol, one over the book, a row for each ts) and otherwise windows."""
    year = risk.bars_per_year**0.5
    own = on_calendar(bars, books, signal).join(signal.select(*books, "symbol", "ts", "signal"), [*books, "symbol", "ts"], "left")
    w = by_symbol(*books)
    own = own.withColumn("_ret", log(F.col("close")) - lag(log(F.col("close")), spec=w))
    own = ewm(own, {"_vol": {"column": "_ret", "stat": "std", "halflife": risk.vol_lookback, "min_periods": risk.vol_lookback // 2}}, ("symbol", *books))
    own = own.withColumn("_raw", F.coalesce(ratio(F.col("signal"), F.col("_vol") * year), F.lit(0.0)))
    earned = own.select(*books, "ts", (F.coalesce(lag("_raw", spec=w), F.lit(0.0)) * F.coalesce("_ret", F.lit(0.0))).alias("_earned"))
    key = books or BOOK
    book = earned.groupBy(*books, "ts").agg(F.sum("_earned").alias("_book"))
    book = ewm(book if books else book.withColumn("book", F.lit("all")), {"_vol": {"column": "_book", "stat": "std", "halflife": risk.vol_lookback * 4, "min_periods": risk.vol_lookback}}, key)
    in_order = Window.partitionBy(*key).orderBy("ts")
    scale = ratio(F.lit(risk.target_annual_vol), F.col("_vol") * year)
    book = book.withColumn("_now", F.when(scale.isNotNull(), F.least(scale, F.lit(max_scale)))).withColumn("_scale", F.lag("_now").over(in_order))
    book = book.select(*books, "ts", F.coalesce(carried(F.col("_scale"), in_order), F.lit(0.0)).alias("_scale"))
    capped = own.join(book, [*books, "ts"]).withColumn("_w", clip(F.col("_raw") * F.col("_scale"), -risk.max_position_per_asset, risk.max_position_per_asset))
    gross = F.sum(F.abs("_w")).over(Window.partitionBy(*books, "ts"))
    shrink = F.coalesce(F.least(ratio(F.lit(risk.max_gross_leverage), gross), F.lit(1.0)), F.lit(1.0))
    return capped.select(*books, "symbol", "ts", F.coalesce(F.col("_w") * shrink, F.lit(0.0)).alias("weight"))


def kelly_fraction(returns: DataFrame, window: int = 720, cap: float = 1.0, column: str = "ret", keys: tuple[str, ...] = BOOK) -> DataFrame:
    """returns with kelly: trailing mean over variance, within the cap, 0 until half the window has values."""
    w = Window.partitionBy(*keys).orderBy("ts")
    x = F.col(column)
    value = ratio(roll(F.avg, x, window, window // 2, w), roll(F.var_samp, x, window, window // 2, w))
    return returns.withColumn("kelly", F.coalesce(clip(value, -cap, cap), F.lit(0.0)))


def drawdown_throttle(equity: DataFrame, start: float = 0.08, stop: float = 0.20, keys: tuple[str, ...] = BOOK) -> DataFrame:
    """equity (ts, equity) with throttle: 1 up to a drawdown of start, falling to 0 at stop."""
    w = Window.partitionBy(*keys).orderBy("ts")
    fallen = F.abs(ratio(F.col("equity"), F.max("equity").over(so_far(w))) - 1)
    return equity.withColumn("throttle", clip(1 - (fallen - start) / (stop - start), 0.0, 1.0))


def _breaches(equity: Column, day_start: Column, peak: Column, risk: RiskConfig) -> tuple[Column, Column, Column]:
    """The loss of the day, the drawdown, and which limit is broken (the drawdown counts first); a zero base never is."""
    loss, fallen = ratio(equity, day_start) - 1, ratio(equity, peak) - 1
    return loss, fallen, F.when(fallen <= -risk.max_drawdown, "max drawdown hit").when(loss <= -risk.max_daily_loss, "daily loss limit hit")


def kill_switch(equity: DataFrame, risk: RiskConfig = RiskConfig(), keys: tuple[str, ...] = BOOK) -> DataFrame:
    """equity (ts, equity) with daily_loss, drawdown, tripped and reason: a switch that trips stays so, and its reason is
    that of the last breach. A UTC day begins with its first bar. `streaming.live.kill_switch_stream` is the same, bar by bar."""
    w = Window.partitionBy(*keys).orderBy("ts")
    today = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    marked = equity.withColumns({"_start": F.first("equity").over(today), "_peak": F.max("equity").over(so_far(w))})
    loss, fallen, reason = _breaches(F.col("equity"), F.col("_start"), F.col("_peak"), risk)
    out = marked.withColumns({"daily_loss": loss, "drawdown": fallen, "_breach": reason})
    out = out.withColumn("reason", carried(F.col("_breach"), w))
    return out.withColumn("tripped", F.col("reason").isNotNull()).drop("_start", "_peak", "_breach")


def rebalance_orders(weights: DataFrame, positions: DataFrame, prices: DataFrame, equity: float, band: float = 0.1) -> DataFrame:
    """(symbol, current, target, delta, reduce_only) of the symbols whose gap is worth a trade.

    weights (symbol, weight), positions (symbol, qty; none is 0) and prices (symbol, price). The gap must reach band *
    equity * |weight| (the band itself for no weight), and 0.2 % of the equity. An order reduces only if it shrinks the
    position without crossing zero. A symbol without a price, or with price 0, has no order."""
    rows = weights.join(positions.select("symbol", "qty"), "symbol", "left").join(prices.select("symbol", "price"), "symbol")
    current = F.coalesce("qty", F.lit(0.0))
    target = ratio(F.coalesce("weight", F.lit(0.0)) * equity, F.col("price"))
    rows = rows.select("symbol", "price", current.alias("current"), target.alias("target"), F.coalesce("weight", F.lit(0.0)).alias("_w")).where("target is not null")
    gap = F.abs(F.col("target") - F.col("current")) * F.col("price")
    least = F.greatest(band * equity * F.abs(F.when(F.col("_w") == 0, F.lit(band)).otherwise(F.col("_w"))), F.lit(0.002 * equity))
    shrinks = (F.abs("target") < F.abs("current")) & ((F.col("target") == 0) | (F.signum("target") == F.signum("current")))
    return rows.where(gap >= least).select("symbol", "current", "target", (F.col("target") - F.col("current")).alias("delta"), shrinks.alias("reduce_only"))


def last_rows(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """The latest row of each key: an aggregation, not a sort. Ties go to the greatest row."""
    row = F.max_by(F.struct(*df.columns), F.struct(ts, *[c for c in df.columns if c not in (*keys, ts)]))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def tail_rows(df: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """The latest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


