"""A cost-aware backtest: windows by symbol for the positions, then one aggregation by ts for the book."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import by_symbol, carried, lag, product, ratio
from tidebar.operators.joins import calendar, on_calendar


@dataclass(frozen=True)
class Costs:
    """Basis points, and the share of trades that make rather than take liquidity."""

    taker: float = 4.5
    maker: float = 2.0
    slippage: float = 2.0
    maker_share: float = 0.0

    @property
    def per_turnover(self) -> float:
        return (self.maker_share * self.maker + (1 - self.maker_share) * self.taker + self.slippage) / 1e4


def run_backtest(
    bars: DataFrame, weights: DataFrame, costs: Costs = Costs(), funding: DataFrame | None = None, delay: int = 1, max_gross: float | None = None, books: tuple[str, ...] = ()
) -> DataFrame:
    """(books, ts, gross, turnover, cost, funding, exposure, ret). A weight set at bar t is held from bar t + delay, pays for
    its trade there and earns from the bar after. A missing bar keeps the last price; a missing weight is 0. books are
    key columns of weights: all their portfolios run in one plan."""
    w = by_symbol(*books)
    out = on_calendar(bars, books, weights).join(weights.select(*books, "symbol", "ts", "weight"), [*books, "symbol", "ts"], "left")
    if funding is not None:
        out = out.join(funding.select("symbol", "ts", F.col("funding_rate").alias("_rate")), ["symbol", "ts"], "left")
    else:
        out = out.withColumn("_rate", F.lit(0.0))
    out = out.withColumns({"_price": carried(F.col("close"), w), "_pos": F.coalesce(lag(F.coalesce("weight", F.lit(0.0)), delay, w), F.lit(0.0))})
    if max_gross is not None:
        book = F.sum(F.abs("_pos")).over(Window.partitionBy(*books, "ts"))
        out = out.withColumn("_pos", F.when(book > max_gross, F.col("_pos") * max_gross / book).otherwise(F.col("_pos")))
    held = F.coalesce(F.lag("_pos").over(w), F.lit(0.0))
    move = F.coalesce(ratio(F.col("_price"), F.lag("_price").over(w)) - 1, F.lit(0.0))
    rows = out.select(*books, "ts", (held * move).alias("_gross"), F.abs(F.col("_pos") - held).alias("_trade"), (held * F.coalesce("_rate", F.lit(0.0))).alias("_fund"), F.abs("_pos").alias("_size"))
    book = rows.groupBy(*books, "ts").agg(F.sum("_gross").alias("gross"), F.sum("_trade").alias("turnover"), F.sum("_fund").alias("funding"), F.sum("_size").alias("exposure"))
    return book.withColumn("cost", F.col("turnover") * costs.per_turnover).withColumn("ret", F.col("gross") - F.col("cost") - F.col("funding"))


def with_equity(book: DataFrame, initial: float = 10_000.0, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """book with equity, from the initial one on. Without such a key column all rows are one book."""
    out = book if set(keys) <= set(book.columns) else book.withColumn("book", F.lit("all"))
    equity = initial * product(1 + F.coalesce("ret", F.lit(0.0)), Window.partitionBy(*keys).orderBy("ts"))
    return out.withColumn("equity", equity)


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Constant equal weights on the calendar of bars."""
    n = bars.select("symbol").distinct().agg((1 / F.count("*")).alias("weight"))
    return calendar(bars).crossJoin(F.broadcast(n))  # one row
