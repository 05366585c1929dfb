"""Streams of ticks and bars, and the decision cycle. Stateful steps give row by row what the batch operators give whole."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.operators.risk import RiskConfig, last_rows, rebalance_orders, tail_rows
from tidebar.plans.research import write_state
from tidebar.session import ship
from tidebar.sources.lake import Lake

log = logging.getLogger(__name__)


def bar_windows(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, quote_volume, trades) of ticks (symbol, at, id, price) in tumbling
    windows. In append mode a bar comes out once the watermark says it has closed; a later tick for it is dropped."""
    timed = ticks.withWatermark("at", late) if ticks.isStreaming else ticks
    key = F.struct("at", "id")
    bars = timed.groupBy("symbol", F.window("at", width).alias("_w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("price").alias("quote_volume"), F.count("*").alias("trades"),
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "trades")


def once(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Bars with redelivered ones dropped: the first of (symbol, ts) within the watermark stays."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"]) if bars.isStreaming else bars.dropDuplicates(["symbol", "ts"])


def upserting(lake: Lake, dataset: str = "klines") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a redelivered batch writes the same rows again and changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            lake.write(batch, dataset)

    return write


def kill_switch_stream(equity: DataFrame, risk: RiskConfig = RiskConfig()) -> DataFrame:
    """(book, ts, equity, reason) of a stream (book, ts, equity): peak, day and the last breach are kept for each book, so
    a tripped switch stays tripped over batches and restarts. Rows of a batch are taken in the order of ts."""
    ship(equity.sparkSession)
    day_limit, fall_limit = -risk.max_daily_loss, -risk.max_drawdown

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, start, peak, reason = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        reasons = []
        for at, now in zip(rows["ts"], rows["equity"], strict=True):
            if day != f"{at:%Y-%m-%d}":
                day, start = f"{at:%Y-%m-%d}", now
            peak = now if peak is None else max(peak, now)
            if peak and now / peak - 1 <= fall_limit:
                reason = "max drawdown hit"
            elif start and now / start - 1 <= day_limit:
                reason = "daily loss limit hit"
            reasons.append(reason)
        state.update((day, start, peak, reason))
        yield pd.DataFrame({"book": key[0], "ts": rows["ts"].to_numpy(), "equity": rows["equity"].to_numpy(), "reason": reasons})

    return equity.groupBy("book").applyInPandasWithState(
        update, "book string, ts timestamp, equity double, reason string", "day string, start double, peak double, reason string", "append", GroupStateTimeout.NoTimeout
    )


def turnover_buffer_stream(targets: DataFrame, buffer: float = 0.1, min_band: float = 0.01) -> DataFrame:
    """(symbol, ts, weight, held) of a stream (symbol, ts, weight): the no-trade band, with what is held kept as state."""
    ship(targets.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        path = []
        for x in rows["weight"]:
            if abs(x - held) > buffer * max(abs(x), abs(held), min_band):
                held = x
            path.append(held)
        state.update((float(held),))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "weight": rows["weight"].to_numpy(), "held": path})

    return targets.groupBy("symbol").applyInPandasWithState(update, "symbol string, ts timestamp, weight double, held double", "held double", "append", GroupStateTimeout.NoTimeout)


class Broker(Protocol):
    """What a decision cycle asks of an exchange."""

    def bars(self, symbols: list[str], timeframe: str, limit: int) -> DataFrame: ...

    def mark_price(self, symbol: str) -> float: ...

    def funding_rate(self, symbol: str) -> float: ...

    def equity(self) -> float: ...

    def positions(self) -> dict[str, float]: ...

    def market_order(self, symbol: str, quantity: float, reduce_only: bool = False) -> None: ...

    def close_all(self) -> None: ...


@dataclass
class PaperBroker:
    """A broker on the lake's bars: orders fill at the last close, and only here."""

    lake: Lake
    cash: float = 10_000.0
    held: dict[str, float] = field(default_factory=dict)
    orders: list[tuple[str, float, bool]] = field(default_factory=list)

    def bars(self, symbols: list[str], timeframe: str, limit: int) -> DataFrame:
        return tail_rows(self.lake.read("klines", symbols, timeframe), limit)

    def mark_price(self, symbol: str) -> float:
        found = last_rows(self.lake.read("klines", symbol).select("symbol", "ts", "close")).first()
        if found is None:
            raise RuntimeError(f"no price of {symbol}")
        return found["close"]

    def funding_rate(self, symbol: str) -> float:
        found = last_rows(self.lake.read("funding", symbol)).first()
        return found["funding_rate"] if found else 0.0

    def equity(self) -> float:
        return self.cash + sum(q * self.mark_price(s) for s, q in self.held.items() if q)

    def positions(self) -> dict[str, float]:
        return {s: q for s, q in self.held.items() if q}

    def market_order(self, symbol: str, quantity: float, reduce_only: bool = False) -> None:
        if reduce_only:  # never through zero
            now = self.held.get(symbol, 0.0)
            quantity = max(-abs(now), min(abs(now), quantity))
        self.cash -= quantity * self.mark_price(symbol)
        self.held[symbol] = self.held.get(symbol, 0.0) + quantity
        self.orders.append((symbol, quantity, reduce_only))

    def close_all(self) -> None:
        for symbol, quantity in self.positions().items():
            self.market_order(symbol, -quantity, True)


class Halted(SystemExit):
    """A risk limit was broken; the switch has to be reset by hand."""


@dataclass
class KillSwitch:
    """The switch of one account between cycles; the stream and the batch operator have the same rules."""

    risk: RiskConfig
    day: str | None = None
    day_start: float | None = None
    peak: float | None = None
    tripped: str | None = None

    def update(self, equity: float, now: datetime) -> str | None:
        day = f"{now.astimezone(UTC) if now.tzinfo else now:%Y-%m-%d}"
        if day != self.day:
            self.day, self.day_start = day, equity
        self.peak = max(equity, self.peak if self.peak is not None else equity)
        for name, base, limit in (("daily loss limit hit", self.day_start, self.risk.max_daily_loss), ("max drawdown hit", self.peak, self.risk.max_drawdown)):
            if base and equity / base - 1 <= -limit:
                self.tripped = f"{name}: {equity / base - 1:.2%}"
        return self.tripped


@dataclass
class LiveRunner:
    """Decides from the newest closed bars: weights by the functions of the backtest, orders where the gap is worth it."""

    spark: SparkSession
    broker: Broker
    signal: Callable[[DataFrame], DataFrame]
    symbols: list[str]
    state_dir: str
    timeframe: str = "1h"
    risk: RiskConfig = RiskConfig()
    band: float = 0.1
    context: int = 1500
    staleness: timedelta = timedelta(minutes=15)
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)

    def __post_init__(self) -> None:
        Path(self.state_dir).mkdir(parents=True, exist_ok=True)
        self.switch = KillSwitch(self.risk)

    def fresh_bars(self) -> DataFrame:
        """The newest bars, if every symbol has some and none is stale."""
        bars = self.broker.bars(self.symbols, self.timeframe, self.context)
        last = {r["symbol"]: r["ts"] for r in bars.groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}  # of the symbols asked for
        width = pd.Timedelta(self.timeframe).to_pytimedelta()
        now = self.clock().astimezone(UTC).replace(tzinfo=None)
        for symbol in self.symbols:
            if symbol not in last:
                raise RuntimeError(f"no bars of {symbol}")
            if now - last[symbol] > width + self.staleness:
                raise RuntimeError(f"stale bars of {symbol}: the last one is of {last[symbol]}")
        return bars

    def save(self, state: dict) -> dict:
        state = state | {"ts": self.clock().isoformat()}
        write_state(json.dumps(state, indent=2, default=str), f"{self.state_dir}/live_state.json")
        return state

    def step(self) -> dict:
        """One cycle: its record, once orders are out. A broken limit closes all positions and stops."""
        weights = last_rows(self.signal(self.fresh_bars()).select("symbol", "ts", "weight")).select("symbol", "weight")
        equity = self.broker.equity()
        breach = self.switch.update(equity, self.clock())
        if breach:
            log.error("%s: closing all positions", breach)
            self.broker.close_all()
            self.save({"halted": True, "reason": breach, "equity": equity})
            raise Halted(1)
        prices, held = {s: self.broker.mark_price(s) for s in self.symbols}, self.broker.positions()
        table = {r["symbol"]: r["weight"] for r in weights.collect()}  # a row for each symbol asked for
        frame = lambda d, name: self.spark.createDataFrame([(k, float(v)) for k, v in d.items()], f"symbol string, {name} double")
        orders = rebalance_orders(frame(table, "weight"), frame(held, "qty"), frame(prices, "price"), equity, self.band).orderBy("symbol").collect()
        for order in orders:
            self.broker.market_order(order["symbol"], order["delta"], order["reduce_only"])
        targets = {s: table.get(s, 0.0) * equity / prices[s] for s in self.symbols if prices.get(s)}
        return self.save({"equity": equity, "weights": table, "target_qty": targets, "current_qty": held, "actions": [o.asDict() for o in orders]})

    def run(self, poll_seconds: float = 60, cycles: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
        """Cycles until stopped (or so many): a failed one is logged and skipped, a broken limit ends the loop."""
        done: list[dict] = []
        while cycles is None or cycles > 0:
            try:
                done = [*done[-9:], self.step()]
            except Halted:
                raise
            except Exception as e:  # the network, the exchange, stale data: the next cycle tries again
                log.warning("cycle skipped: %s", e)
            cycles = None if cycles is None else cycles - 1
            if cycles != 0:
                sleep(poll_seconds)
        return done
