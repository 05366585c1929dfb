"""Synthetic markets: volatility clusters, an optional slow drift (a real edge to find), one common factor, funding.

Every symbol is generated in its own task from its own seed, so the result does not depend on the cluster."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import lag, log, so_far
from tidebar.session import ship

BARS_PER_YEAR = {"1h": 8760, "4h": 2190, "1d": 365, "15m": 35040}
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double"


def _path(symbol: str, seed: int, n: int, start: str, freq: str, ann_vol: float, drift: float, trend: float, halflife: int, cluster: float, first: float) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    step = 1 / BARS_PER_YEAR[freq]
    level = ann_vol * np.sqrt(step)
    shocks = rng.standard_normal(n)
    variance = np.empty(n)
    now = level**2
    for t in range(n):  # today's variance feeds on yesterday's and on its shock
        variance[t] = now
        now = 0.02 * level**2 + now * (cluster + (0.98 - cluster) * shocks[t] ** 2)
    vol = np.sqrt(variance)
    ret = drift * step + vol * shocks
    if trend:
        keep = 0.5 ** (1 / max(halflife, 1))
        pushes = rng.standard_normal(n) * level * trend * np.sqrt(1 - keep**2)
        ret = ret + pd.Series(pushes / (1 - keep)).ewm(alpha=1 - keep, adjust=False).mean().to_numpy() + keep ** np.arange(n) * pushes[:1] * (1 - 1 / (1 - keep))
    close = first * np.exp(np.cumsum(ret))
    open_ = np.append(first, close[:-1])
    wick = 0.5 * np.abs(rng.standard_normal(n)) * vol * close
    volume = np.exp(6 + 0.5 * rng.standard_normal(n)) * (1 + 10 * np.abs(ret))
    return pd.DataFrame(
        {
            "symbol": symbol, "ts": pd.date_range(start, periods=n, freq={"15m": "15min"}.get(freq, freq)), "open": open_, "high": np.maximum(open_, close) + wick,
            "low": np.minimum(open_, close) - wick, "close": close, "volume": volume, "quote_volume": volume * close, "trades": (volume * 3).astype(int),
            "taker_buy_base": volume * np.clip(0.5 + 0.1 * rng.standard_normal(n), 0.05, 0.95),
        }
    )


def synthetic_bars(
    spark: SparkSession, symbols: dict[str, int], n: int = 20_000, start: str = "2021-01-01", freq: str = "1h", ann_vol: float = 0.8, drift: float = 0.3,
    trend_strength: float = 0.0, momentum_halflife: int = 336, vol_cluster: float = 0.9, s0: float = 30_000.0,
) -> DataFrame:
    """n bars of each symbol (name: seed). Without trend_strength there is nothing to predict."""
    ship(spark)

    def made(batches):
        for rows in batches:
            for symbol, seed in zip(rows["symbol"], rows["seed"], strict=True):
                yield _path(symbol, seed, n, start, freq, ann_vol, drift, trend_strength, momentum_halflife, vol_cluster, s0)

    return spark.createDataFrame(list(symbols.items()), "symbol string, seed long").repartition(len(symbols), "symbol").mapInPandas(made, BARS)


def synthetic_funding(bars: DataFrame, mean_bps_8h: float = 1.0, every: int = 8) -> DataFrame:
    """(symbol, ts, funding_rate) at each symbol's every eighth bar: mean-reverting around a small cost; the seed is the
    symbol's crc32."""
    ship(bars.sparkSession)

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        at = rows["ts"].to_numpy()[::every] if len(rows) > every else rows["ts"].to_numpy()
        symbol = rows["symbol"].iloc[0]
        rng = np.random.default_rng(zlib.crc32(symbol.encode()) % 1000)
        x = np.zeros(len(at))
        for t in range(1, len(at)):
            x[t] = 0.95 * x[t - 1] + 0.5 * rng.standard_normal()
        return pd.DataFrame({"symbol": symbol, "ts": at, "funding_rate": (mean_bps_8h + 2 * x) / 1e4})

    return bars.select("symbol", "ts").groupBy("symbol").applyInPandas(made, "symbol string, ts timestamp_ntz, funding_rate double")


def synthetic_universe(spark: SparkSession, symbols: tuple[str, ...] = ("A", "B", "C", "D"), n: int = 20_000, seed: int = 0, beta: float = 0.7, **how) -> DataFrame:
    """Bars whose returns share a market factor: beta of the market's and sqrt(1 - beta**2) of their own."""
    market = synthetic_bars(spark, {"market": seed}, n, **how)
    own = synthetic_bars(spark, {s: seed + 100 + i for i, s in enumerate(symbols)}, n, **how)

    def moves(bars: DataFrame) -> DataFrame:
        return bars.withColumn("_move", F.coalesce(log(F.col("close")) - lag(log(F.col("close"))), F.lit(0.0)))

    both = moves(own).join(moves(market).select("ts", F.col("_move").alias("_market")), "ts")
    blended = F.sum(beta * F.col("_market") + max(1 - beta**2, 0.0) ** 0.5 * F.col("_move")).over(so_far())
    both = both.withColumn("_scale", F.first("close").over(so_far()) * F.exp(blended) / F.col("close"))
    return both.select(*[(F.col(c) * F.col("_scale")).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in own.columns])


def synthetic_dataset(spark: SparkSession, symbols: tuple[str, ...] = ("A", "B", "C", "D"), n: int = 17_000, seed: int = 7, trend_strength: float = 0.0, bars_per_funding: int = 8, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, bars, funding by bar): what evaluation takes. The eight-hourly rate is spread over its bars."""
    from tidebar.operators.features import build_features

    bars = synthetic_universe(spark, symbols, n, seed, trend_strength=trend_strength, **how)
    features = build_features(bars, synthetic_funding(bars))
    return features, bars, funding_by_bar(features, bars_per_funding)


def funding_by_bar(features: DataFrame, bars_per_funding: int = 8) -> DataFrame:
    """(symbol, ts, funding_rate): the standing rate's share of each bar."""
    return features.select("symbol", "ts", (F.coalesce("funding", F.lit(0.0)) / max(bars_per_funding, 1)).alias("funding_rate"))


