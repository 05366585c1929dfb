"""Signals: (symbol, ts, signal) from bars or features. They never shift; the backtest owns the lag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Protocol, Self

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import clip, lag, log, mean_of, pct_rank, ratio, roll
from tidebar.operators.kernels import ewm


class Strategy(Protocol):
    """What evaluation asks of a strategy: fit may learn from features (and do nothing), signal gives (symbol, ts, signal)."""

    name: str

    def fit(self, features: DataFrame) -> Self: ...

    def signal(self, features: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Rule:
    """A strategy that learns nothing: a function of the features."""

    name: str
    function: Callable[[DataFrame], DataFrame]

    def fit(self, features: DataFrame) -> Self:
        return self

    def signal(self, features: DataFrame) -> DataFrame:
        return self.function(features)


def rule(function: Callable[..., DataFrame], **parameters) -> Rule:
    return Rule(function.__name__, partial(function, **parameters))


TREND_COLUMNS = ("tsmom_72", "tsmom_168", "tsmom_336", "tsmom_720")


def ma_crossover(bars: DataFrame, fast: int = 20, slow: int = 100, allow_short: bool = False) -> DataFrame:
    """1 where the fast mean is above the slow one, 0 (or -1) where it is not, 0 until both windows are full."""
    if fast >= slow:
        raise ValueError("fast must be shorter than slow")
    a, b = roll(F.avg, F.col("close"), fast), roll(F.avg, F.col("close"), slow)
    below = -1.0 if allow_short else 0.0
    return bars.select("symbol", "ts", F.when(a > b, 1.0).when(a < b, below).otherwise(0.0).alias("signal"))


def mean_reversion(bars: DataFrame, lookback: int = 48) -> DataFrame:
    """Against the move of the last bars, in deviations of the one-bar return."""
    out = bars.withColumns({"_ret": log(ratio(F.col("close"), lag("close"))), "_move": log(ratio(F.col("close"), lag("close", lookback)))})
    score = -F.tanh(ratio(F.col("_move"), roll(F.stddev_samp, F.col("_ret"), 720, 360)))
    return out.select("symbol", "ts", F.coalesce(score, F.lit(0.0)).alias("signal"))


def trend_carry(features: DataFrame, squash: float = 1.5, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Squashed trend, cross-sectional momentum and, where funding_z_168 exists, carry; damped in rising volatility."""
    trend = F.coalesce(F.tanh(mean_of(*[F.col(c) for c in TREND_COLUMNS]) / squash), F.lit(0.0))
    carry = F.coalesce(-F.tanh(F.col("funding_z_168") / 2), F.lit(0.0)) if "funding_z_168" in features.columns else F.lit(0.0)
    gate = F.coalesce(clip(1 / F.greatest(F.col("vol_ratio"), F.lit(0.5)), 0.25, 1.0), F.lit(1.0))
    out = features.withColumn("_cs", 2 * (pct_rank(F.col("mom_168"), "ts") - 0.5))
    cross = F.coalesce(F.col("_cs") - F.avg("_cs").over(Window.partitionBy("ts")), F.lit(0.0))
    signal = clip((weights[0] * trend + weights[1] * cross + weights[2] * carry) * gate, -1.0, 1.0)
    return out.select("symbol", "ts", F.coalesce(signal, F.lit(0.0)).alias("signal"))


def ensemble(members: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of signals, within -1 and 1; equal weights unless given."""
    weights = weights or [1 / len(members)] * len(members)
    if len(weights) != len(members):
        raise ValueError("one weight for each member")
    parts = [m.select("symbol", "ts", (F.col("signal") * w).alias("signal")) for m, w in zip(members, weights, strict=True)]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("symbol", "ts").agg(clip(F.sum("signal"), -1.0, 1.0).alias("signal"))


HORIZONS = ("tsmom_24", "tsmom_72", "tsmom_168", "tsmom_336", "tsmom_720")


def _or_zero(features: DataFrame, column: str):
    """A feature with 0 for null, or 0 where the feature does not exist."""
    return F.coalesce(F.col(column), F.lit(0.0)) if column in features.columns else F.lit(0.0)


def adaptive_raw(features: DataFrame, weights: dict[str, float] | None = None, temperature: float = 1.25) -> DataFrame:
    """(symbol, ts, signal) of the five factors before smoothing: trend and breakout where horizons agree, reversion where
    they do not and returns are not autocorrelated, cross-section and carry always; less in rising volatility and thin
    markets. A null trend or cross-section leaves no signal."""
    weights = {"trend": 0.35, "breakout": 0.20, "reversion": 0.15, "cross": 0.20, "carry": 0.10} | (weights or {})
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("factor weights must not be negative, nor all be zero")
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    horizons = [F.col(c) for c in HORIZONS if c in features.columns]
    trend = F.tanh(mean_of(*horizons) / temperature)
    agreement = F.coalesce(F.abs(mean_of(*[F.signum(h) for h in horizons])), F.lit(0.0))
    regime = clip((agreement - 0.25) / 0.55, 0.0, 1.0)
    quiet = (1 - regime) * (1 - clip(_or_zero(features, "ac1_168"), 0.0, 0.25) / 0.25)
    out = features.withColumn("_cs", 2 * (pct_rank(F.col("mom_168"), "ts") - 0.5))
    out = out.withColumns({"_cross": F.col("_cs") - F.avg("_cs").over(Window.partitionBy("ts"))})
    raw = (
        weights["trend"] * trend * regime
        + weights["breakout"] * F.tanh(_or_zero(features, "pos_range_168") / 0.25) * regime
        + weights["reversion"] * -F.tanh(_or_zero(features, "rsi_14") / 0.20) * quiet
        + weights["cross"] * F.col("_cross")
        + weights["carry"] * -F.tanh(_or_zero(features, "funding_z_168") / 2)
    ) / sum(weights.values())
    calm = F.coalesce(clip(1.5 / F.greatest(F.coalesce("vol_ratio", F.lit(1.0)), F.lit(1.0)), 0.25, 1.0), F.lit(1.0))
    liquid = clip(1 - 0.20 * clip(_or_zero(features, "amihud"), 0.0, 4.0), 0.25, 1.0)
    return out.select("symbol", "ts", F.coalesce(clip(raw * calm * liquid, -1.0, 1.0), F.lit(0.0)).alias("signal"))


def adaptive_multifactor(features: DataFrame, halflife: float = 12.0, **parameters) -> DataFrame:
    """adaptive_raw, smoothed so that it persists."""
    if halflife < 1:
        raise ValueError("halflife must be 1 at least")
    raw = adaptive_raw(features, **parameters).withColumnRenamed("signal", "_raw")
    return ewm(raw, {"signal": {"column": "_raw", "stat": "mean", "halflife": halflife, "adjust": False}}).select("symbol", "ts", "signal")
