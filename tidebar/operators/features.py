"""The feature matrix: every feature is a causal expression over a symbol's own rows. Expressions that share the window
(symbol, ts) share one shuffle and one sort; those that build on others come in a later layer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import finite, frame, kurtosis, lag, log, pct_rank, ratio, roll, root, skewness, zscore
from tidebar.operators.joins import asof
from tidebar.operators.kernels import ewm, frac_diff

MOMENTUM = (4, 12, 24, 72, 168, 336, 720)
VOLATILITY = (24, 72, 168)
TREND = (24, 72, 168, 336, 720)
RANGES = (24, 168, 720)
HURST_LAGS = (2, 4, 8, 16, 32)


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds ret_1, the log return of the close, and what other features need of the row before."""
    before = lag("close")
    return bars.withColumns(
        {
            "ret_1": log(F.col("close")) - lag(log(F.col("close"))),
            "_overnight": log(ratio(F.col("open"), before)),
            "_whole": log(ratio(F.col("close"), before)),
            "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        }
    )


def momentum(k: int) -> Column:
    return log(ratio(F.col("close"), lag("close", k)))


def realised_vol(x: Column, k: int = 72) -> Column:
    return roll(F.stddev_samp, x, k, k // 2)


def garman_klass(k: int = 24) -> Column:
    hl, co = log(ratio(F.col("high"), F.col("low"))), log(ratio(F.col("close"), F.col("open")))
    daily = roll(F.avg, 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, k, k // 2)
    return F.when(daily.isNotNull(), root(F.greatest(F.lit(0.0), daily)))


def yang_zhang(k: int = 24) -> Column:
    """Needs with_returns; the window has to be full."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    share = 0.34 / (1.34 + (k + 1) / (k - 1))
    inside = log(ratio(h, c)) * log(ratio(h, o)) + log(ratio(low, c)) * log(ratio(low, o))
    total = roll(F.var_samp, F.col("_overnight"), k) + share * roll(F.var_samp, F.col("_whole"), k) + (1 - share) * roll(F.avg, inside, k)
    return F.when(total.isNotNull(), root(F.greatest(F.lit(0.0), total)))


def range_position(k: int) -> Column:
    low, high = roll(F.min, F.col("low"), k, k // 2), roll(F.max, F.col("high"), k, k // 2)
    return ratio(F.col("close") - low, high - low) - 0.5


def autocorrelation(x: str, before: str, k: int = 168) -> Column:
    """Lag-1 correlation within the last k rows: of its k - 1 inner pairs, where half the window has values."""
    return F.when(F.count(x).over(frame(k)) >= k // 2, finite(F.corr(x, before).over(frame(k - 1))))


def hurst(bars: DataFrame, column: str = "log_close", window: int = 200, lags: tuple[int, ...] = HURST_LAGS) -> DataFrame:
    """Adds hurst: twice the slope of ln sqrt(population deviation of the differences at a lag) on ln lag."""
    out = bars.withColumns({f"_d{k}": F.col(column) - lag(column, k) for k in lags})
    full = F.count(column).over(frame(window)) >= window
    tau = {k: F.sqrt(F.stddev_pop(f"_d{k}").over(frame(window - k))) for k in lags}
    out = out.withColumns({f"_t{k}": F.when(full & (t > 0), F.ln(t)) for k, t in tau.items()})
    n, xs = len(lags), [math.log(k) for k in lags]
    mean_x = sum(xs) / n
    mean_y = sum((F.col(f"_t{k}") for k in lags), F.lit(0.0)) / n
    slope = sum(((x - mean_x) * (F.col(f"_t{k}") - mean_y) for x, k in zip(xs, lags, strict=True)), F.lit(0.0)) / sum((x - mean_x) ** 2 for x in xs)
    return out.withColumn("hurst", 2.0 * slope).drop(*[f"_{p}{k}" for k in lags for p in "dt"])


def rsi(column: str = "close", window: int = 14) -> tuple[dict[str, Column], dict[str, dict], Column]:
    """The inputs, the weighted means they need, and the index itself (0 to 100; null without a loss)."""
    change = F.col(column) - lag(column)
    inputs = {"_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
    how = {"stat": "mean", "alpha": 1 / window, "min_periods": window}
    specs = {"_avg_gain": {"column": "_gain", **how}, "_avg_loss": {"column": "_loss", **how}}
    return inputs, specs, 100 - ratio(F.lit(100.0), 1 + ratio(F.col("_avg_gain"), F.col("_avg_loss")))


def ewm_features(bars: DataFrame) -> DataFrame:
    """Adds rsi_14 (-0.5 to 0.5), atr and atr_pct: one pass of the kernel for all weighted means."""
    inputs, specs, index = rsi()
    out = bars.withColumns(inputs)
    specs["atr"] = {"column": "true_range", "stat": "mean", "alpha": 1 / 14, "min_periods": 14}
    out = ewm(out, specs)
    return out.withColumns({"rsi_14": index / 100 - 0.5, "atr_pct": ratio(F.col("atr"), F.col("close"))}).drop("_gain", "_loss", "_avg_gain", "_avg_loss")


def price_features(bars: DataFrame, kernels: bool = True, d_threshold: float = 1e-5) -> DataFrame:
    """bars with all features that need nothing but bars; optional columns give their features only where they exist."""
    out = with_returns(bars)
    if kernels:
        out = frac_diff(ewm_features(out.withColumn("log_close", log(F.col("close")))), "log_close", "fd_logp", 0.4, d_threshold)
    has = set(bars.columns)
    c, h, low, ret = (F.col(x) for x in ("close", "high", "low", "ret_1"))
    first: dict[str, Column] = {f"mom_{k}": momentum(k) for k in MOMENTUM}
    first |= {f"vol_{k}": realised_vol(ret, k) for k in VOLATILITY}
    first |= {"gk_vol": garman_klass(), "yz_vol": yang_zhang(), "hl_range": ratio(h - low, c), "close_loc": ratio(c - low, h - low) - 0.5}
    first |= {f"pos_range_{k}": range_position(k) for k in RANGES}
    first |= {"ret_skew_168": skewness(ret, 168, 84), "ret_kurt_168": kurtosis(ret, 168, 84), "_ret_before": lag("ret_1")}
    if {"taker_buy_base", "volume"} <= has:
        first["taker_imb"] = ratio(F.col("taker_buy_base"), F.col("volume")) - 0.5
    if "trades" in has:
        first["trade_intensity"] = zscore(F.ln(1 + F.col("trades").cast("double")), 168)
    if "quote_volume" in has:
        first["dollar_vol_z"] = zscore(log(1 + F.col("quote_volume")), 168)
        first["_impact"] = roll(F.avg, ratio(F.abs(ret), F.col("quote_volume")), 24)
    second: dict[str, Column] = {f"tsmom_{k}": ratio(F.col(f"mom_{k}"), F.col("vol_168") * math.sqrt(k)) for k in TREND}
    second |= {"vol_of_vol": realised_vol(F.col("vol_24"), 168), "vol_ratio": ratio(F.col("vol_24"), F.col("vol_168")), "ac1_168": autocorrelation("ret_1", "_ret_before")}
    if kernels:
        second["fd_logp_z"] = zscore(F.col("fd_logp"), 336)
    if "taker_imb" in first:
        second["taker_imb_z"] = zscore(F.col("taker_imb"), 168)
    if "_impact" in first:
        second["amihud"] = zscore(F.col("_impact"), 336)
    return out.withColumns(first).withColumns(second).drop("_overnight", "_whole", "_ret_before", "_impact")


def funding_features(df: DataFrame, funding: DataFrame) -> DataFrame:
    """Adds the as-of funding rate and its features. The cumulated ones sum the rate of each bar, as it stands."""
    out = asof(df, funding, ["funding_rate"]).withColumnRenamed("funding_rate", "funding")
    x = F.col("funding")
    return out.withColumns(
        {
            "funding_z_168": zscore(x, 168),
            "funding_cum_24": roll(F.sum, x, 24),
            "funding_cum_168": roll(F.sum, x, 168),
            "funding_sign_persist": roll(F.avg, F.signum(x), 72),
        }
    )


def metrics_features(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds the features of open interest and of the two ratios, each where its column exists."""
    named = {"sum_open_interest": "_oi", "sum_toptrader_long_short_ratio": "ls_ratio", "sum_taker_long_short_vol_ratio": "taker_ls"}
    there = [c for c in named if c in metrics.columns]
    out = asof(df, metrics, there)
    for c in there:
        out = out.withColumn(named[c], log(F.col(c)))
    new: dict[str, Column] = {}
    if "sum_open_interest" in there:
        new |= {"oi_chg_24": F.col("_oi") - lag("_oi", 24), "oi_z_168": zscore(F.col("_oi"), 168)}
    for c in ("ls_ratio", "taker_ls"):
        if c in out.columns:
            new[f"{c}_z"] = zscore(F.col(c), 168)
    return out.withColumns(new).drop("_oi", *there)


def build_features(bars: DataFrame, funding: DataFrame | None = None, metrics: DataFrame | None = None, extra: dict[str, DataFrame] | None = None, kernels: bool = True) -> DataFrame:
    """The whole matrix: (symbol, ts, features, close). extra series (ts, name) are joined as of each ts."""
    out = price_features(bars, kernels)
    if funding is not None:
        out = funding_features(out, funding)
    if metrics is not None:
        out = metrics_features(out, metrics)
    for name, series in (extra or {}).items():
        symbols = F.broadcast(bars.select("symbol").distinct())
        out = asof(out, series.select("ts", name).crossJoin(symbols), [name])
    gone = {"open", "high", "low", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "true_range", "log_close", "atr"}
    names = [c for c in out.columns if c not in gone | {"symbol", "ts", "close"}]
    return out.select("symbol", "ts", *[finite(F.col(c).cast("double")).alias(c) for c in names], "close")


def cross_sectional(df: DataFrame, column: str, out: str = "cs") -> DataFrame:
    """Percent rank within each ts, centred."""
    return df.withColumn(out, pct_rank(F.col(column), "ts") - 0.5)


def min_ffd(d_grid: tuple[float, ...] = tuple(i / 10 for i in range(11)), p_value=None) -> float:
    """The smallest d that makes the series stationary by the test p_value(d) < 0.05; 0.4 where no test is at hand,
    1.0 where none passes."""
    if p_value is None:
        return 0.4
    return next((d for d in d_grid if p_value(d) < 0.05), 1.0)
