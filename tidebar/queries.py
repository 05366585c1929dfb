"""The engine's own queries over the driver's tables, each with the DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import pct_rank, r6, stamp
from tidebar.operators.backtest import Costs, buy_and_hold, run_backtest
from tidebar.operators.features import price_features, realised_vol, with_returns
from tidebar.operators.joins import asof, calendar, panel
from tidebar.operators.labels import concurrency, triple_barrier, vertical_barriers
from tidebar.operators.metrics import drawdown, monthly, performance
from tidebar.operators.signals import ma_crossover, mean_reversion
from tidebar.sources.bars import bars_daily, bars_hourly, hourly_funding, open_interest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DAILY = """t AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_extendedprice / nullif(l_quantity, 0) AS price, * FROM lineitem),
bars AS (SELECT symbol, ts, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
 last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_volume,
 count(*) AS trades, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS taker_buy_base FROM t GROUP BY 1, 2)"""
_HOURLY = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY e.ts, event_id) AS close, count(*)::DOUBLE AS volume, sum(value) AS quote_volume, count(*) AS trades FROM events e GROUP BY 1, 2)"""
_W = "PARTITION BY symbol ORDER BY ts"
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _r(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _roll(agg: str, x: str, k: int, at_least: int) -> str:
    w = f"OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {at_least} THEN {agg}({x}) {w} END"


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def _shown(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return df.select(*[stamp().alias("ts") if k == "ts" else k for k in keys], *[r6(c).alias(c) for c in columns])


_BARS = ("open", "high", "low", "close", "volume", "quote_volume")
_SHOW_BARS = f"SELECT symbol, {_TS}, {', '.join(f'{_r(c)} AS {c}' for c in _BARS)} FROM bars"


@_query("bars_daily", f"WITH {_DAILY} {_SHOW_BARS}")
def _bars_daily(spark, sf_dir):
    return _shown(bars_daily(spark, sf_dir), *_BARS)


@_query("bars_hourly", f"WITH {_HOURLY} {_SHOW_BARS}")
def _bars_hourly(spark, sf_dir):
    return _shown(bars_hourly(spark, sf_dir), *_BARS)


def _feature_query(name: str, columns: dict[str, str], layers: str = "") -> None:
    """columns: feature name to its SQL over f, bars with ret and what `layers` adds."""
    base = f"WITH {_DAILY}, f AS (SELECT *, ln(close) - lag(ln(close)) OVER ({_W}) AS ret FROM bars){layers}"
    last = "g" if layers else "f"
    ORACLES[name] = f"{base} SELECT symbol, {_TS}, {', '.join(f'{_r(x)} AS {c}' for c, x in columns.items())} FROM {last}"
    QUERIES[name] = lambda spark, sf_dir: _shown(price_features(bars_daily(spark, sf_dir), kernels=False), *columns)


def _mom(k: int) -> str:
    return f"ln(close / lag(close, {k}) OVER ({_W}))"


_feature_query("momentum_features", {f"mom_{k}": _mom(k) for k in (4, 12, 24, 72, 168, 336, 720)})
_feature_query("realised_vol", {f"vol_{k}": _roll("stddev_samp", "ret", k, k // 2) for k in (24, 72, 168)})
_feature_query(
    "tsmom_features",
    {f"tsmom_{k}": f"mom_{k} / nullif(vol_168 * sqrt({k}), 0)" for k in (24, 72, 168, 336, 720)},
    f", g AS (SELECT *, {', '.join(f'{_mom(k)} AS mom_{k}' for k in (24, 72, 168, 336, 720))}, {_roll('stddev_samp', 'ret', 168, 84)} AS vol_168 FROM f)",
)
_feature_query("rolling_moments", {"ret_skew_168": _roll("skewness", "ret", 168, 84), "ret_kurt_168": _roll("kurtosis", "ret", 168, 84)})
_feature_query(
    "garman_klass",
    {"gk_vol": f"sqrt(CASE WHEN {_roll('avg', 'x', 24, 12)} < 0 THEN 0 ELSE {_roll('avg', 'x', 24, 12)} END)"},
    ", g AS (SELECT *, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS x FROM f)",
)
_feature_query(
    "range_position",
    {f"pos_range_{k}": f"(close - ({_roll('min', 'low', k, k // 2)})) / nullif(({_roll('max', 'high', k, k // 2)}) - ({_roll('min', 'low', k, k // 2)}), 0) - 0.5" for k in (24, 168, 720)},
)
_feature_query("bar_shape", {"hl_range": "(high - low) / close", "close_loc": "(close - low) / nullif(high - low, 0) - 0.5", "taker_imb": "taker_buy_base / volume - 0.5"})
_feature_query(
    "zscore_features",
    {f"{c}": f"({x} - ({_roll('avg', x, 168, 84)})) / nullif({_roll('stddev_samp', x, 168, 84)}, 0)" for c, x in (("trade_intensity", "lt"), ("dollar_vol_z", "lq"))},
    ", g AS (SELECT *, ln(1 + trades) AS lt, ln(1 + quote_volume) AS lq FROM f)",
)


@_query("cross_sectional_rank", f"""WITH {_DAILY}, m AS (SELECT symbol, ts, {_mom(24)} AS mom FROM bars),
 r AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY mom NULLS LAST) AS k, count(*) OVER (PARTITION BY ts, mom) AS tied, count(mom) OVER (PARTITION BY ts) AS n FROM m)
 SELECT symbol, {_TS}, {_r("CASE WHEN mom IS NOT NULL THEN (k + (tied - 1) / 2) / n - 0.5 END")} AS cs FROM r""")
def _cross_sectional_rank(spark, sf_dir):
    features = price_features(bars_daily(spark, sf_dir), kernels=False)
    return _shown(features.withColumn("cs", pct_rank(F.col("mom_24"), "ts") - 0.5), "cs")


@_query("calendar_densify", f"WITH {_HOURLY} SELECT c.symbol, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS ts, {_r('coalesce(b.close, 0)')} AS close FROM (SELECT * FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)) c LEFT JOIN bars b USING (symbol, ts)")
def _calendar_densify(spark, sf_dir):
    bars = bars_hourly(spark, sf_dir)
    return _shown(calendar(bars).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left").na.fill(0.0), "close")


@_query("lake_panel_pivot", f"WITH {_DAILY} SELECT {_TS}, {', '.join(f'''{_r(f"max(close) FILTER (symbol = '{s}')")} AS {s}''' for s in 'ANR')} FROM bars GROUP BY bars.ts")
def _lake_panel_pivot(spark, sf_dir):
    return _shown(panel(bars_daily(spark, sf_dir), "close", ["A", "N", "R"]), "A", "N", "R", keys=("ts",))


@_query("funding_asof", f"""WITH {_HOURLY}, f AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, (avg(value) - 100) / 1e6 AS rate FROM events WHERE hour(ts) IN (0, 8, 16) GROUP BY 1, 2)
 SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, {_r('f.rate * 1e6')} AS rate FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts""")
def _funding_asof(spark, sf_dir):
    out = asof(bars_hourly(spark, sf_dir), hourly_funding(spark, sf_dir), ["funding_rate"])
    return _shown(out.withColumn("rate", F.col("funding_rate") * 1e6), "rate")


@_query("open_interest_asof", f"""WITH {_DAILY}, o AS (SELECT symbol, ts, volume AS oi FROM bars QUALIFY row_number() OVER ({_W}) % 5 = 0)
 SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, {_r('o.oi')} AS oi FROM bars b ASOF LEFT JOIN o ON b.symbol = o.symbol AND b.ts >= o.ts""")
def _open_interest_asof(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return _shown(asof(bars, open_interest(bars), ["sum_open_interest"]).withColumnRenamed("sum_open_interest", "oi"), "oi")


_MA = f"CASE WHEN {_roll('avg', 'close', 20, 20).replace('CASE', 'CASE', 1)} > {_roll('avg', 'close', 100, 100)} THEN 1.0 ELSE 0.0 END"


@_query("ma_crossover", f"WITH {_DAILY} SELECT symbol, {_TS}, {_r(_MA)} AS signal FROM bars")
def _ma_crossover(spark, sf_dir):
    return _shown(ma_crossover(bars_daily(spark, sf_dir)), "signal")


@_query("mean_reversion", f"""WITH {_DAILY}, f AS (SELECT symbol, ts, ln(close / lag(close) OVER ({_W})) AS ret, {_mom(48)} AS move FROM bars)
 SELECT symbol, {_TS}, {_r(f"coalesce(-tanh(move / nullif({_roll('stddev_samp', 'ret', 720, 360)}, 0)), 0)")} AS signal FROM f""")
def _mean_reversion(spark, sf_dir):
    return _shown(mean_reversion(bars_daily(spark, sf_dir)), "signal")


def _book_sql(weight: str) -> str:
    """b: the backtest of weights given as SQL over bars, as (ts, gross, turnover, cost, ret)."""
    return f"""WITH {_DAILY}, wt AS (SELECT symbol, ts, {weight} AS weight FROM bars),
 c AS (SELECT * FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)),
 d AS (SELECT c.symbol, c.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.ts) AS price, coalesce(lag(coalesce(wt.weight, 0)) OVER (PARTITION BY c.symbol ORDER BY c.ts), 0) AS pos
  FROM c LEFT JOIN bars b ON b.symbol = c.symbol AND b.ts = c.ts LEFT JOIN wt ON wt.symbol = c.symbol AND wt.ts = c.ts),
 e AS (SELECT ts, pos, coalesce(lag(pos) OVER ({_W}), 0) AS held, coalesce(price / lag(price) OVER ({_W}) - 1, 0) AS move FROM d),
 g AS (SELECT ts, sum(held * move) AS gross, sum(abs(pos - held)) AS turnover FROM e GROUP BY ts),
 b AS (SELECT *, turnover * {Costs().per_turnover!r} AS cost, gross - turnover * {Costs().per_turnover!r} AS ret FROM g)"""


def _ma_book(spark, sf_dir) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    return run_backtest(bars, ma_crossover(bars).withColumn("weight", F.col("signal") / 100))


_MA_BOOK = _book_sql(f"({_MA}) / 100")
_DRAWN = ", e2 AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY ts)) AS equity FROM b), dd AS (SELECT *, equity / max(equity) OVER (ORDER BY ts) - 1 AS drawdown FROM e2)"


@_query("backtest", f"{_MA_BOOK} SELECT {_TS}, {', '.join(f'{_r(c)} AS {c}' for c in ('gross', 'turnover', 'cost', 'ret'))} FROM b")
def _backtest(spark, sf_dir):
    return _shown(_ma_book(spark, sf_dir), "gross", "turnover", "cost", "ret", keys=("ts",))


@_query("drawdown", f"{_MA_BOOK}{_DRAWN} SELECT {_TS}, {_r('ln(equity)')} AS log_equity, {_r('drawdown')} AS drawdown FROM dd")
def _drawdown(spark, sf_dir):
    return _shown(drawdown(_ma_book(spark, sf_dir)).withColumn("log_equity", F.ln("equity")), "log_equity", "drawdown", keys=("ts",))


_STATS = {
    "ann_vol": "stddev_samp(ret) * sqrt(365)",
    "sharpe": "avg(ret) / stddev_samp(ret) * sqrt(365)",
    "max_drawdown": "min(drawdown)",
    "hit_rate": "avg((ret > 0)::INT)",
    "profit_factor": "sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0))",
    "skew": "skewness(ret)",
    "kurtosis": "kurtosis(ret)",
    "tail_ratio": "quantile_cont(ret, 0.95) / abs(nullif(quantile_cont(ret, 0.05), 0))",
    "worst_bar": "min(ret)",
    "n_bars": "count(*)",
}


@_query("performance_summary", f"{_MA_BOOK}{_DRAWN} SELECT {', '.join(f'{_r(x)} AS {c}' for c, x in _STATS.items())} FROM dd")
def _performance_summary(spark, sf_dir):
    return _shown(performance(_ma_book(spark, sf_dir), 365.0), *_STATS, keys=())


@_query("monthly_returns", f"{_MA_BOOK} SELECT year(ts)::INT AS year, month(ts)::INT AS month, {_r('product(1 + ret) - 1')} AS ret FROM b GROUP BY 1, 2")
def _monthly_returns(spark, sf_dir):
    return _shown(monthly(_ma_book(spark, sf_dir)), "ret", keys=("year", "month"))


@_query("buy_and_hold", f"{_book_sql('1.0 / (SELECT count(DISTINCT symbol) FROM bars)').replace('coalesce(wt.weight, 0)', '1.0 / (SELECT count(DISTINCT symbol) FROM bars)')} SELECT {_TS}, {_r('turnover')} AS turnover, {_r('ret')} AS ret FROM b")
def _buy_and_hold(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return _shown(run_backtest(bars, buy_and_hold(bars)), "turnover", "ret", keys=("ts",))


@_query("vertical_barriers", f"WITH {_DAILY} SELECT symbol, {_TS}, strftime(coalesce(lead(ts, 24) OVER ({_W}), max(ts) OVER (PARTITION BY symbol)), '%Y-%m-%d %H:%M:%S') AS t1 FROM bars")
def _vertical_barriers(spark, sf_dir):
    return vertical_barriers(bars_daily(spark, sf_dir), 24).select("symbol", stamp().alias("ts"), stamp("t1").alias("t1"))


def labelled_bars(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Bars, and their labels: every bar is an event, and its target is the realised volatility."""
    bars = bars_daily(spark, sf_dir)
    events = with_returns(bars)
    events = events.withColumns({"_target": realised_vol(F.col("ret_1"), 24), "_event": F.lit(True)})
    return bars, triple_barrier(events, "_event", "_target")


def labels_sql(target: str, low: float = 0.001, side: str = "1") -> str:
    """labels: (symbol, ts, t1, ret, trgt, side) of every bar, with a target and a side given as SQL over f."""
    return f"""WITH {_DAILY}, f AS (SELECT *, ln(close) - lag(ln(close)) OVER ({_W}) AS ret_1, row_number() OVER ({_W}) AS n FROM bars),
 g AS (SELECT *, {target} AS own, {side} AS side FROM f), p AS (SELECT *, last_value(own IGNORE NULLS) OVER ({_W}) AS trgt FROM g),
 q AS (SELECT a.symbol, a.ts, b.ts AS t1, b.n AS n, a.trgt, coalesce(a.side, 0) AS side, (b.close / a.close - 1) * coalesce(a.side, 0) AS ret FROM p a JOIN p b ON a.symbol = b.symbol AND b.n BETWEEN a.n + 1 AND a.n + 24 WHERE a.trgt > {low}),
 l AS (SELECT symbol, ts, coalesce(min(n) FILTER (ret > 2 * trgt OR ret < -trgt), max(n)) AS n FROM q GROUP BY 1, 2),
 labels AS (SELECT q.symbol, q.ts, q.t1, q.ret, q.trgt, q.side FROM q JOIN l ON q.symbol = l.symbol AND q.ts = l.ts AND q.n = l.n)"""


LABELS = labels_sql(_roll("stddev_samp", "ret_1", 24, 12))


@_query("triple_barrier", f"{LABELS} SELECT symbol, {_TS}, strftime(t1, '%Y-%m-%d %H:%M:%S') AS t1, {_r('ret')} AS ret, sign(ret)::INT AS bin FROM labels")
def _triple_barrier(spark, sf_dir):
    return labelled_bars(spark, sf_dir)[1].select("symbol", stamp().alias("ts"), stamp("t1").alias("t1"), r6("ret").alias("ret"), "bin")


@_query("concurrency", f"{LABELS} SELECT bars.symbol, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') AS ts, count(l2.ts) AS concurrent FROM bars LEFT JOIN labels l2 ON l2.symbol = bars.symbol AND bars.ts BETWEEN l2.ts AND l2.t1 GROUP BY bars.symbol, bars.ts")
def _concurrency(spark, sf_dir):
    return concurrency(*labelled_bars(spark, sf_dir)).select("symbol", stamp().alias("ts"), "concurrent")
