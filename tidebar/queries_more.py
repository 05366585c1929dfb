"""More of the engine's queries over the driver's tables: lake, kernels, labels, validation, risk and sweeps, with their SQL.

Where SQL cannot express a query (hashed draws, learned models, generated markets) it has none, and tests hold it against
properties or a plain loop."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import by_symbol, lag, log, r6, ratio, stamp
from tidebar.operators import validation as V
from tidebar.operators.backtest import Costs, buy_and_hold, run_backtest, with_equity
from tidebar.operators.features import ewm_features, hurst, metrics_features, price_features, with_returns
from tidebar.operators.joins import as_of_event, without_overlap
from tidebar.operators.kernels import cusum_events, ewm, frac_diff, frac_diff_weights, turnover_buffer
from tidebar.operators.labels import daily_vol, return_weights, sample_uniqueness, time_decay, triple_barrier
from tidebar.operators.meta import MetaLabel
from tidebar.operators.metrics import information_ratio, monthly_table, performance, rolling_sharpe
from tidebar.operators.risk import RiskConfig, drawdown_throttle, kelly_fraction, kill_switch, last_rows, rebalance_orders, tail_rows, vol_target_weights
from tidebar.operators.signals import adaptive_multifactor, adaptive_raw, ensemble, ma_crossover, mean_reversion, rule, trend_carry
from tidebar.plans.research import evaluate, grid_of, parameter_sweep, top_variants
from tidebar.queries import _BARS, _DAILY, _DRAWN, _HOURLY, _MA, _MA_BOOK, _TS, _W, LABELS, ORACLES, QUERIES, _book_sql, _ma_book, _mom, _query, _r, _roll, _shown, labelled_bars, labels_sql
from tidebar.session import shared_dir
from tidebar.sources.archive import day_range, month_range, to_timestamp
from tidebar.sources.bars import bars_daily, bars_hourly, hourly_funding, open_interest
from tidebar.sources.lake import Lake
from tidebar.sources.synthetic import synthetic_dataset
from tidebar.streaming.live import bar_windows

_ALIKE = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _fresh_lake(spark) -> Lake:
    return Lake(spark, f"{shared_dir(spark)}/tidebar/lake-{uuid.uuid4().hex}")


def _filled_lake(spark, sf_dir) -> Lake:
    lake = _fresh_lake(spark)
    lake.write(bars_daily(spark, sf_dir).select("symbol", F.lit("1d").alias("interval"), "ts", *_BARS), "klines")
    return lake


# Lake


@_query("lake_range_scan", f"WITH {_DAILY} SELECT symbol, {_TS}, {', '.join(f'{_r(c)} AS {c}' for c in _BARS)} FROM bars WHERE symbol IN ('A', 'N') AND ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'")
def _lake_range_scan(spark, sf_dir):
    return _shown(_filled_lake(spark, sf_dir).read("klines", ["A", "N"], "1d", "1994-01-01", "1995-06-30"), *_BARS)


@_query("lake_upsert_dedupe", f"WITH {_DAILY} SELECT symbol, {_TS}, {_r('CASE WHEN ts >= TIMESTAMP $$1995-01-01$$ THEN 2 * close ELSE close END')} AS close FROM bars".replace("$$", "'"))
def _lake_upsert(spark, sf_dir):
    lake, bars = _fresh_lake(spark), bars_daily(spark, sf_dir).select("symbol", F.lit("1d").alias("interval"), "ts", "close")
    lake.write(bars.where("ts < '1997-01-01'"), "klines")
    lake.write(bars.where("ts >= '1995-01-01'").withColumn("close", 2 * F.col("close")), "klines")
    return _shown(lake.read("klines"), "close")


@_query("lake_sql", f"WITH {_DAILY} SELECT symbol, count(*) AS n, {_r('max(close)')} AS highest, {_r('avg(volume)')} AS volume FROM bars GROUP BY symbol")
def _lake_sql(spark, sf_dir):
    found = _filled_lake(spark, sf_dir).sql("SELECT symbol, count(*) AS n, max(close) AS highest, avg(volume) AS volume FROM klines GROUP BY symbol")
    return found.select("symbol", "n", r6("highest").alias("highest"), r6("volume").alias("volume"))


@_query("last_row", f"WITH {_DAILY} SELECT symbol, {_TS}, {_r('close')} AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def _last_row(spark, sf_dir):
    return _shown(last_rows(bars_daily(spark, sf_dir)), "close")


@_query("tail_window", f"WITH {_DAILY} SELECT symbol, {_TS}, {_r('close')} AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 1500")
def _tail_window(spark, sf_dir):
    return _shown(tail_rows(bars_daily(spark, sf_dir), 1500), "close")


# Times and text


@_query("epoch_unit_inference", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _epochs(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))
    unit = F.element_at(F.array(*[F.lit(x) for x in (1, 1_000, 1_000_000, 1_000_000_000)]), F.pmod("event_id", F.lit(4)).cast("int") + 1)
    return t.select("event_id", stamp(to_timestamp((second * unit).cast("string"))).alias("ts"))


@_query("coerce_and_clean", f"SELECT event_type, count(*) AS n, {_r('sum(value)')} AS total FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def _coerce(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = t.withColumn("raw", F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("n/a "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string")))
    clean = text.withColumn("number", F.col("raw").try_cast("double")).na.drop(subset=["number"])
    return clean.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("number")).alias("total"))


_NOW = datetime(2024, 3, 5, 12, tzinfo=UTC)


@_query("month_calendar", "SELECT year(m)::INT AS year, month(m)::INT AS month FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS m)")
def _months(spark, sf_dir):
    return spark.createDataFrame(month_range("2020-01-15", None, _NOW), "year int, month int")


@_query("day_calendar", "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '2024-01-15', DATE '2024-03-04', INTERVAL 1 DAY)) AS d)")
def _days(spark, sf_dir):
    return spark.createDataFrame([(str(d),) for d in day_range("2024-01-15", "2024-12-31", _NOW)], "day string")


# Features


def _ret_features(name: str, columns: dict[str, str], *layers: str) -> None:
    """Like _feature_query, with layers g, h, ... each SELECT over the one before (f)."""
    names, sql = "fghijk", ""
    for i, layer in enumerate(layers):
        sql += f", {names[i + 1]} AS (SELECT *, {layer} FROM {names[i]})"
    base = f"WITH {_DAILY}, f AS (SELECT *, ln(close) - lag(ln(close)) OVER ({_W}) AS ret FROM bars){sql}"
    ORACLES[name] = f"{base} SELECT symbol, {_TS}, {', '.join(f'{_r(x)} AS {c}' for c, x in columns.items())} FROM {names[len(layers)]}"
    QUERIES[name] = lambda spark, sf_dir: _shown(price_features(bars_daily(spark, sf_dir), kernels=False), *columns)


def _z(x: str, k: int) -> str:
    return f"({x} - ({_roll('avg', x, k, k // 2)})) / nullif({_roll('stddev_samp', x, k, k // 2)}, 0)"


_VOLS = f"{_roll('stddev_samp', 'ret', 24, 12)} AS v24, {_roll('stddev_samp', 'ret', 168, 84)} AS v168"
_ret_features("vol_of_vol", {"vol_of_vol": _roll("stddev_samp", "v24", 168, 84), "vol_ratio": "v24 / nullif(v168, 0)"}, _VOLS)
_ret_features("taker_imbalance_z", {"taker_imb_z": _z("imb", 168)}, "taker_buy_base / nullif(volume, 0) - 0.5 AS imb")
_ret_features("amihud", {"amihud": _z("impact", 336)}, "abs(ret) / nullif(quote_volume, 0) * 1e12 AS one", f"{_roll('avg', 'one', 24, 24)} AS impact")
_YZ = 0.34 / (1.34 + 25 / 23)
_ret_features(
    "yang_zhang", {"yz_vol": "sqrt(CASE WHEN v < 0 THEN 0 ELSE v END)"},
    f"ln(open / lag(close) OVER ({_W})) AS o1, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs",
    f"({_roll('var_samp', 'o1', 24, 24)}) + {_YZ!r} * ({_roll('var_samp', 'ret', 24, 24)}) + {1 - _YZ!r} * ({_roll('avg', 'rs', 24, 24)}) AS v",
)
_ret_features(
    "rolling_autocorr",
    {"ac1_168": f"CASE WHEN count(ret) OVER ({_W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) >= 84 THEN corr(ret, before) OVER ({_W} ROWS BETWEEN 166 PRECEDING AND CURRENT ROW) END"},
    f"lag(ret) OVER ({_W}) AS before",
)


def _hurst_sql() -> str:
    import math

    lags = (2, 4, 8, 16, 32)
    xs = [math.log(k) for k in lags]
    mean = sum(xs) / len(xs)
    spread = sum((x - mean) ** 2 for x in xs)
    d = ", ".join(f"ln(close) - lag(ln(close), {k}) OVER ({_W}) AS d{k}" for k in lags)
    t = ", ".join(f"CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) >= 200 THEN ln(sqrt(nullif(stddev_pop(d{k}) OVER ({_W} ROWS BETWEEN {199 - k} PRECEDING AND CURRENT ROW), 0))) END AS t{k}" for k in lags)
    total = " + ".join(f"t{k}" for k in lags)
    slope = " + ".join(f"({x - mean!r}) * (t{k} - ({total}) / {len(lags)})" for x, k in zip(xs, lags, strict=True))
    return f"WITH {_DAILY}, d AS (SELECT *, {d} FROM bars), taus AS (SELECT *, {t} FROM d) SELECT symbol, {_TS}, {_r(f'2 * ({slope}) / {spread!r}')} AS hurst FROM taus"


@_query("hurst", _hurst_sql())
def _hurst(spark, sf_dir):
    return _shown(hurst(bars_daily(spark, sf_dir).withColumn("log_close", F.ln("close"))), "hurst")


def _ewm_of(source: str, x: str, decay: float, at_least: int, adjust: bool = True, keys: tuple[str, ...] = ("symbol",)) -> str:
    """(keys, ts, m, sd) for each row of source (keys, ts, n from 1, x), each with all those before it."""
    w = f"pow({1 - decay!r}, a.n - b.n)" + ("" if adjust else f" * CASE WHEN b.n = 1 THEN 1 ELSE {decay!r} END")
    same = " AND ".join([*[f"a.{k} = b.{k}" for k in keys], "b.n <= a.n"])
    own = ", ".join(f"a.{k}" for k in (*keys, "ts"))
    named = ", ".join((*keys, "ts"))
    return f"""(SELECT {named}, CASE WHEN c >= {at_least} THEN wx / w END AS m,
  CASE WHEN c >= {max(at_least, 2)} THEN sqrt(greatest((wxx / w - wx * wx / w / w) * w * w / nullif(w * w - ww, 0), 0)) END AS sd
  FROM (SELECT {named}, count(x) AS c, sum(w) AS w, sum(w * w) AS ww, sum(w * x) AS wx, sum(w * x * x) AS wxx
   FROM (SELECT {own}, b.{x} AS x, CASE WHEN b.{x} IS NOT NULL THEN {w} END AS w FROM {source} a JOIN {source} b ON {same}) GROUP BY {named}))"""


_N = f"row_number() OVER ({_W}) AS n"
_HALF = lambda h: 1 - 0.5 ** (1 / h)


@_query("ewma_vol", f"WITH {_DAILY}, s AS (SELECT symbol, ts, {_N}, ln(close) - lag(ln(close)) OVER ({_W}) AS x FROM bars) SELECT symbol, {_TS}, {_r('sd')} AS ewma_vol FROM {_ewm_of('s', 'x', _HALF(72), 36)}")
def _ewma_vol(spark, sf_dir):
    return _shown(ewm(with_returns(bars_daily(spark, sf_dir)), {"ewma_vol": {"column": "ret_1", "stat": "std", "halflife": 72, "min_periods": 36}}), "ewma_vol")


@_query("daily_vol", f"WITH {_DAILY}, s AS (SELECT symbol, ts, {_N}, close / lag(close, 24) OVER ({_W}) - 1 AS x FROM bars) SELECT symbol, {_TS}, {_r('sd')} AS daily_vol FROM {_ewm_of('s', 'x', 2 / 101, 50)}")
def _daily_vol(spark, sf_dir):
    return _shown(daily_vol(bars_daily(spark, sf_dir)), "daily_vol")


_STEP = f"close - lag(close) OVER ({_W})"
_TR = f"greatest(high - low, abs(high - lag(close) OVER ({_W})), abs(low - lag(close) OVER ({_W})))"


@_query("rsi_atr", f"""WITH {_DAILY}, s AS (SELECT symbol, ts, close, {_N}, CASE WHEN {_STEP} IS NOT NULL THEN greatest({_STEP}, 0) END AS up, CASE WHEN {_STEP} IS NOT NULL THEN greatest(-({_STEP}), 0) END AS down, {_TR} AS tr FROM bars)
 SELECT s.symbol, {_ALIKE.format('s.ts')} AS ts, {_r('(100 - 100 / (1 + u.m / nullif(d.m, 0))) / 100 - 0.5')} AS rsi_14, {_r('t.m / nullif(s.close, 0)')} AS atr_pct
 FROM s JOIN {_ewm_of('s', 'up', 1 / 14, 14)} u USING (symbol, ts) JOIN {_ewm_of('s', 'down', 1 / 14, 14)} d USING (symbol, ts) JOIN {_ewm_of('s', 'tr', 1 / 14, 14)} t USING (symbol, ts)""")
def _rsi_atr(spark, sf_dir):
    return _shown(ewm_features(with_returns(bars_daily(spark, sf_dir))), "rsi_14", "atr_pct")


_FD = [float(w) for w in frac_diff_weights(0.4, 1e-3)]


@_query("frac_diff", f"""WITH {_DAILY}, s AS (SELECT symbol, ts, {_N}, ln(close) AS x FROM bars), w AS (SELECT unnest({_FD!r}) AS w, unnest(range({len(_FD)})) AS k)
 SELECT a.symbol, {_ALIKE.format('a.ts')} AS ts, {_r(f'CASE WHEN count(b.x) = {len(_FD)} THEN sum(w * b.x) END')} AS fd FROM s a LEFT JOIN s b ON a.symbol = b.symbol AND b.n BETWEEN a.n - {len(_FD) - 1} AND a.n LEFT JOIN w ON w.k = a.n - b.n GROUP BY a.symbol, a.ts""")
def _frac_diff(spark, sf_dir):
    return _shown(frac_diff(bars_daily(spark, sf_dir).withColumn("log_close", log(F.col("close"))), "log_close", "fd", 0.4, 1e-3), "fd")


@_query("cusum_events", f"""WITH RECURSIVE {_DAILY}, s AS (SELECT symbol, ts, {_N}, ln(close) - lag(ln(close)) OVER ({_W}) AS r FROM bars),
 c AS (SELECT symbol, ts, n, 0::DOUBLE AS up, 0::DOUBLE AS down, 0 AS event FROM s WHERE n = 1 UNION ALL
  SELECT symbol, ts, n, CASE WHEN u > 0.3 THEN 0 ELSE u END, CASE WHEN u <= 0.3 AND d < -0.3 THEN 0 ELSE d END, CASE WHEN u > 0.3 THEN 1 WHEN d < -0.3 THEN -1 ELSE 0 END
  FROM (SELECT s.symbol, s.ts, s.n, greatest(0, c.up + s.r) AS u, least(0, c.down + s.r) AS d FROM c JOIN s ON s.symbol = c.symbol AND s.n = c.n + 1))
 SELECT symbol, {_TS}, event::INT AS event FROM c""")
def _cusum(spark, sf_dir):
    bars = with_returns(bars_daily(spark, sf_dir)).withColumn("_bar", F.lit(0.3))
    return cusum_events(bars, "ret_1", "_bar").select("symbol", stamp().alias("ts"), "event")


@_query("turnover_buffer", f"""WITH RECURSIVE {_DAILY}, s AS (SELECT symbol, ts, {_N}, coalesce({_mom(24)}, 0) AS x FROM bars),
 c AS (SELECT symbol, ts, n, CASE WHEN abs(x) > 0.1 * greatest(abs(x), 0.01) THEN x ELSE 0 END AS held FROM s WHERE n = 1 UNION ALL
  SELECT s.symbol, s.ts, s.n, CASE WHEN abs(s.x - c.held) > 0.1 * greatest(abs(s.x), abs(c.held), 0.01) THEN s.x ELSE c.held END FROM c JOIN s ON s.symbol = c.symbol AND s.n = c.n + 1)
 SELECT symbol, {_TS}, {_r('held')} AS held FROM c""")
def _buffer(spark, sf_dir):
    moved = bars_daily(spark, sf_dir).withColumn("target", F.coalesce(log(ratio(F.col("close"), lag("close", 24))), F.lit(0.0)))
    return _shown(turnover_buffer(moved.select("symbol", "ts", "target"), "target", "held"), "held")


@_query("cross_sectional_demean", f"WITH {_DAILY}, m AS (SELECT symbol, ts, {_mom(24)} AS mom FROM bars) SELECT symbol, {_TS}, {_r('mom - avg(mom) OVER (PARTITION BY ts)')} AS demeaned FROM m")
def _demean(spark, sf_dir):
    from pyspark.sql import Window

    features = price_features(bars_daily(spark, sf_dir), kernels=False)
    return _shown(features.withColumn("demeaned", F.col("mom_24") - F.avg("mom_24").over(Window.partitionBy("ts"))), "demeaned")


@_query("open_interest_features", f"""WITH {_DAILY}, o AS (SELECT symbol, ts, volume AS oi FROM bars QUALIFY row_number() OVER ({_W}) % 5 = 0),
 j AS (SELECT b.symbol, b.ts, ln(o.oi) AS x FROM bars b ASOF LEFT JOIN o ON b.symbol = o.symbol AND b.ts >= o.ts)
 SELECT symbol, {_TS}, {_r(f'x - lag(x, 24) OVER ({_W})')} AS oi_chg_24, {_r(_z('x', 168))} AS oi_z_168 FROM j""")
def _oi_features(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return _shown(metrics_features(bars, open_interest(bars)), "oi_chg_24", "oi_z_168")


@_query("funding_features", f"""WITH {_HOURLY}, f AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, (avg(value) - 100) / 1e6 AS rate FROM events WHERE hour(ts) IN (0, 8, 16) GROUP BY 1, 2),
 j AS (SELECT b.symbol, b.ts, f.rate AS x FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts)
 SELECT symbol, {_TS}, {_r(_z('x', 168))} AS funding_z_168, {_r(f"1e6 * ({_roll('sum', 'x', 24, 24)})")} AS funding_cum_24, {_r(f"1e6 * ({_roll('sum', 'x', 168, 168)})")} AS funding_cum_168, {_r(_roll('avg', 'sign(x)', 72, 72))} AS funding_sign_persist FROM j""")
def _funding_features(spark, sf_dir):
    from tidebar.operators.features import funding_features

    out = funding_features(bars_hourly(spark, sf_dir), hourly_funding(spark, sf_dir))
    out = out.withColumns({c: F.col(c) * 1e6 for c in ("funding_cum_24", "funding_cum_168")})
    return _shown(out, "funding_z_168", "funding_cum_24", "funding_cum_168", "funding_sign_persist")


@_query("event_asof_forward", f"""WITH {_HOURLY}, e2 AS (SELECT event_id, event_type AS symbol, ts FROM events)
 SELECT e2.event_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS bar_ts FROM e2 ASOF LEFT JOIN bars b ON e2.symbol = b.symbol AND e2.ts <= b.ts""")
def _asof_forward(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return as_of_event(events, bars_hourly(spark, sf_dir)).select("event_id", stamp("bar_ts").alias("bar_ts"))


# Labels and weights


@_query("triple_barrier_boundary", f"{labels_sql('CASE WHEN trades % 2 = 0 THEN 0.05 ELSE 0.1 END', 0.05)} SELECT symbol, {_TS}, strftime(t1, '%Y-%m-%d %H:%M:%S') AS t1, {_r('ret')} AS ret, {_r('trgt')} AS trgt FROM labels")
def _boundary(spark, sf_dir):
    bars = bars_daily(spark, sf_dir).withColumns({"_event": F.lit(True), "_target": F.when(F.col("trades") % 2 == 0, 0.05).otherwise(0.1)})
    labels = triple_barrier(bars, "_event", "_target", min_target=0.05)
    return labels.select("symbol", stamp().alias("ts"), stamp("t1").alias("t1"), r6("ret").alias("ret"), r6("trgt").alias("trgt"))


@_query("meta_labels", f"{labels_sql(_roll('stddev_samp', 'ret_1', 24, 12), side=f'sign({_mom(24)})')} SELECT symbol, {_TS}, strftime(t1, '%Y-%m-%d %H:%M:%S') AS t1, {_r('ret')} AS ret, (ret > 0)::INT AS bin, side::DOUBLE AS side FROM labels")
def _meta_labels(spark, sf_dir):
    from tidebar.operators.features import realised_vol

    bars = with_returns(bars_daily(spark, sf_dir))
    bars = bars.withColumns({"_event": F.lit(True), "_target": realised_vol(F.col("ret_1"), 24), "_side": F.signum(log(ratio(F.col("close"), lag("close", 24))))})
    labels = triple_barrier(bars, "_event", "_target", side="_side")
    return labels.select("symbol", stamp().alias("ts"), stamp("t1").alias("t1"), r6("ret").alias("ret"), "bin", (F.col("side") + 0.0).alias("side"))


_LIVES = f"""{LABELS}, k AS (SELECT f.symbol, f.ts, f.ret_1, count(l2.ts) AS c FROM f LEFT JOIN labels l2 ON l2.symbol = f.symbol AND f.ts BETWEEN l2.ts AND l2.t1 GROUP BY ALL),
 u AS (SELECT labels.symbol, labels.ts, coalesce(avg(1 / nullif(k.c, 0)), 0) AS uniqueness, abs(coalesce(sum(k.ret_1 / nullif(k.c, 0)), 0)) AS weight FROM labels JOIN k ON k.symbol = labels.symbol AND k.ts BETWEEN labels.ts AND labels.t1 GROUP BY ALL)"""


@_query("sample_uniqueness", f"{_LIVES} SELECT symbol, {_TS}, {_r('uniqueness')} AS uniqueness FROM u")
def _uniqueness(spark, sf_dir):
    return _shown(sample_uniqueness(*labelled_bars(spark, sf_dir)), "uniqueness")


@_query("return_weights", f"{_LIVES} SELECT symbol, {_TS}, {_r('weight / avg(weight) OVER (PARTITION BY symbol)')} AS weight FROM u")
def _return_weights(spark, sf_dir):
    return _shown(return_weights(*labelled_bars(spark, sf_dir)), "weight")


@_query("time_decay", f"{_LIVES} SELECT symbol, {_TS}, {_r(f'1 - 0.4 / t * t + 0.4 / t * sum(uniqueness) OVER ({_W})')} AS decay FROM (SELECT *, sum(uniqueness) OVER (PARTITION BY symbol) AS t FROM u)")
def _decay(spark, sf_dir):
    return _shown(time_decay(sample_uniqueness(*labelled_bars(spark, sf_dir)), last_weight=0.6), "decay")


# Validation

_PLACED = f"{LABELS}, x AS (SELECT symbol, ts, t1, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM labels)"


@_query("purged_kfold", f"""{_PLACED}, o AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM x),
 b AS (SELECT symbol, own AS fold, max(i) AS last, min(ts) AS t0, max(t1) AS te FROM o GROUP BY 1, 2)
 SELECT o.symbol, {_ALIKE.format('o.ts')} AS ts, fold::INT AS fold, CASE WHEN own = fold THEN 'test' WHEN o.t1 > t0 AND o.ts < te THEN 'purged' WHEN i > last AND i <= last + n // 100 THEN 'embargo' ELSE 'train' END AS role FROM o JOIN b ON o.symbol = b.symbol""")
def _purged(spark, sf_dir):
    return V.purged_kfold(labelled_bars(spark, sf_dir)[1]).select("symbol", stamp().alias("ts"), "fold", "role")


@_query("walk_forward", f"""{_PLACED}, s AS (SELECT *, unnest(range(6)) AS split, floor(n * 0.3) AS first FROM x), b AS (SELECT *, floor(first + split * (n - first) / 6) AS lo, CASE WHEN split = 5 THEN n ELSE floor(first + (split + 1) * (n - first) / 6) END AS hi FROM s)
 SELECT symbol, {_TS}, split::INT AS split, CASE WHEN i >= lo THEN 'test' ELSE 'train' END AS role FROM b WHERE i < hi AND (i >= lo OR i < lo - 5)""")
def _walk(spark, sf_dir):
    return V.walk_forward(labelled_bars(spark, sf_dir)[1], embargo=5).select("symbol", stamp().alias("ts"), "split", "role")


@_query("purge_overlap", f"{LABELS}, z AS (SELECT symbol, TIMESTAMP '1994-06-01' AS b, TIMESTAMP '1995-06-01' AS e FROM (SELECT DISTINCT symbol FROM bars)) SELECT labels.symbol, {_ALIKE.format('labels.ts')} AS ts FROM labels JOIN z USING (symbol) WHERE NOT (t1 > b AND labels.ts < e)")
def _purge_overlap(spark, sf_dir):
    bars, labels = labelled_bars(spark, sf_dir)
    spans = bars.select("symbol").distinct().select("symbol", F.expr("timestamp_ntz'1994-06-01'").alias("begin"), F.expr("timestamp_ntz'1995-06-01'").alias("end"))
    return without_overlap(labels, spans).select("symbol", stamp().alias("ts"))


_GRID = [(f, s) for f in (5, 10, 20) for s in (50, 100)]


def _variant(fast: int, slow: int) -> str:
    return f"ma_{fast:02d}_{slow:03d}"


def ma_variants(spark, sf_dir) -> DataFrame:
    """(variant, ts, ret, ...) of moving-average crossovers, a hundredth of the book in each symbol."""
    bars = bars_daily(spark, sf_dir)
    signals = V.union_all([ma_crossover(bars, f, s).withColumns({"variant": F.lit(_variant(f, s)), "weight": F.col("signal") / 100}) for f, s in _GRID])
    return run_backtest(bars, signals, books=("variant",))


def _cross(fast: int, slow: int) -> str:
    return f"CASE WHEN {_roll('avg', 'close', fast, fast)} > {_roll('avg', 'close', slow, slow)} THEN 1.0 ELSE 0.0 END"


_V = "PARTITION BY variant, symbol ORDER BY ts"
_SWEEP = f"""WITH {_DAILY}, wt AS ({' UNION ALL '.join(f"SELECT '{_variant(f, s)}' AS variant, symbol, ts, ({_cross(f, s)}) / 100 AS weight FROM bars" for f, s in _GRID)}),
 c AS (SELECT * FROM (SELECT DISTINCT variant FROM wt), (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)),
 d AS (SELECT c.variant, c.symbol, c.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY c.variant, c.symbol ORDER BY c.ts) AS price, coalesce(lag(coalesce(wt.weight, 0)) OVER (PARTITION BY c.variant, c.symbol ORDER BY c.ts), 0) AS pos
  FROM c LEFT JOIN bars b ON b.symbol = c.symbol AND b.ts = c.ts LEFT JOIN wt ON wt.variant = c.variant AND wt.symbol = c.symbol AND wt.ts = c.ts),
 e AS (SELECT variant, ts, pos, coalesce(lag(pos) OVER ({_V}), 0) AS held, coalesce(price / lag(price) OVER ({_V}) - 1, 0) AS move FROM d),
 v AS (SELECT variant, ts, sum(held * move) - sum(abs(pos - held)) * {Costs().per_turnover!r} AS ret FROM e GROUP BY variant, ts)"""


@_query("sweep_returns", f"{_SWEEP} SELECT variant, {_TS}, {_r('ret')} AS ret FROM v")
def _sweep_returns(spark, sf_dir):
    return _shown(ma_variants(spark, sf_dir), "ret", keys=("variant", "ts"))


@_query("column_sharpe", f"{_SWEEP} SELECT variant, {_r('avg(ret) / stddev_samp(ret)')} AS sharpe FROM v GROUP BY variant")
def _column_sharpe(spark, sf_dir):
    return _shown(V.column_sharpe(ma_variants(spark, sf_dir)), "sharpe", keys=("variant",))


@_query("sweep_top10", f"{_SWEEP} SELECT variant, {_r('avg(ret) / stddev_samp(ret) * sqrt(365)')} AS sharpe FROM v GROUP BY variant ORDER BY avg(ret) / stddev_samp(ret) DESC, variant LIMIT 10")
def _sweep_top(spark, sf_dir):
    return _shown(top_variants(performance(ma_variants(spark, sf_dir), 365.0, keys=("variant",))), "sharpe", keys=("variant",))


@_query("sharpe_moments", f"{_SWEEP} SELECT variant, count(*) AS n, {_r('1000 * avg(ret)')} AS mean, {_r('1000 * stddev_samp(ret)')} AS sd, {_r('avg(ret) / stddev_samp(ret)')} AS sharpe, {_r('skewness(ret) * (n - 2) / sqrt(n * (n - 1))')} AS skew, {_r('kurtosis_pop(ret) + 3')} AS kurt FROM (SELECT *, count(*) OVER (PARTITION BY variant) AS n FROM v) GROUP BY variant, n")
def _sharpe_moments(spark, sf_dir):
    m = V.sharpe_moments(ma_variants(spark, sf_dir), keys=("variant",)).withColumns({"mean": F.col("mean") * 1000, "sd": F.col("sd") * 1000})
    return m.select("variant", "n", *[r6(c).alias(c) for c in ("mean", "sd", "sharpe", "skew", "kurt")])


_SPLIT = f"""{_SWEEP}, y AS (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS i FROM v), nn AS (SELECT max(i) + 1 AS n FROM y),
 z AS (SELECT variant, ret, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS block FROM y, nn),
 m AS (SELECT unnest(range(64)) AS combo), k AS (SELECT combo FROM m WHERE bit_count(combo::INT) = 3),
 s AS (SELECT combo, variant, avg(ret) FILTER ((combo >> block) & 1 = 1) / stddev_samp(ret) FILTER ((combo >> block) & 1 = 1) AS ins, avg(ret) FILTER ((combo >> block) & 1 = 0) / stddev_samp(ret) FILTER ((combo >> block) & 1 = 0) AS oos FROM z, k GROUP BY 1, 2),
 w AS (SELECT *, rank() OVER (PARTITION BY combo ORDER BY oos) + (count(*) OVER (PARTITION BY combo, oos) - 1) / 2 AS place, row_number() OVER (PARTITION BY combo ORDER BY ins DESC, variant) AS best, count(*) OVER (PARTITION BY combo) AS cols FROM s),
 t2 AS (SELECT combo, variant AS best, ins AS is_sharpe, oos AS oos_sharpe, ln(place / (cols + 1) / (1 - place / (cols + 1))) AS logit FROM w WHERE best = 1)"""


@_query("pbo_splits", f"{_SPLIT} SELECT combo, best, {_r('is_sharpe')} AS is_sharpe, {_r('oos_sharpe')} AS oos_sharpe, {_r('logit')} AS logit FROM t2")
def _pbo_splits(spark, sf_dir):
    return _shown(V.cscv_splits(ma_variants(spark, sf_dir), 6), "is_sharpe", "oos_sharpe", "logit", keys=("combo", "best"))


@_query("pbo", f"{_SPLIT} SELECT {_r('avg((logit <= 0)::INT)')} AS pbo, count(*) AS n_splits, {_r('median(logit)')} AS median_logit, {_r('avg(oos_sharpe)')} AS oos_sharpe_mean, {_r('avg(is_sharpe)')} AS is_sharpe_mean, {_r('regr_slope(oos_sharpe, is_sharpe)')} AS degradation_slope, {_r('avg((oos_sharpe < 0)::INT)')} AS prob_oos_loss FROM t2")
def _pbo(spark, sf_dir):
    found = V.backtest_overfitting(V.cscv_splits(ma_variants(spark, sf_dir), 6))
    return found.select(*[c if c == "n_splits" else r6(c).alias(c) for c in found.columns])


@_query("walk_forward_selection", f"""{_SWEEP}, x AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM v), s AS (SELECT *, unnest(range(6)) AS split, floor(n * 0.3) AS first FROM x),
 b AS (SELECT *, floor(first + split * (n - first) / 6) AS lo, CASE WHEN split = 5 THEN n ELSE floor(first + (split + 1) * (n - first) / 6) END AS hi FROM s),
 h AS (SELECT split, variant, avg(ret) / stddev_samp(ret) AS sharpe FROM b WHERE i < lo GROUP BY 1, 2), j AS (SELECT split, variant FROM h QUALIFY row_number() OVER (PARTITION BY split ORDER BY sharpe DESC NULLS LAST, variant) = 1)
 SELECT b.split::INT AS split, b.variant AS chosen, {_TS}, {_r('ret')} AS ret FROM b JOIN j ON b.split = j.split AND b.variant = j.variant WHERE i >= lo AND i < hi""")
def _selection(spark, sf_dir):
    return _shown(V.walk_forward_selection(ma_variants(spark, sf_dir)), "ret", keys=("split", "chosen", "ts"))


@_query("leakage_check", f"""WITH {_DAILY}, f AS (SELECT symbol, ts, ln(lead(close) OVER ({_W}) / close) AS future, {_mom(4)} AS mom_4, (high - low) / close AS hl, ln(lead(close) OVER ({_W}) / close) * 2 + 1 AS leak FROM bars),
 r AS (SELECT 'mom_4' AS feature, abs(corr(mom_4, future)) AS c FROM f UNION ALL SELECT 'hl', abs(corr(hl, future)) FROM f UNION ALL SELECT 'leak', abs(corr(leak, future)) FROM f) SELECT feature, {_r('c')} AS abs_corr FROM r WHERE c > 0.3""")
def _leakage(spark, sf_dir):
    after = log(ratio(F.lead("close").over(by_symbol()), F.col("close")))
    bars = bars_daily(spark, sf_dir).withColumns({"future_return": after, "mom_4": log(ratio(F.col("close"), lag("close", 4))), "hl": ratio(F.col("high") - F.col("low"), F.col("close"))})
    features = bars.select("symbol", "ts", "mom_4", "hl", (F.col("future_return") * 2 + 1).alias("leak"))
    return _shown(V.leakage_check(features, bars.select("symbol", "ts", "future_return")), "abs_corr", keys=("feature",))


# Signals


def _features(spark, sf_dir) -> DataFrame:
    return price_features(bars_daily(spark, sf_dir), kernels=False)


_TS_ALL = (24, 72, 168, 336, 720)
_SIGNAL_BASE = f"""WITH {_DAILY}, f AS (SELECT *, ln(close) - lag(ln(close)) OVER ({_W}) AS ret FROM bars),
 g AS (SELECT *, {', '.join(f'{_mom(k)} AS mom_{k}' for k in _TS_ALL)}, {_VOLS}, lag(ret) OVER ({_W}) AS before, {_roll('avg', 'abs(ret) / nullif(quote_volume, 0) * 1e12', 24, 24)} AS impact FROM f),
 h AS (SELECT *, {', '.join(f'mom_{k} / nullif(v168 * sqrt({k}), 0) AS ts_{k}' for k in _TS_ALL)}, v24 / nullif(v168, 0) AS vr,
  (close - ({_roll('min', 'low', 168, 84)})) / nullif(({_roll('max', 'high', 168, 84)}) - ({_roll('min', 'low', 168, 84)}), 0) - 0.5 AS pos,
  CASE WHEN count(ret) OVER ({_W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) >= 84 THEN corr(ret, before) OVER ({_W} ROWS BETWEEN 166 PRECEDING AND CURRENT ROW) END AS ac, {_z('impact', 336)} AS am,
  rank() OVER (PARTITION BY ts ORDER BY mom_168 NULLS LAST) AS k, count(*) OVER (PARTITION BY ts, mom_168) AS tied, count(mom_168) OVER (PARTITION BY ts) AS many FROM g),
 i AS (SELECT *, CASE WHEN mom_168 IS NOT NULL THEN 2 * ((k + (tied - 1) / 2) / many - 0.5) END AS cs FROM h),
 j AS (SELECT *, cs - avg(cs) OVER (PARTITION BY ts) AS cross_ FROM i)"""


def _available(names: list[str]) -> str:
    return f"list_avg(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL))"


_CARRY = f"least(greatest((0.5 * coalesce(tanh({_available([f'ts_{k}' for k in _TS_ALL[1:]])} / 1.5), 0) + 0.3 * coalesce(cross_, 0)) * coalesce(least(greatest(1 / greatest(vr, 0.5), 0.25), 1), 1), -1), 1)"
_REGIME = f"least(greatest((coalesce(abs({_available([f'sign(ts_{k})' for k in _TS_ALL])}), 0) - 0.25) / 0.55, 0), 1)"
_UNBOUND = f"""(0.35 * tanh({_available([f'ts_{k}' for k in _TS_ALL])} / 1.25) * {_REGIME} + 0.20 * tanh(coalesce(pos, 0) / 0.25) * {_REGIME} + 0.20 * cross_)
 * least(greatest(1.5 / greatest(coalesce(vr, 1), 1), 0.25), 1) * least(greatest(1 - 0.2 * least(greatest(coalesce(am, 0), 0), 4), 0.25), 1)"""
_ADAPTIVE = f"{_SIGNAL_BASE}, u AS (SELECT *, {_UNBOUND} AS raw FROM j)"
_RAW = "CASE WHEN raw IS NULL THEN 0 ELSE least(greatest(raw, -1), 1) END"


@_query("trend_carry", f"{_SIGNAL_BASE} SELECT symbol, {_TS}, {_r(_CARRY)} AS signal FROM j")
def _trend_carry(spark, sf_dir):
    return _shown(trend_carry(_features(spark, sf_dir)), "signal")


@_query("adaptive_raw", f"{_ADAPTIVE} SELECT symbol, {_TS}, {_r(_RAW)} AS signal FROM u")
def _adaptive_raw(spark, sf_dir):
    return _shown(adaptive_raw(_features(spark, sf_dir)), "signal")


@_query("adaptive_multifactor", f"{_ADAPTIVE}, s AS (SELECT symbol, ts, {_N}, {_RAW} AS x FROM u) SELECT symbol, {_TS}, {_r('m')} AS signal FROM {_ewm_of('s', 'x', _HALF(12), 1, False)}")
def _adaptive(spark, sf_dir):
    return _shown(adaptive_multifactor(_features(spark, sf_dir)), "signal")


_REVERT = f"coalesce(-tanh(move / nullif({_roll('stddev_samp', 'ret', 720, 360)}, 0)), 0)"


@_query("ensemble", f"WITH {_DAILY}, f AS (SELECT symbol, ts, close, ln(close / lag(close) OVER ({_W})) AS ret, {_mom(48)} AS move FROM bars) SELECT symbol, {_TS}, {_r(f'least(greatest(0.5 * ({_MA}) + 0.5 * {_REVERT}, -1), 1)')} AS signal FROM f")
def _ensemble(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return _shown(ensemble([ma_crossover(bars), mean_reversion(bars)]), "signal")


@_query("ma_crossover_short", f"WITH {_DAILY}, f AS (SELECT symbol, ts, {_roll('avg', 'close', 20, 20)} AS a, {_roll('avg', 'close', 100, 100)} AS b FROM bars) SELECT symbol, {_TS}, CASE WHEN a > b THEN 1.0 WHEN a < b THEN -1.0 ELSE 0.0 END::DOUBLE AS signal FROM f")
def _ma_short(spark, sf_dir):
    return _shown(ma_crossover(bars_daily(spark, sf_dir), allow_short=True), "signal")


# Risk

_RISK = RiskConfig(bars_per_year=365.0)
_VT = f"""WITH {_DAILY}, sg AS (SELECT symbol, ts, {_MA} AS signal FROM bars), c AS (SELECT * FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)),
 p AS (SELECT c.symbol, c.ts, b.close, sg.signal, row_number() OVER (PARTITION BY c.symbol ORDER BY c.ts) AS n FROM c LEFT JOIN bars b ON b.symbol = c.symbol AND b.ts = c.ts LEFT JOIN sg ON sg.symbol = c.symbol AND sg.ts = c.ts),
 s AS (SELECT *, ln(close) - lag(ln(close)) OVER ({_W}) AS x FROM p), ev AS {_ewm_of('s', 'x', _HALF(72), 36)},
 r AS (SELECT s.*, coalesce(s.signal / nullif(ev.sd * sqrt(365), 0), 0) AS raw FROM s JOIN ev USING (symbol, ts)),
 bk AS (SELECT 'all' AS book, ts, row_number() OVER (ORDER BY ts) AS n, sum(e) AS x FROM (SELECT ts, coalesce(lag(raw) OVER ({_W}), 0) * coalesce(x, 0) AS e FROM r) GROUP BY ts),
 bv AS {_ewm_of('bk', 'x', _HALF(288), 72, keys=('book',))},
 sc AS (SELECT ts, CASE WHEN nullif(sd, 0) IS NOT NULL THEN least(0.2 / (sd * sqrt(365)), 5) END AS now FROM bv), sl AS (SELECT ts, lag(now) OVER (ORDER BY ts) AS l FROM sc),
 sf AS (SELECT ts, coalesce(last_value(l IGNORE NULLS) OVER (ORDER BY ts), 0) AS scale FROM sl),
 wc AS (SELECT r.symbol, r.ts, least(greatest(raw * scale, -0.5), 0.5) AS w FROM r JOIN sf USING (ts)),
 vt AS (SELECT symbol, ts, w * coalesce(least(2.0 / nullif(sum(abs(w)) OVER (PARTITION BY ts), 0), 1), 1) AS weight FROM wc)"""


@_query("vol_target_weights", f"{_VT} SELECT symbol, {_TS}, {_r('weight')} AS weight FROM vt")
def _vol_target(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return _shown(vol_target_weights(bars, ma_crossover(bars), _RISK), "weight")


@_query("kelly_fraction", f"{_MA_BOOK} SELECT {_TS}, {_r("CASE WHEN m / nullif(v, 0) IS NULL THEN 0 ELSE least(greatest(m / nullif(v, 0), -1), 1) END")} AS kelly FROM (SELECT ts, {_roll('avg', 'ret', 720, 360)} AS m, {_roll('var_samp', 'ret', 720, 360)} AS v FROM (SELECT 0 AS symbol, * FROM b))")
def _kelly(spark, sf_dir):
    return _shown(kelly_fraction(_ma_book(spark, sf_dir).withColumn("book", F.lit("all"))), "kelly", keys=("ts",))


@_query("drawdown_throttle", f"{_MA_BOOK}{_DRAWN} SELECT {_TS}, {_r('least(greatest(1 - (abs(drawdown) - 0.08) / 0.12, 0), 1)')} AS throttle FROM dd")
def _throttle(spark, sf_dir):
    return _shown(drawdown_throttle(with_equity(_ma_book(spark, sf_dir))), "throttle", keys=("ts",))


@_query("kill_switch", f"""WITH {_HOURLY}, e AS (SELECT ts, sum(close) AS equity FROM bars GROUP BY ts), d AS (SELECT *, equity / first_value(equity) OVER (PARTITION BY ts::DATE ORDER BY ts) - 1 AS loss, equity / max(equity) OVER (ORDER BY ts) - 1 AS fallen FROM e),
 b AS (SELECT *, CASE WHEN fallen <= -0.2 THEN 'max drawdown hit' WHEN loss <= -0.03 THEN 'daily loss limit hit' END AS breach FROM d)
 SELECT {_TS}, {_r('loss')} AS daily_loss, {_r('fallen')} AS drawdown, last_value(breach IGNORE NULLS) OVER (ORDER BY ts) AS reason FROM b""")
def _kill(spark, sf_dir):
    equity = bars_hourly(spark, sf_dir).groupBy("ts").agg(F.sum("close").alias("equity")).withColumn("book", F.lit("all"))
    return kill_switch(equity).select(stamp().alias("ts"), r6("daily_loss").alias("daily_loss"), r6("drawdown").alias("drawdown"), "reason")


_HELD = [("A", 0.02), ("N", -3.0), ("X", 1.0)]


@_query("rebalance_orders", f"""WITH {_DAILY}, l AS (SELECT symbol, close AS price, CASE symbol WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.0 ELSE -0.2 END AS w FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
 p AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {q}::DOUBLE)" for s, q in _HELD)}) p(symbol, qty)), o AS (SELECT l.*, coalesce(qty, 0) AS cur, w * 10000 / price AS tgt FROM l LEFT JOIN p USING (symbol))
 SELECT symbol, {_r('cur')} AS current, {_r('tgt')} AS target, {_r('tgt - cur')} AS delta, abs(tgt) < abs(cur) AND (tgt = 0 OR sign(tgt) = sign(cur)) AS reduce_only FROM o WHERE abs(tgt - cur) * price >= greatest(0.1 * 10000 * abs(CASE WHEN w = 0 THEN 0.1 ELSE w END), 20)""")
def _orders(spark, sf_dir):
    last = last_rows(bars_daily(spark, sf_dir))
    weights = last.select("symbol", F.when(F.col("symbol") == "A", 0.3).when(F.col("symbol") == "N", 0.0).otherwise(-0.2).alias("weight"))
    orders = rebalance_orders(weights, spark.createDataFrame(_HELD, "symbol string, qty double"), last.select("symbol", F.col("close").alias("price")), 10_000.0)
    return orders.select("symbol", *[r6(c).alias(c) for c in ("current", "target", "delta")], "reduce_only")


_FUNDED = (
    _book_sql(f"({_MA})")
    .replace(" e AS (SELECT ts, pos,", " cap AS (SELECT symbol, ts, price, pos * least(2.0 / nullif(sum(abs(pos)) OVER (PARTITION BY ts), 0), 1) AS capped, pos AS wish FROM d),\n d3 AS (SELECT symbol, ts, price, coalesce(capped, wish) AS pos FROM cap),\n e AS (SELECT symbol, ts, pos,")
    .replace("FROM d),\n g AS", "FROM d3),\n g AS")
)


@_query("backtest_funding", _FUNDED.replace("lag(coalesce(wt.weight, 0)) OVER", "lag(coalesce(wt.weight, 0), 2) OVER").replace("g AS (SELECT ts, sum(held * move) AS gross, sum(abs(pos - held)) AS turnover FROM e GROUP BY ts)", "g AS (SELECT e.ts, sum(held * move) AS gross, sum(abs(pos - held)) AS turnover, sum(held * coalesce(bars.volume / 1e6, 0)) AS fund, sum(abs(pos)) AS exposure FROM e LEFT JOIN bars ON bars.symbol = e.symbol AND bars.ts = e.ts GROUP BY e.ts)") + f" SELECT {_TS}, {_r('gross')} AS gross, {_r('fund')} AS funding, {_r('exposure')} AS exposure, {_r('ret - fund')} AS ret FROM b")
def _backtest_funding(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    rates = bars.select("symbol", "ts", (F.col("volume") / 1e6).alias("funding_rate"))
    book = run_backtest(bars, ma_crossover(bars).withColumnRenamed("signal", "weight"), funding=rates, delay=2, max_gross=2.0)
    return _shown(book, "gross", "funding", "exposure", "ret", keys=("ts",))


# Performance

_YEARS = "(count(*) / 365.0)"
_MORE = {
    "log_return": "ln(product(1 + ret))",
    "log_growth": f"ln(pow(product(1 + ret), 1 / {_YEARS}))",
    "sortino": "avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(365)",
    "log_calmar": f"ln((pow(product(1 + ret), 1 / {_YEARS}) - 1) / abs(min(drawdown)))",
    "years": _YEARS,
    "ann_turnover": "avg(turnover) * 365",
    "gross_sharpe": "avg(gross) / stddev_samp(gross) * sqrt(365)",
    "cost_drag_sharpe": "avg(gross) / stddev_samp(gross) * sqrt(365) - avg(ret) / stddev_samp(ret) * sqrt(365)",
}


@_query("performance_more", f"{_MA_BOOK}{_DRAWN} SELECT {', '.join(f'{_r(x)} AS {c}' for c, x in _MORE.items())} FROM dd")
def _performance_more(spark, sf_dir):
    return _shown(performance(_ma_book(spark, sf_dir), 365.0).withColumns({"log_return": F.log1p("total_return"), "log_growth": F.log1p("cagr"), "log_calmar": F.ln("calmar")}), *_MORE, keys=())


@_query("rolling_sharpe", f"{_MA_BOOK} SELECT {_TS}, {_r('CASE WHEN count(ret) OVER w >= 90 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(365) END')} AS rolling_sharpe FROM b WINDOW w AS (ORDER BY ts ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)")
def _rolling_sharpe(spark, sf_dir):
    return _shown(rolling_sharpe(_ma_book(spark, sf_dir), 90, 365.0), "rolling_sharpe", keys=("ts",))


@_query("monthly_table", f"{_MA_BOOK}, m AS (SELECT year(ts)::INT AS year, month(ts) AS month, product(1 + ret) - 1 AS ret FROM b GROUP BY 1, 2) SELECT year, {', '.join(f'{_r(f"max(ret) FILTER (month = {i})")} AS m{i}' for i in range(1, 13))} FROM m GROUP BY year")
def _monthly_table(spark, sf_dir):
    return monthly_table(_ma_book(spark, sf_dir)).select("year", *[r6(F.col(f"`{i}`")).alias(f"m{i}") for i in range(1, 13)])


_HOLD = _book_sql("1.0 / (SELECT count(DISTINCT symbol) FROM bars)").replace("coalesce(wt.weight, 0)", "1.0 / (SELECT count(DISTINCT symbol) FROM bars)")


@_query("information_ratio", f"WITH o AS ({_MA_BOOK} SELECT ts, ret FROM b), h AS ({_HOLD} SELECT ts, ret FROM b) SELECT {_r('avg(o.ret - coalesce(h.ret, 0)) / stddev_samp(o.ret - coalesce(h.ret, 0)) * sqrt(365)')} AS information_ratio FROM o LEFT JOIN h USING (ts)")
def _information(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return _shown(information_ratio(_ma_book(spark, sf_dir), run_backtest(bars, buy_and_hold(bars)), 365.0), "information_ratio", keys=())


# Streams


@_query("stream_bars", f"WITH {_HOURLY}, last AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT symbol, {_TS}, {', '.join(f'{_r(c)} AS {c}' for c in _BARS)} FROM bars, last WHERE bars.ts + INTERVAL 1 HOUR <= w")
def _stream_bars(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticks = ticks.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("price"))
    path = f"{shared_dir(spark)}/tidebar/stream-{uuid.uuid4().hex}"
    bars = bar_windows(ticks)
    bars.writeStream.format("parquet").option("path", f"{path}/bars").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.schema(bars.schema).parquet(f"{path}/bars"), *_BARS)


# Without SQL: hashed draws, learned models, generated markets


def _plain(name: str):
    def register(f):
        QUERIES[name] = f
        return f

    return register


@_plain("bootstrap_ci")
def _bootstrap(spark, sf_dir):
    return V.bootstrap_sharpe_ci(_ma_book(spark, sf_dir), 200, bars_per_year=365.0)


@_plain("validation_report")
def _report(spark, sf_dir):
    return V.validation_report(_ma_book(spark, sf_dir), n_trials=len(_GRID), bars_per_year=365.0, n_boot=100)


@_plain("shuffle_test")
def _shuffle(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return V.shuffle_test(lambda s: run_backtest(bars, s.withColumn("weight", F.col("signal") / 100), books=("rep",)), ma_crossover(bars), 20)


@_plain("parameter_sweep")
def _parameter_sweep(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    grid = grid_of(fast=(5, 20), slow=(50, 100))
    return parameter_sweep(lambda fast, slow: rule(lambda f: ma_crossover(bars, fast, slow)), grid, _features(spark, sf_dir), bars, risk=_RISK)[1]


@_plain("synthetic_selftest")
def _selftest(spark, sf_dir):
    features, bars, funding = synthetic_dataset(spark, ("A", "B"), n=1500)
    return performance(evaluate(rule(trend_carry), features, bars, funding)[0])


@_plain("meta_label_model")
def _meta_label(spark, sf_dir):
    features = price_features(bars_daily(spark, sf_dir), kernels=False).drop("open", "high", "low", "volume", "quote_volume", "trades", "taker_buy_base", "true_range")
    return MetaLabel(rule(trend_carry), min_events=60, n_splits=4).fit(features).signal(features)
