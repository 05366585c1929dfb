"""Live and alternative feeds behind plain functions, so that any exchange or endpoint can be plugged in and tests need none."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.sources.archive import KLINES, MEASURES, http_get, to_timestamp
from tidebar.sources.lake import Lake

log = logging.getLogger(__name__)

OHLCV = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Rows of a page of an exchange.
PAGE = 1000
_EPOCH = datetime(1970, 1, 1)


def ohlcv_pages(spark: SparkSession, page: Callable[[str, str, int, int], list], symbol: str, timeframe: str, since: int, limit_total: int = 5000) -> DataFrame:
    """Bars from an exchange that answers page(symbol, timeframe, since in ms, limit) with [ms, o, h, l, c, v] rows: each
    page begins behind the last bar of the one before, and a short page is the last. limit_total bounds what is kept."""
    rows: list[list] = []
    while len(rows) < limit_total:
        got = page(symbol, timeframe, since, min(PAGE, limit_total - len(rows)))
        rows += got
        if len(got) < PAGE:
            break
        since = got[-1][0] + 1
    table = spark.createDataFrame([(symbol, int(r[0]), *map(float, r[1:6])) for r in rows[:limit_total]], "symbol string, ms long, open double, high double, low double, close double, volume double")
    return table.select("symbol", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume").dropDuplicates(["symbol", "ts"]).orderBy("ts")


def list_pairs(markets: DataFrame, quote: str = "USDT", limit: int | None = None) -> DataFrame:
    """The active pairs with a quote currency, by name; at most `limit` of them where that is given. markets: (symbol, active)."""
    pairs = markets.where(F.coalesce("active", F.lit(True)) & F.col("symbol").endswith(f"/{quote}")).select("symbol").orderBy("symbol")
    return pairs if limit is None else pairs.limit(limit)


def perpetual(symbol: Column | str) -> Column:
    """BTCUSDT as the exchange's name of the perpetual, BTC/USDT:USDT."""
    return F.regexp_replace(symbol, "USDT", "/USDT:USDT")


def last_price(ticker: Callable[[str], dict], symbol: str) -> float | None:
    """The last price, None where the exchange does not tell."""
    try:
        return float(ticker(symbol)["last"])
    except Exception as e:  # any failure of a foreign client is no price
        log.warning("no price of %s: %s", symbol, e)
        return None


def fear_and_greed(spark: SparkSession, body: str) -> DataFrame:
    """(ts, fear_greed) of {"data": [{"timestamp": seconds, "value": number}]}, both as text or number."""
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(F.from_json("body", "data array<struct<timestamp:string,value:string>>")["data"]).alias("d"))
    return rows.select(to_timestamp(F.col("d.timestamp")).alias("ts"), F.col("d.value").try_cast("double").alias("fear_greed")).orderBy("ts")


def total_value_locked(spark: SparkSession, body: str) -> DataFrame:
    """(ts, tvl) of [{"date": seconds, "tvl": number}]."""
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(F.from_json("body", "array<struct<date:string,tvl:double>>")).alias("d"))
    return rows.select(to_timestamp(F.col("d.date")).alias("ts"), F.col("d.tvl").alias("tvl")).orderBy("ts")


def stablecoin_supply(spark: SparkSession, body: str) -> DataFrame:
    """(ts, stablecoin_mcap) of [{"date": seconds, "totalCirculatingUSD": {peg: number}}], summed over the pegs."""
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(F.from_json("body", "array<struct<date:string,totalCirculatingUSD:map<string,double>>>")).alias("d"))
    total = F.aggregate(F.map_values("d.totalCirculatingUSD"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rows.select(to_timestamp(F.col("d.date")).alias("ts"), total.alias("stablecoin_mcap")).orderBy("ts")


def closed_bars(rows: DataFrame, now_ms: int) -> DataFrame:
    """Of text rows in the order of KLINES, with symbol: bars that have closed, as numbers; none without time or close."""
    closed = rows.where(F.col("close_time").try_cast("long") < now_ms)
    out = closed.select("symbol", to_timestamp(F.col("open_time")).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in MEASURES])
    return out.withColumn("trades", F.col("trades").cast("long")).na.drop(subset=["ts", "close"])


def synchronised(bars: DataFrame) -> DataFrame:
    """The bars up to the last ts that all symbols have reached: the least of their latest ones."""
    common = bars.groupBy("symbol").agg(F.max("ts").alias("_last")).agg(F.min("_last").alias("_common"))
    return bars.crossJoin(F.broadcast(common)).where(F.col("ts") <= F.col("_common")).drop("_common")  # one row


def collect_recent(
    spark: SparkSession, lake: Lake, bases: list[str], symbols: list[str], interval: str, now_ms: int, with_funding: bool = True, limit: int = 1000,
    get: Callable[[str], bytes | None] = http_get,
):
    """Upsert the tail of closed bars of all symbols, cut at the last bar that all have, and 45 days of funding up to it.
    Returns that bar's ts, or None where no base answers for some symbol; a symbol without a closed bar is an error."""
    rows, answered = [], {}
    for symbol in symbols:
        for base in bases:
            try:
                found = json.loads(get(f"{base}/klines?symbol={symbol}&interval={interval}&limit={limit}") or b"null")
            except (OSError, ValueError):
                continue
            if isinstance(found, list):
                rows += [(symbol, *[str(x) for x in r]) for r in found]
                answered[symbol] = base
                break
        else:
            log.warning("no base answers for %s", symbol)
            return None
    text = spark.createDataFrame(rows, ", ".join(["symbol string", *[f"`{c}` string" for c in KLINES]]))
    bars = closed_bars(text, now_ms)
    there = {r["symbol"] for r in bars.select("symbol").distinct().collect()}  # of the symbols asked for
    if set(symbols) - there:
        raise RuntimeError(f"no closed bars of {sorted(set(symbols) - there)}")
    bars = synchronised(bars).withColumn("interval", F.lit(interval))
    last = bars.agg(F.max("ts")).first()[0]
    lake.write(bars, "klines")
    if with_funding:
        since = int((last - timedelta(days=45) - _EPOCH).total_seconds() * 1000)
        rates = [(s, str(r["fundingTime"]), str(r["fundingRate"])) for s, base in answered.items() for r in json.loads(get(f"{base}/fundingRate?symbol={s}&startTime={since}&limit={limit}") or b"[]")]
        table = spark.createDataFrame(rates, "symbol string, at string, rate string").select("symbol", to_timestamp(F.col("at")).alias("ts"), F.col("rate").try_cast("double").alias("funding_rate")).na.drop()
        lake.write(table.where(F.col("ts") <= F.lit(str(last)).cast("timestamp_ntz")), "funding")
    return last
