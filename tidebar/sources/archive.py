"""Archives of bars, funding and positioning: zipped CSV files by month or day, fetched once and parsed by tasks."""

from __future__ import annotations

import io
import logging
import urllib.error
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterable
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.session import ship
from tidebar.sources.lake import SCHEMAS, Lake

log = logging.getLogger(__name__)

# The address, paths and column orders of the public archive.
BASE_URL = "https://data.binance.vision/data"
MARKETS = {"spot": "spot", "futures_um": "futures/um", "futures_cm": "futures/cm"}
KLINES = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore"]
FUNDING = ["calc_time", "funding_interval_hours", "last_funding_rate"]
METRICS = [
    "create_time", "symbol", "sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio",
    "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio",
]
#: Words of which a first line has one if it is a header.
HEADER_WORDS = ("open", "calc", "create")
MEASURES = [c for c in KLINES if c not in ("open_time", "close_time", "ignore")]


# Time


def to_timestamp(value: Column) -> Column:
    """The UTC time of an epoch in seconds, milliseconds, microseconds or nanoseconds, told apart by size row by row, or
    of a date and time in text; null for anything else."""
    number, text = value.try_cast("double"), value.try_cast("timestamp_ntz")
    micros = F.when(number > 1e17, number / 1e3).when(number > 1e14, number).when(number > 1e11, number * 1e3).otherwise(number * 1e6)
    return F.coalesce(F.timestamp_micros(F.floor(micros).cast("long")).cast("timestamp_ntz"), F.when(number.isNull(), text))


def _day(x: str | date | None, now: datetime) -> date:
    return now.date() if x is None else x if isinstance(x, date) and not isinstance(x, datetime) else datetime.fromisoformat(str(x)).date()


def month_range(start: str | date, end: str | date | None, now: datetime | None = None) -> list[tuple[int, int]]:
    """(year, month) from start to end; the month that is still open has no archive yet. An inverted range has none."""
    now = now or datetime.now(UTC)
    first, last = (12 * d.year + d.month - 1 for d in (_day(start, now), _day(end, now)))
    return [(m // 12, m % 12 + 1) for m in range(first, min(last, 12 * now.year + now.month - 2) + 1)]


def day_range(start: str | date, end: str | date | None, now: datetime | None = None) -> list[date]:
    """The days from start to end, or to yesterday: today's archive is still being written."""
    now = now or datetime.now(UTC)
    first, last = _day(start, now), min(_day(end, now), now.date() - timedelta(days=1))
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


# Addresses


def _market(market: str) -> str:
    if market not in MARKETS:
        raise ValueError(f"market must be one of {sorted(MARKETS)}")
    return f"{BASE_URL}/{MARKETS[market]}"


def kline_urls(market: str, symbol: str, interval: str, start: str, end: str | None = None, recent_days: bool = True, now: datetime | None = None) -> list[str]:
    """Monthly files, and daily ones of the month that is open."""
    now = now or datetime.now(UTC)
    base, name = _market(market), f"{symbol}-{interval}"
    urls = [f"{base}/monthly/klines/{symbol}/{interval}/{name}-{y:04d}-{m:02d}.zip" for y, m in month_range(start, end, now)]
    if recent_days:
        days = day_range(max(_day(start, now), now.date().replace(day=1)), end, now)
        urls += [f"{base}/daily/klines/{symbol}/{interval}/{name}-{d:%Y-%m-%d}.zip" for d in days]
    return urls


def funding_urls(market: str, symbol: str, start: str, end: str | None = None, now: datetime | None = None) -> list[str]:
    return [f"{_market(market)}/monthly/fundingRate/{symbol}/{symbol}-fundingRate-{y:04d}-{m:02d}.zip" for y, m in month_range(start, end, now)]


def metrics_urls(market: str, symbol: str, start: str, end: str | None = None, now: datetime | None = None) -> list[str]:
    return [f"{_market(market)}/daily/metrics/{symbol}/{symbol}-metrics-{d:%Y-%m-%d}.zip" for d in day_range(start, end, now)]


# Fetching and parsing


def http_get(url: str, timeout: int = 60) -> bytes | None:
    """The body; None for a 404."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
            return response.read()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


def fetch(url: str, cache: str, get: Callable[[str], bytes | None] = http_get) -> bytes | None:
    """The body of a URL from the cache folder (shared by all executors) or from the network, once: a 404 leaves a mark
    and is not asked for again. A network error is no answer (None) and leaves no mark; other HTTP errors are raised."""
    kept = Path(cache) / url.split("://", 1)[-1]
    missing = kept.with_name(kept.name + ".missing")
    if kept.exists():
        return kept.read_bytes()
    if missing.exists():
        return None
    try:
        body = get(url)
    except urllib.error.HTTPError:
        raise
    except OSError as e:
        log.warning("no answer from %s: %s", url, e)
        return None
    kept.parent.mkdir(parents=True, exist_ok=True)
    if body is None:
        missing.touch()
        return None
    part = kept.with_name(f"{kept.name}.{uuid.uuid4().hex}")
    part.write_bytes(body)
    part.replace(kept)
    return body


def unzip_csv(body: bytes, names: list[str]) -> pa.Table:
    """The first member of a zip as text columns. A header is told by its words; its names give way to the canonical ones
    where their number is the same. A short file lacks the last columns."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        raw = z.read(z.namelist()[0])
    first = raw.split(b"\n", 1)[0].decode("utf-8", "replace").strip()
    width = first.count(",") + 1
    headed = any(word in first.lower() for word in HEADER_WORDS)
    if headed and width != len(names):
        names = first.split(",")
    else:
        names = names[:width] + [f"_{i}" for i in range(len(names), width)]
    return pc.read_csv(
        io.BytesIO(raw), read_options=pc.ReadOptions(column_names=names, skip_rows=int(headed)),
        convert_options=pc.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True),
    )


def parsed(bodies: DataFrame, names: list[str], tasks: int = 8) -> DataFrame:
    """Rows of CSV text columns, with the path each came from. bodies has path and either content (bytes of a zip) or, to
    be fetched by the task, nothing else but `cache`. A file that does not parse is logged and skipped."""
    ship(bodies.sparkSession)
    by_url = "content" not in bodies.columns

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                body = fetch(row["path"], row["cache"]) if by_url else row["content"]
                if body is None:
                    continue
                try:
                    table = unzip_csv(bytes(body), names)
                except (zipfile.BadZipFile, pa.ArrowInvalid, IndexError) as e:
                    log.warning("%s does not parse: %s", row["path"], e)
                    continue
                columns = [table[n] if n in table.column_names else pa.nulls(len(table), pa.string()) for n in names]
                for part in pa.table([pa.array([row["path"]] * len(table), pa.string()), *columns], ["path", *names]).to_batches():
                    yield part

    dealt = bodies.repartition(tasks, "path") if by_url else bodies
    return dealt.mapInArrow(run, ", ".join(["path string", *[f"`{n}` string" for n in names]]))


def fetched(spark: SparkSession, urls: list[str], cache: str, names: list[str], workers: int = 8) -> DataFrame:
    """The rows of all URLs, by `workers` tasks."""
    return parsed(spark.createDataFrame([(u, cache) for u in urls], "path string, cache string"), names, workers)


def zipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the zip files below a folder that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the first by path, and by all columns where that ties."""
    w = Window.partitionBy(*keys).orderBy("path", *[c for c in rows.columns if c not in (*keys, "path")])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "path")


def _number(column: str) -> Column:
    return F.col(column).try_cast("double")


def clean_klines(rows: DataFrame, symbol: str) -> DataFrame:
    """Bars from text rows: bad numbers are null, rows without time or close go, one row for each ts."""
    out = rows.select(F.lit(symbol).alias("symbol"), to_timestamp(F.col("open_time")).alias("ts"), *[_number(c).alias(c) for c in MEASURES], "path")
    return _first(out.withColumn("trades", F.col("trades").cast("long")).na.drop(subset=["ts", "close"]), ["symbol", "ts"])


def clean_funding(rows: DataFrame, symbol: str) -> DataFrame:
    out = rows.select(F.lit(symbol).alias("symbol"), to_timestamp(F.col("calc_time")).alias("ts"), _number("last_funding_rate").alias("funding_rate"), "path")
    return _first(out.na.drop(subset=["ts", "funding_rate"]), ["symbol", "ts"])


def clean_metrics(rows: DataFrame, symbol: str) -> DataFrame:
    out = rows.select(F.lit(symbol).alias("symbol"), to_timestamp(F.col("create_time")).alias("ts"), *[_number(c).alias(c) for c in METRICS[2:]], "path")
    return _first(out.na.drop(subset=["ts"]), ["symbol", "ts"])


def klines(spark: SparkSession, cache: str, market: str, symbol: str, interval: str, start: str, end: str | None = None, recent_days: bool = True) -> DataFrame:
    return clean_klines(fetched(spark, kline_urls(market, symbol, interval, start, end, recent_days), cache, KLINES), symbol)


def funding(spark: SparkSession, cache: str, market: str, symbol: str, start: str, end: str | None = None) -> DataFrame:
    """Realised funding; a spot market has none."""
    if not market.startswith("futures"):
        return spark.createDataFrame([], SCHEMAS["funding"])
    return clean_funding(fetched(spark, funding_urls(market, symbol, start, end), cache, FUNDING), symbol)


def metrics(spark: SparkSession, cache: str, market: str, symbol: str, start: str, end: str | None = None) -> DataFrame:
    """Open interest and positioning; a spot market has none."""
    if not market.startswith("futures"):
        return spark.createDataFrame([], SCHEMAS["metrics"])
    return clean_metrics(fetched(spark, metrics_urls(market, symbol, start, end), cache, METRICS), symbol)


#: Metrics archives begin here.
METRICS_START = "2023-01-01"


def ingest(spark: SparkSession, lake: Lake, cache: str, market: str, symbols: list[str], interval: str, start: str, end: str | None = None, with_funding: bool = True, with_metrics: bool = False) -> Lake:
    """Fetch every symbol's data sets and upsert them into the lake."""
    _market(market)
    for symbol in symbols:
        lake.write(klines(spark, cache, market, symbol, interval, start, end).withColumn("interval", F.lit(interval)), "klines")
        if with_funding and market.startswith("futures"):
            lake.write(funding(spark, cache, market, symbol, start, end), "funding")
        if with_metrics and market.startswith("futures"):
            lake.write(metrics(spark, cache, market, symbol, max(start, METRICS_START), end), "metrics")
    return lake
