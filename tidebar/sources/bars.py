"""Bars and event series built from tick tables. Timestamps carry no zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import by_symbol, ratio

BAR_SCHEMA = (
    "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, "
    "quote_volume double, trades long, taker_buy_base double"
)


def ticks_to_bars(ticks: DataFrame, order: list[str], **aggregates) -> DataFrame:
    """OHLC of ticks (symbol, ts, price) by symbol and ts, in the total order given; map-side combined, one shuffle."""
    key = F.struct(*order)
    return ticks.groupBy("symbol", "ts").agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        *[v.alias(k) for k, v in aggregates.items()],
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem: a symbol for each return flag, unit price as price, quantity as volume."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*order, "l_returnflag", "l_linestatus", "l_shipdate")
    ticks = t.select(
        *order,
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("symbol"),
        F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts"),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
    )
    return ticks_to_bars(
        ticks,
        order,
        volume=F.sum("l_quantity"),
        quote_volume=F.sum("l_extendedprice"),
        trades=F.count("*"),
        taker_buy_base=F.sum(F.when(F.col("status") == "F", F.col("l_quantity")).otherwise(0.0)),
    )


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events: a symbol for each event type."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = t.select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"))
    return ticks_to_bars(ticks, ["at", "event_id"], volume=F.count("*").cast("double"), quote_volume=F.sum("price"), trades=F.count("*"))


def hourly_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A funding event of each symbol at every bar of hour 0, 8 and 16: (average value - 100) / 1e6."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = t.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")
    return hour.where(F.hour("ts").isin(0, 8, 16)).groupBy("symbol", "ts").agg(((F.avg("value") - 100) / 1e6).alias("funding_rate"))


def open_interest(bars: DataFrame) -> DataFrame:
    """Every fifth bar of a symbol gives its volume as open interest."""
    numbered = bars.withColumn("n", F.row_number().over(by_symbol()))
    return numbered.where("n % 5 = 0").select("symbol", "ts", F.col("volume").alias("sum_open_interest"))
