"""A lake of bars and event series: Parquet in folders by symbol (and interval), read by range, written by upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidebar.operators.joins import panel
from tidebar.session import shared_dir

#: Data sets that a lake knows, and their columns; others may be written too, and have no schema while they are empty.
SCHEMAS = {
    "klines": "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double, "
    "quote_volume double, trades long, taker_buy_base double, taker_buy_quote double",
    "funding": "symbol string, ts timestamp_ntz, funding_rate double",
    "metrics": "symbol string, ts timestamp_ntz, sum_open_interest double, sum_open_interest_value double, count_toptrader_long_short_ratio double, "
    "sum_toptrader_long_short_ratio double, count_long_short_ratio double, sum_taker_long_short_vol_ratio double",
}


def keep_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by the order columns, and by all others where those tie."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in (*order, *rest)])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


class Lake:
    """`<root>/<data set>/symbol=<s>[/interval=<i>]/*.parquet`. Symbols and intervals are strings, whatever they look like."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, dataset: str) -> str:
        return f"{self.root}/{dataset}"

    def _keys(self, columns: list[str]) -> list[str]:
        return [c for c in ("symbol", "interval") if c in columns]

    def _folder(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(conf), folder

    def exists(self, dataset: str) -> bool:
        files, folder = self._folder(self.path(dataset))
        return files.exists(folder)

    def write(self, rows: DataFrame, dataset: str, merge: bool = True) -> None:
        """Upsert rows (symbol, [interval,] ts, ...): of rows with equal keys and ts the new one stays, of new ones the
        greatest. Only the folders of the symbols written are read and replaced; the others are not touched. What is
        read is written beside them first, so a run that is cut off leaves the lake as it was or can be run again."""
        keys = self._keys(rows.columns)
        new = rows.withColumn("_new", F.lit(1))
        if merge and self.exists(dataset):
            old = self._read(dataset).join(F.broadcast(rows.select(*keys).distinct()), keys, "left_semi")  # keys: as many as folders
            new = old.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        staged = f"{shared_dir(self.spark)}/tidebar/lake-{uuid.uuid4().hex}"
        kept = keep_latest(new, [*keys, "ts"], ["_new"]).drop("_new")
        kept.repartition(*keys).sortWithinPartitions(*keys, "ts").write.option("compression", "zstd").parquet(staged)
        ready = self.spark.read.schema(kept.schema).parquet(staged)
        ready.sortWithinPartitions(*keys, "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(self.path(dataset))
        files, folder = self._folder(staged)
        files.delete(folder, True)

    def _read(self, dataset: str) -> DataFrame:
        """The whole data set; partition columns as strings. Columns come from the files, so sets can differ in them."""
        found = self.spark.read.option("mergeSchema", "true").parquet(self.path(dataset)).schema
        # Left alone, partition discovery takes an interval of 1d for the number 1.0.
        text = StructType([StructField(f.name, StringType()) if f.name in self._keys(found.names) else f for f in found.fields])
        return self.spark.read.schema(text).parquet(self.path(dataset))

    def read(self, dataset: str, symbols: str | list[str] | None = None, interval: str | None = None, start=None, end=None) -> DataFrame:
        """Rows with start <= ts <= end of the symbols (all without); one scan, pruned to their folders and pushed down to
        the range. A data set that is not there is an empty table."""
        if not self.exists(dataset):
            return self.spark.createDataFrame([], SCHEMAS.get(dataset, "symbol string, ts timestamp_ntz"))
        out = self._read(dataset)
        if symbols is not None:
            out = out.where(F.col("symbol").isin([symbols] if isinstance(symbols, str) else list(symbols)))
        if interval is not None and "interval" in out.columns:
            out = out.where(F.col("interval") == interval)
        for bound, low in ((start, True), (end, False)):
            if bound is not None:
                at = F.lit(str(bound)).cast("timestamp_ntz")
                out = out.where(F.col("ts") >= at if low else F.col("ts") <= at)
        return out

    def read_many(self, dataset: str, symbols: list[str], interval: str | None = None, start=None, end=None) -> dict[str, DataFrame]:
        """A view of one scan for each symbol."""
        whole = self.read(dataset, symbols, interval, start, end)
        return {s: whole.where(F.col("symbol") == s) for s in symbols}

    def panel(self, symbols: list[str], interval: str, field: str = "close", start=None, end=None) -> DataFrame:
        """A row for each ts of any symbol, a column for each symbol that has rows."""
        rows = self.read("klines", symbols, interval, start, end)
        there = {r["symbol"] for r in rows.select("symbol").distinct().collect()}  # of the symbols asked for
        return panel(rows, field, [s for s in symbols if s in there]).orderBy("ts")

    def sql(self, query: str) -> DataFrame:
        """A query over views named like the data sets. Data sets that do not exist are empty views."""
        files, root = self._folder(self.root)
        there = {f.getPath().getName() for f in files.listStatus(root) if f.isDirectory()} if files.exists(root) else set()
        for dataset in sorted(there | set(SCHEMAS)):
            if dataset.isidentifier():
                self.read(dataset).createOrReplaceTempView(dataset)
        return self.spark.sql(query)
