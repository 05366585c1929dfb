"""Event labels: barriers, how labels overlap, and the sample weights that follow from it. All by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import by_symbol, carried, lag, log, ratio, so_far
from tidebar.operators.kernels import ewm

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def daily_vol(bars: DataFrame, span: int = 100, bars_per_day: int = 24, out: str = "daily_vol") -> DataFrame:
    """bars with the exponentially weighted deviation of the return over a day."""
    moved = bars.withColumn("_day", ratio(F.col("close"), lag("close", bars_per_day)) - 1)
    return ewm(moved, {out: {"column": "_day", "stat": "std", "span": span, "min_periods": span // 2}}).drop("_day")


def vertical_barriers(bars: DataFrame, num_bars: int) -> DataFrame:
    """bars with t1: the ts num_bars later, the symbol's last one at most."""
    w = by_symbol()
    return bars.withColumn("t1", F.coalesce(F.lead("ts", num_bars).over(w), F.last("ts").over(w.rowsBetween(*_ALL))))


def triple_barrier(
    bars: DataFrame, event: str, target: str, profit: float = 2.0, stop: float = 1.0, min_target: float = 0.001, num_bars: int = 24, side: str | None = None
) -> DataFrame:
    """(symbol, ts, t1, ret, bin, trgt, side) of the bars where `event` holds: the first bar within num_bars that leaves the
    barriers, or the last. The path is a window of num_bars structs, so no join is needed. A null target takes that of
    the event before. Events on a symbol's last bar and those whose target is not above min_target have no label. With a
    side, returns are those of the bet (a null side is no bet), and bin says whether it won; else bin is the sign."""
    w = by_symbol()
    path = F.collect_list(F.struct("ts", F.col("close").alias("price"))).over(w.rowsBetween(1, num_bars))
    bet = F.coalesce(F.col(side).cast("double"), F.lit(0.0)) if side else F.lit(1.0)
    out = bars.withColumns({"_path": path, "_side": bet}).where(F.col(event))
    out = out.withColumn("trgt", carried(F.col(target))).where((F.col("trgt") > min_target) & (F.size("_path") > 0))
    out = out.withColumn("_path", F.transform("_path", lambda x: F.struct(x["ts"].alias("t1"), ((ratio(x["price"], F.col("close")) - 1) * F.col("_side")).alias("ret"))))
    hits = F.filter("_path", lambda x: (x["ret"] > profit * F.col("trgt")) | (x["ret"] < -stop * F.col("trgt")))
    out = out.withColumn("_end", F.coalesce(F.get(hits, F.lit(0)), F.element_at("_path", -1)))
    won = (F.col("_end.ret") > 0).cast("int") if side else F.signum("_end.ret").cast("int")
    return out.select("symbol", "ts", "_end.t1", "_end.ret", won.alias("bin"), "trgt", F.col("_side").alias("side"))


def concurrency(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """(symbol, ts, concurrent): labels that are open at each bar, from running sums of starts and ends."""
    starts = labels.groupBy("symbol", "ts").agg(F.count("*").alias("_in"))
    ends = labels.groupBy("symbol", F.col("t1").alias("ts")).agg(F.count("*").alias("_out"))
    out = bars.select("symbol", "ts").join(starts, ["symbol", "ts"], "left").join(ends, ["symbol", "ts"], "left").na.fill(0, ["_in", "_out"])
    before = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.sum("_in").over(so_far()) - F.coalesce(F.sum("_out").over(before), F.lit(0))
    return out.select("symbol", "ts", open_.alias("concurrent"))


def _over_life(bars: DataFrame, labels: DataFrame, value: Column) -> DataFrame:
    """labels with _sum and _n: the sum and the number of a value of each bar (of close and concurrent) from ts to t1."""
    known = concurrency(bars, labels).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    known = known.withColumn("_ret", log(F.col("close")) - lag(log(F.col("close")))).withColumn("_value", value)
    until = Window.unboundedPreceding, -1
    sums = known.select(
        "symbol", "ts",
        F.coalesce(F.sum("_value").over(so_far()), F.lit(0.0)).alias("_s1"), F.count("_value").over(so_far()).alias("_n1"),
        F.coalesce(F.sum("_value").over(by_symbol().rowsBetween(*until)), F.lit(0.0)).alias("_s0"), F.count("_value").over(by_symbol().rowsBetween(*until)).alias("_n0"),
    )
    begin, end = sums.select("symbol", "ts", "_s0", "_n0"), sums.select("symbol", F.col("ts").alias("t1"), "_s1", "_n1")
    both = labels.join(begin, ["symbol", "ts"]).join(end, ["symbol", "t1"])
    return both.select(*labels.columns, (F.col("_s1") - F.col("_s0")).alias("_sum"), (F.col("_n1") - F.col("_n0")).alias("_n"))


def sample_uniqueness(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with uniqueness: one over the number of open labels, averaged over the label's life."""
    out = _over_life(bars, labels, ratio(F.lit(1.0), F.col("concurrent")))
    return out.select(*labels.columns, F.coalesce(ratio(F.col("_sum"), F.col("_n")), F.lit(0.0)).alias("uniqueness"))


def return_weights(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with weight: the log return of the label's life, each bar's shared among the open labels, relative to the
    symbol's mean."""
    out = _over_life(bars, labels, ratio(F.col("_ret"), F.col("concurrent"))).withColumn("_w", F.abs("_sum"))
    mean = F.avg("_w").over(Window.partitionBy("symbol"))
    return out.select(*labels.columns, F.when(mean > 0, F.col("_w") / mean).otherwise(F.col("_w")).alias("weight"))


def time_decay(weighted: DataFrame, column: str = "uniqueness", last_weight: float = 0.5, out: str = "decay") -> DataFrame:
    """weighted with a factor that falls linearly in cumulated uniqueness: 1 for the newest label, last_weight (or, below
    zero, nothing for the oldest share) for the oldest; uniqueness itself where all of it is 0."""
    cumulated = F.sum(column).over(so_far())
    whole = F.sum(column).over(Window.partitionBy("symbol"))
    slope = ratio(F.lit(1.0 - last_weight), whole) if last_weight >= 0 else ratio(F.lit(1.0), (last_weight + 1) * whole)
    factor = F.greatest(F.lit(0.0), 1 - slope * whole + slope * cumulated)
    return weighted.withColumn(out, F.when(whole == 0, F.col(column)).otherwise(factor))
