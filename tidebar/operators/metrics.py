"""Performance of a return series: one row of figures from one aggregation and one ordered pass over the equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import frame, product, ratio

HOURS = 8760.0


def _in_order(*keys: str):
    """Windows over a whole series; the series of a book has a row for each bar, however many symbols there are."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("ts")


def drawdown(returns: DataFrame, column: str = "ret", keys: tuple[str, ...] = ()) -> DataFrame:
    """returns with equity and drawdown; a null return counts as 0, and the first bar's equity is the first peak."""
    w = _in_order(*keys)
    out = returns.withColumn("equity", product(1 + F.coalesce(F.col(column), F.lit(0.0)), w))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def rolling_sharpe(returns: DataFrame, window: int, bars_per_year: float = HOURS, column: str = "ret", keys: tuple[str, ...] = ()) -> DataFrame:
    w = frame(window, _in_order(*keys))
    sharpe = ratio(F.avg(column).over(w), F.stddev_samp(column).over(w)) * F.sqrt(F.lit(bars_per_year))
    return returns.withColumn("rolling_sharpe", F.when(F.count(column).over(w) >= window, sharpe))


def performance(returns: DataFrame, bars_per_year: float = HOURS, risk_free: float = 0.0, column: str = "ret", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row of figures (for each key); none where there is no return or no deviation. Columns turnover and gross,
    where they exist, add ann_turnover, gross_sharpe and cost_drag_sharpe."""
    clean = drawdown(returns.where(F.col(column).isNotNull()), column, keys)
    r, n, b = F.col(column), F.col("n_bars").cast("double"), F.lit(bars_per_year)
    more = [F.avg("turnover").alias("_turnover")] if "turnover" in returns.columns else []
    more += [F.avg("gross").alias("_gross"), F.stddev_samp("gross").alias("_gross_sd")] if "gross" in returns.columns else []
    a = clean.groupBy(*keys).agg(
        F.count(r).alias("n_bars"),
        F.product(1 + r).alias("_total"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_won"),
        F.sum(F.when(r < 0, r)).alias("_lost"),
        F.skewness(r).alias("_g1"),
        F.kurtosis(r).alias("_g2"),
        F.expr(f"percentile({column}, 0.95)").alias("_p95"),
        F.expr(f"percentile({column}, 0.05)").alias("_p05"),
        F.min(r).alias("worst_bar"),
        *more,
    )
    a = a.where((F.col("n_bars") > 0) & (F.col("_sd") > 0))
    years, mean, sd = n / b, F.col("_mean"), F.col("_sd")
    out = a.withColumns(
        {
            "years": years,
            "total_return": F.col("_total") - 1,
            "cagr": F.when(F.col("_total") > 0, F.pow(F.col("_total"), 1 / years) - 1),
            "ann_vol": sd * F.sqrt(b),
            "sharpe": (mean - risk_free / b) / sd * F.sqrt(b),
            "sortino": F.when(F.col("_down") > 0, mean / F.col("_down") * F.sqrt(b)),
            "profit_factor": ratio(F.col("_won"), F.abs("_lost")),
            "skew": F.when(n >= 3, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)),
            "tail_ratio": ratio(F.col("_p95"), F.abs("_p05")),
        }
    ).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))
    names = ["total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "profit_factor", "skew", "kurtosis", "tail_ratio", "worst_bar", "n_bars", "years"]
    if "turnover" in returns.columns:
        out, names = out.withColumn("ann_turnover", F.col("_turnover") * b), [*names, "ann_turnover"]
    if "gross" in returns.columns:
        out = out.withColumn("gross_sharpe", ratio(F.col("_gross"), F.col("_gross_sd")) * F.sqrt(b))
        out, names = out.withColumn("cost_drag_sharpe", F.col("gross_sharpe") - F.col("sharpe")), [*names, "gross_sharpe", "cost_drag_sharpe"]
    return out.select(*keys, *names)


def monthly(returns: DataFrame, column: str = "ret") -> DataFrame:
    """(year, month, ret): compounded by calendar month; a month between the first and the last without bars has 0."""
    by_month = returns.groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("m")).agg((F.product(1 + F.col(column)) - 1).alias("ret"))
    span = returns.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    months = span.where("a is not null").select(F.explode(F.expr("sequence(trunc(a, 'month'), trunc(b, 'month'), interval 1 month)")).alias("m"))
    return months.join(by_month, "m", "left").select(F.year("m").alias("year"), F.month("m").alias("month"), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_table(returns: DataFrame, column: str = "ret") -> DataFrame:
    """A row for each year, columns 1 to 12."""
    return monthly(returns, column).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def information_ratio(returns: DataFrame, benchmark: DataFrame, bars_per_year: float = HOURS) -> DataFrame:
    """One row: mean over deviation of the excess return, annualised; a bar without benchmark compares with 0."""
    both = returns.select("ts", "ret").join(benchmark.select("ts", F.col("ret").alias("other")), "ts", "left")
    excess = F.col("ret") - F.coalesce("other", F.lit(0.0))
    return both.agg((ratio(F.avg(excess), F.stddev_samp(excess)) * F.sqrt(F.lit(bars_per_year))).alias("information_ratio"))


