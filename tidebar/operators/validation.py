"""Splits and statistics that tell a strategy from luck. Series are keyed (by symbol or variant); a key's order is ts."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidebar.functions.columns import clip, ratio

KEYS = ("symbol",)
HOURS = 8760.0


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """The standard normal distribution; for aggregated rows, of which there are few."""
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The inverse of normal_cdf within 0 and 1; missing outside."""
    return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else math.nan, na_action="ignore").astype(float)


def numbered(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows with _i, the place within the key from 0, and _n, the key's number of rows."""
    own = Window.partitionBy(*keys)
    return rows.withColumns({"_i": F.row_number().over(own.orderBy("ts")) - 1, "_n": F.count("*").over(own)})


def part_of(place: Column, n: Column, parts: int) -> Column:
    """Which of `parts` contiguous runs a place is in; the first n mod parts of them are one longer."""
    base, more = F.floor(n / parts), F.pmod(n, F.lit(parts))
    long = more * (base + 1)
    return F.when(place < long, F.floor(place / (base + 1))).otherwise(more + F.floor(ratio(place - long, base))).cast("int")


# Splits


def purged_kfold(labels: DataFrame, n_splits: int = 5, embargo_pct: float = 0.01, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """labels (ts, t1) once for each fold of their key, with fold and role: test, train, purged (its life overlaps the
    fold's) or embargo (just behind the fold). A purged row that is in the embargo too is purged."""
    if "t1" not in labels.columns:
        raise ValueError("labels need t1, the end of each label")
    rows = numbered(labels, keys).withColumn("_own", part_of(F.col("_i"), F.col("_n"), n_splits))
    folds = rows.groupBy(*keys, F.col("_own").alias("fold")).agg(F.max("_i").alias("_last"), F.min("ts").alias("_begin"), F.max("t1").alias("_end"))
    both = rows.join(folds, list(keys)) if keys else rows.crossJoin(F.broadcast(folds))  # n_splits rows without keys
    embargo = F.floor(F.col("_n") * embargo_pct)
    role = (
        F.when(F.col("_own") == F.col("fold"), "test")
        .when((F.col("t1") > F.col("_begin")) & (F.col("ts") < F.col("_end")), "purged")
        .when((F.col("_i") > F.col("_last")) & (F.col("_i") <= F.col("_last") + embargo), "embargo")
        .otherwise("train")
    )
    return both.select(*labels.columns, "fold", role.alias("role"))


def walk_forward(rows: DataFrame, n_splits: int = 6, min_train: float = 0.3, expanding: bool = True, embargo: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows that each split trains on or tests, with split and role; splits test the future of what they train on."""
    first = F.floor(F.col("_n") * min_train)
    step = (F.col("_n") - first) / n_splits
    every = numbered(rows, keys).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    low, high = F.floor(first + F.col("split") * step), F.when(F.col("split") == n_splits - 1, F.col("_n")).otherwise(F.floor(first + (F.col("split") + 1) * step))
    every = every.withColumns({"_low": low, "_high": high, "_until": F.greatest(F.lit(0), low - embargo)})
    every = every.withColumn("_from", F.lit(0) if expanding else F.greatest(F.lit(0), F.col("_until") - first))
    every = every.where((F.col("_high") - F.col("_low") >= 2) & (F.col("_until") - F.col("_from") >= 2))
    role = F.when((F.col("_i") >= F.col("_low")) & (F.col("_i") < F.col("_high")), "test").when((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_until")), "train")
    return every.withColumn("role", role).where("role is not null").select(*rows.columns, "split", "role")


# Sharpe ratios and how far they are to be believed


def sharpe_moments(returns: DataFrame, column: str = "ret", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, mean, sd, var_pop, sharpe, skew, kurt): per-bar figures of each key, population moments, kurt not in
    excess. sharpe is null where there is no deviation."""
    x = F.col(column)
    a = returns.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.var_pop(x).alias("var_pop"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt")
    )
    return a.select(*keys, "n", "mean", "sd", "var_pop", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).alias("sharpe"), "skew", "kurt")


def _spread() -> Column:
    sharpe = F.col("sharpe")
    return 1 - F.col("skew") * sharpe + (F.col("kurt") - 1) / 4 * sharpe * sharpe


def probabilistic_sharpe(moments: DataFrame, benchmark: float | Column = 0.0, out: str = "psr") -> DataFrame:
    """moments with the probability that the true Sharpe ratio exceeds a benchmark; null below 30 returns."""
    benchmark = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    z = (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(_spread() > 0, _spread()))
    return moments.withColumn("_z", F.when(F.col("n") >= 30, z)).withColumn(out, normal_cdf("_z")).drop("_z")


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """The Sharpe ratio that the best of n_trials without any merit is expected to have."""
    if n_trials < 2 or variance <= 0:
        return 0.0
    euler, quantile = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - euler) * quantile(1 - 1 / n_trials) + euler * quantile(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(moments: DataFrame, n_trials: int, variance: float | None = None, trial_sharpes: list[float] | None = None) -> DataFrame:
    """moments with sr0, the bar that n_trials set, and dsr, the probability of being above it. The variance of the
    trials' Sharpe ratios is given, or theirs is taken, or at worst that of the mean return."""
    if variance is None and trial_sharpes is not None and len(trial_sharpes) > 1:
        centre = sum(trial_sharpes) / len(trial_sharpes)
        variance = sum((x - centre) ** 2 for x in trial_sharpes) / (len(trial_sharpes) - 1)
    known = F.lit(float(variance)) if variance is not None else F.col("var_pop") / F.col("n")
    bar = F.when(known > 0, F.sqrt(known) * expected_max_sharpe(n_trials, 1.0)).otherwise(0.0)
    judged = (F.col("n") >= 30) & (F.col("sd") > 0)
    out = moments.withColumns({"sr_variance": F.when(judged, known), "sr0": F.when(judged, bar), "n_trials": F.lit(n_trials)})
    return probabilistic_sharpe(out, F.col("sr0"), "dsr")


def min_track_record_length(moments: DataFrame, target: float = 0.0, confidence: float = 0.95, out: str = "min_track") -> DataFrame:
    """moments with the number of bars that make a Sharpe ratio above the target credible; infinite where it is not above."""
    z = NormalDist().inv_cdf(confidence)
    need = 1 + _spread() * F.pow(z / (F.col("sharpe") - target), F.lit(2))
    return moments.withColumn(out, F.when((F.col("n") >= 30) & (F.col("sd") > 0), F.when(F.col("sharpe") > target, need).otherwise(float("inf"))))


def column_sharpe(returns: DataFrame, column: str = "ret", key: str = "variant") -> DataFrame:
    """(key, sharpe) per bar, null without deviation."""
    return sharpe_moments(returns, column, (key,)).select(key, "sharpe")


# Probability of backtest overfitting


def cscv_splits(returns: DataFrame, s: int = 12, column: str = "ret", key: str = "variant") -> DataFrame:
    """(combo, best, is_sharpe, oos_sharpe, rank, logit): time is cut into s blocks, and for every choice of half of them
    (combo, a bit mask) the variant that is best inside is ranked outside.

    A bar that some variant lacks counts as 0 for it. The bars are read once: blocks are reduced to number, sum and sum
    of squares of each variant, and the choices, C(s, s / 2) of them, work on these alone. Below two variants no rows.
    """
    clean = returns.where(F.col(column).isNotNull())
    place = clean.select("ts").distinct()
    n = place.count()
    s = min(s, max(2, n // 20 * 2))
    s -= s % 2
    # Bars are few against variants * bars; their places need one ordered pass.
    place = place.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1).withColumn("block", part_of(F.col("_i"), F.lit(n), s))
    lengths = place.groupBy("block").agg(F.count("*").alias("bars"))
    variants = clean.select(key).distinct()
    sums = clean.join(place, "ts").groupBy(key, "block").agg(F.sum(column).alias("total"), F.sum(F.col(column) * F.col(column)).alias("squares"))
    whole = variants.crossJoin(F.broadcast(lengths)).join(sums, [key, "block"], "left").na.fill(0.0, ["total", "squares"])  # s rows are broadcast
    combos = returns.sparkSession.range(1 << s).where(F.bit_count("id") == s // 2).select(F.col("id").alias("combo"))
    inside = F.getbit("combo", F.col("block")) == 1
    both = whole.crossJoin(F.broadcast(combos)).groupBy("combo", key).agg(  # C(s, s / 2) rows are broadcast
        *[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(f"_{c}_{name}") for name, side in (("is", inside), ("oos", ~inside)) for c in ("bars", "total", "squares")]
    )

    def sharpe(name: str) -> Column:
        m, total, squares = (F.col(f"_{c}_{name}") for c in ("bars", "total", "squares"))
        variance = ratio(squares - ratio(total * total, m), m - 1)
        return F.when(variance > 0, ratio(total, m) / F.sqrt(variance))

    scored = both.select("combo", key, sharpe("is").alias("is_sharpe"), sharpe("oos").alias("oos_sharpe"))
    group = Window.partitionBy("combo")
    tied = F.count("*").over(Window.partitionBy("combo", "oos_sharpe"))
    rank = F.rank().over(group.orderBy(F.col("oos_sharpe").asc_nulls_first())) + (tied - 1) / 2
    ranked = scored.withColumns({"_n": F.count("*").over(group), "_rank": rank, "_best": F.row_number().over(group.orderBy(F.desc_nulls_last("is_sharpe"), key))})
    ranked = ranked.where((F.col("_best") == 1) & (F.col("_n") >= 2)).withColumn("rank", clip(F.col("_rank") / (F.col("_n") + 1), 1e-6, 1 - 1e-6))
    return ranked.select("combo", F.col(key).alias("best"), "is_sharpe", "oos_sharpe", "rank", F.ln(F.col("rank") / (1 - F.col("rank"))).alias("logit"))


def backtest_overfitting(splits: DataFrame) -> DataFrame:
    """One row from cscv_splits: pbo is the share of choices whose winner is in the lower half outside; null of none."""
    return splits.agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
        F.count("*").alias("n_splits"),
        F.expr("median(logit)").alias("median_logit"),
        F.avg("oos_sharpe").alias("oos_sharpe_mean"),
        F.avg("is_sharpe").alias("is_sharpe_mean"),
        F.when(F.count(F.col("is_sharpe") + F.col("oos_sharpe")) > 2, F.regr_slope("oos_sharpe", "is_sharpe")).alias("degradation_slope"),
        F.avg((F.coalesce("oos_sharpe", F.lit(0.0)) < 0).cast("double")).alias("prob_oos_loss"),
    )


# Resampling


def _unit(*what: Column | str) -> Column:
    """A number from 0 to 1 by hash: the same on any cluster and in any retry."""
    return F.pmod(F.xxhash64(*[F.lit(w) if isinstance(w, (int, str)) else w for w in what]), F.lit(1 << 53)) / float(1 << 53)


def stationary_bootstrap(returns: DataFrame, n_boot: int = 1000, mean_block: int = 48, seed: int = 0, column: str = "ret") -> DataFrame:
    """(rep, t, ret): n_boot resamples of one series in circular blocks of geometric length (mean_block on average). The
    draws are hashes of (seed, rep, t), and values are fetched by place, so nothing is collected or broadcast."""
    spark = returns.sparkSession
    series = returns.where(F.col(column).isNotNull())
    n = series.count()
    if not n:
        return spark.createDataFrame([], "rep long, t long, ret double")
    series = series.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1).cast("long").alias("_at"), F.col(column).alias("ret"))
    draws = spark.range(n_boot * n).select(F.floor(F.col("id") / n).alias("rep"), F.pmod("id", F.lit(n)).alias("t"))
    fresh = (F.col("t") == 0) | (_unit(seed, F.lit("cut"), F.col("rep"), F.col("t")) < 1 / mean_block)
    start = F.struct(F.floor(_unit(seed, F.lit("start"), F.col("rep"), F.col("t")) * n).alias("at"), F.col("t").alias("since"))
    block = F.last(F.when(fresh, start), ignorenulls=True).over(Window.partitionBy("rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return draws.withColumn("_b", block).select("rep", "t", F.pmod(F.col("_b.at") + F.col("t") - F.col("_b.since"), F.lit(n)).alias("_at")).join(series, "_at").select("rep", "t", "ret")


def bootstrap_sharpe_ci(returns: DataFrame, n_boot: int = 1000, mean_block: int = 48, alpha: float = 0.05, bars_per_year: float = HOURS, seed: int = 0, column: str = "ret") -> DataFrame:
    """One row: sharpe, ci_low, ci_high (annualised) and p_sharpe_le_0; null where nothing deviates."""
    year = math.sqrt(bars_per_year)
    drawn = sharpe_moments(stationary_bootstrap(returns, n_boot, mean_block, seed, column), "ret", ("rep",)).select((F.col("sharpe") * year).alias("s"))
    interval = drawn.agg(F.expr(f"percentile(s, {alpha / 2})").alias("ci_low"), F.expr(f"percentile(s, {1 - alpha / 2})").alias("ci_high"), F.avg((F.col("s") <= 0).cast("double")).alias("p_sharpe_le_0"))
    return sharpe_moments(returns, column).select((F.col("sharpe") * year).alias("sharpe")).crossJoin(F.broadcast(interval))  # one row each


def shuffle_test(returns_of: Callable[[DataFrame], DataFrame], signal: DataFrame, n: int = 200, seed: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row (real_sharpe, null_mean, null_p95, p_value): how often a signal dealt to the bars at random does as well.

    returns_of turns a signal with a column rep (0 is the real one) into (rep, ts, ret) in one plan. Each key's values
    are permuted by hash, so their distribution stays."""
    values = numbered(signal.select(*keys, "ts", "signal"), keys)
    reps = values.select(*keys, "ts", "_i", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("rep"))
    order = F.when(F.col("rep") == 0, F.col("_i").cast("double")).otherwise(_unit(seed, F.col("rep"), *[F.col(k) for k in keys], F.col("_i")))
    dealt = reps.withColumn("_i", F.row_number().over(Window.partitionBy("rep", *keys).orderBy(order, "ts")) - 1)
    shuffled = dealt.join(values.select(*keys, "_i", "signal"), [*keys, "_i"]).select("rep", *keys, "ts", "signal")
    found = sharpe_moments(returns_of(shuffled), "ret", ("rep",)).select("rep", "sharpe")
    real = found.where("rep = 0").select(F.col("sharpe").alias("real_sharpe"))
    null = found.where("rep > 0 and sharpe is not null").crossJoin(F.broadcast(real))  # one row
    return null.agg(F.first("real_sharpe").alias("real_sharpe"), F.avg("sharpe").alias("null_mean"), F.expr("percentile(sharpe, 0.95)").alias("null_p95"), F.avg((F.col("sharpe") >= F.col("real_sharpe")).cast("double")).alias("p_value"))


# Sanity


def leakage_check(features: DataFrame, future: DataFrame, threshold: float = 0.30, keys: tuple[str, ...] = (*KEYS, "ts"), target: str = "future_return") -> DataFrame:
    """(feature, abs_corr) of the features whose correlation with the future return exceeds the threshold: one pass for
    all of them, on the rows that both sides have."""
    names = [c for c in features.columns if c not in keys]
    both = features.join(future.select(*keys, target), list(keys))
    row = both.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target))).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("abs_corr")) for c in names]))
    found = row.select(pairs.alias("p")).select("p.*")
    return found.where(~F.isnan("abs_corr") & (F.col("abs_corr") > threshold)).orderBy(F.desc("abs_corr"), "feature")


def too_few_classes(labels: DataFrame, column: str = "bin", keys: tuple[str, ...] = KEYS, least: int = 2) -> DataFrame:
    """The keys whose labels have fewer than `least` different values: nothing can be learned from them."""
    return labels.groupBy(*keys).agg(F.countDistinct(column).alias("classes")).where(F.col("classes") < least)


def validation_report(returns: DataFrame, n_trials: int = 1, trial_sharpes: list[float] | None = None, bars_per_year: float = HOURS, column: str = "ret", n_boot: int = 500) -> DataFrame:
    """One row of the figures to look at before deploying; of a degenerate series sharpe_ann is null and note says so."""
    m = min_track_record_length(probabilistic_sharpe(deflated_sharpe(sharpe_moments(returns, column), n_trials, trial_sharpes=trial_sharpes), 0.0, "psr_vs_0"), out="min_track_record_bars")
    ci = bootstrap_sharpe_ci(returns, n_boot, bars_per_year=bars_per_year, column=column)
    usable = (F.col("n") >= 30) & F.coalesce(F.col("sd") > 0, F.lit(False))
    shown = {
        "sharpe_ann": F.col("ci.sharpe"), "sharpe_ci_low": F.col("ci.ci_low"), "sharpe_ci_high": F.col("ci.ci_high"), "p_sharpe_le_0": F.col("ci.p_sharpe_le_0"),
        "psr_vs_0": F.col("psr_vs_0"), "deflated_sharpe": F.col("dsr"), "haircut_sr0_ann": F.col("sr0") * math.sqrt(bars_per_year),
        "n_trials_assumed": F.lit(n_trials), "min_track_record_bars": F.col("min_track_record_bars"),
    }
    both = m.crossJoin(F.broadcast(ci.select(F.struct("*").alias("ci"))))  # one row each
    return both.select(*[F.when(usable, x).alias(c) for c, x in shown.items()], F.when(~usable, "degenerate return series").alias("note"))


def walk_forward_selection(returns: DataFrame, n_splits: int = 6, min_train: float = 0.3, key: str = "variant") -> DataFrame:
    """(split, chosen, ts, ret): each split's best variant by the Sharpe ratio of what it trains on, and its returns in
    what it tests, end to end out of sample. Ties go to the first variant by name."""
    roles = walk_forward(returns, n_splits, min_train, keys=(key,))
    trained = sharpe_moments(roles.where("role = 'train'"), "ret", ("split", key)).select("split", key, "sharpe")
    chosen = trained.groupBy("split").agg(F.min_by(key, F.struct(-F.coalesce("sharpe", F.lit(float("-inf"))), F.col(key))).alias(key))
    return roles.where("role = 'test'").join(chosen, ["split", key]).select("split", F.col(key).alias("chosen"), "ts", "ret")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
