"""Meta-labelling: a primary signal proposes bets, and a model learns which of them to take, judged out of sample.

The model is a weighted ridge logistic regression in numpy, one task for each symbol and fold; any learner with the same
two functions can take its place. Labels, weights, purging, scoring and positions are DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Self

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import by_symbol, clip, lag, log, so_far
from tidebar.operators.kernels import cusum_events
from tidebar.operators.labels import daily_vol, sample_uniqueness, time_decay, triple_barrier
from tidebar.operators.signals import Strategy
from tidebar.operators.validation import purged_kfold, too_few_classes
from tidebar.session import ship

OUT = ("symbol", "ts", "t1", "side", "bin", "weight")


def meta_dataset(features: DataFrame, primary: DataFrame, cusum_mult: float = 1.0, profit: float = 2.0, stop: float = 1.0, horizon: int = 24, min_events: int = 250) -> DataFrame:
    """(symbol, ts, t1, side, bin, weight, features): CUSUM events where the primary signal takes a side, labelled by
    whether the bet won, weighted by uniqueness and recency. Symbols with few events or one outcome have none; rows
    with a fifth of their features null or more neither, and the other nulls are 0."""
    names = [c for c in features.columns if c not in ("symbol", "ts", "close")]
    bars = daily_vol(features.where("close is not null").select("symbol", "ts", "close"))
    median = F.expr("median(daily_vol)").over(Window.partitionBy("symbol"))
    bars = bars.withColumns({"_ret": log(F.col("close")) - lag(log(F.col("close"))), "_bar": F.coalesce(cusum_mult * F.col("daily_vol"), median)})
    bars = cusum_events(bars, "_ret", "_bar", "_event").join(primary.select("symbol", "ts", "signal"), ["symbol", "ts"], "left")
    bars = bars.withColumn("_events", F.sum(F.abs("_event")).over(Window.partitionBy("symbol")))
    bars = bars.withColumns({"_side": F.nullif(F.signum("signal"), F.lit(0.0)), "_bet": (F.col("_event") != 0) & (F.col("_events") >= min_events)})
    bars = bars.withColumn("_bet", F.col("_bet") & F.col("_side").isNotNull())
    labels = triple_barrier(bars, "_bet", "daily_vol", profit, stop, num_bars=horizon, side="_side")
    labels = labels.join(too_few_classes(labels), "symbol", "left_anti")
    known = labels.join(features.select("symbol", "ts", *names), ["symbol", "ts"]).join(primary.select("symbol", "ts", F.abs("signal").alias("primary_strength")), ["symbol", "ts"])
    known = known.withColumn("primary_side", F.col("side"))
    every = [*names, "primary_side", "primary_strength"]
    there = F.size(F.filter(F.array(*[F.col(c).cast("double") for c in every]), lambda x: x.isNotNull()))
    kept = known.where(there / len(every) > 0.8).na.fill(0.0, every)
    weighted = time_decay(sample_uniqueness(bars, kept), last_weight=0.6).withColumn("weight", F.col("uniqueness") * F.col("decay"))
    return weighted.select(*OUT, *every)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 5.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, coefficients with the intercept last) by Newton steps on standardised columns."""
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.clip((x - centre) / scale, -10, 10), np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta


def predict_logistic(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.clip((x - centre) / scale, -10, 10) @ beta[:-1] + beta[-1], -30, 30)))


def out_of_sample(dataset: DataFrame, n_splits: int = 6, embargo_pct: float = 0.01, least_train: int = 250, least_test: int = 20) -> DataFrame:
    """(symbol, ts, t1, side, proba): each event scored by the model of the fold that leaves it, and all labels that
    overlap it, out; null where a fold has too few rows or one class to learn from."""
    ship(dataset.sparkSession)
    names = [c for c in dataset.columns if c not in OUT]

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        train, test = rows[rows["role"] == "train"], rows[rows["role"] == "test"].copy()
        test["proba"] = np.nan
        if len(train) >= least_train and len(test) >= least_test and train["bin"].nunique() > 1:
            model = fit_logistic(train[names].to_numpy(float), train["bin"].to_numpy(float), train["weight"].to_numpy(float))
            test["proba"] = predict_logistic(test[names].to_numpy(float), *model)
        return test[["symbol", "ts", "t1", "side", "proba"]]

    roles = purged_kfold(dataset, n_splits, embargo_pct).where(F.col("role").isin("train", "test"))
    found = roles.groupBy("symbol", "fold").applyInPandas(scored, "symbol string, ts timestamp_ntz, t1 timestamp_ntz, side double, proba double")
    return found.withColumn("proba", F.nanvl("proba", F.lit(None).cast("double")))


def full_models(dataset: DataFrame) -> DataFrame:
    """(symbol, feature, centre, scale, coefficient): a model of each symbol's whole sample, for live use only; the
    intercept is the feature named ''."""
    ship(dataset.sparkSession)
    names = [c for c in dataset.columns if c not in OUT]

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        centre, scale, beta = fit_logistic(rows[names].to_numpy(float), rows["bin"].to_numpy(float), rows["weight"].to_numpy(float))
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "feature": [*names, ""], "centre": [*centre, 0.0], "scale": [*scale, 1.0], "coefficient": beta})

    return dataset.groupBy("symbol").applyInPandas(fitted, "symbol string, feature string, centre double, scale double, coefficient double")


def feature_importance(models: DataFrame) -> DataFrame:
    """(feature, gain): the size of each standardised coefficient, averaged over symbols, greatest first."""
    return models.where("feature <> ''").groupBy("feature").agg(F.avg(F.abs("coefficient")).alias("gain")).orderBy(F.desc("gain"), "feature")


def live_scores(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(symbol, ts, t1, side, proba) of rows with a model; a feature that rows lack, or has null, counts as 0."""
    names = [c for c in rows.columns if c not in OUT]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("x")) for c in names], F.struct(F.lit("").alias("feature"), F.lit(1.0).alias("x"))))
    long = rows.select("symbol", "ts", "t1", "side", pairs.alias("p")).select("symbol", "ts", "t1", "side", "p.*").join(models, ["symbol", "feature"])
    share = F.when(F.col("feature") == "", F.col("coefficient")).otherwise(clip((F.col("x") - F.col("centre")) / F.col("scale"), -10.0, 10.0) * F.col("coefficient"))
    total = long.groupBy("symbol", "ts", "t1", "side").agg(F.sum(share).alias("_z"))
    return total.select("symbol", "ts", "t1", "side", (1 / (1 + F.exp(-clip(F.col("_z"), -30.0, 30.0)))).alias("proba"))


def size_of(proba, threshold: float = 0.52):
    """0 at the threshold, 1 at certainty."""
    return clip((proba - threshold) / (1 - threshold), 0.0, 1.0)


def held_positions(calendar: DataFrame, bets: DataFrame) -> DataFrame:
    """(symbol, ts, signal) on the calendar: a bet (symbol, ts, t1, side, size) is held from its bar to its exit, unless a
    newer one takes its place; a bet without size or exit is none."""
    own = bets.where("size is not null and t1 is not null").select("symbol", "ts", F.struct((F.col("side") * F.col("size")).alias("value"), "t1").alias("_bet"))
    out = calendar.select("symbol", "ts").join(own, ["symbol", "ts"], "left")
    now = F.last("_bet", ignorenulls=True).over(so_far(by_symbol()))
    out = out.withColumn("_now", now)
    return out.select("symbol", "ts", F.coalesce(F.when(F.col("ts") <= F.col("_now.t1"), F.col("_now.value")), F.lit(0.0)).alias("signal"))


@dataclass
class MetaLabel:
    """The strategy: fit learns from features, signal holds the bets that the out-of-sample model takes (the only ones a
    backtest may use) or, with use_oos=False, those of the live model."""

    primary: Strategy
    threshold: float = 0.52
    n_splits: int = 6
    embargo_pct: float = 0.01
    min_events: int = 250
    name: str = "meta_label"
    events: DataFrame | None = field(default=None, init=False)
    models: DataFrame | None = field(default=None, init=False)
    dataset: DataFrame | None = field(default=None, init=False)

    def fit(self, features: DataFrame) -> Self:
        self.primary.fit(features)
        self.dataset = meta_dataset(features, self.primary.signal(features), min_events=self.min_events).cache()
        self.events = out_of_sample(self.dataset, self.n_splits, self.embargo_pct, min(250, self.min_events))
        self.models = full_models(self.dataset)
        return self

    def signal(self, features: DataFrame, use_oos: bool = True) -> DataFrame:
        if self.events is None:
            raise RuntimeError("fit comes first")
        scored = self.events if use_oos else live_scores(self.dataset, self.models)
        return held_positions(features, scored.withColumn("size", size_of(F.col("proba"), self.threshold)))
