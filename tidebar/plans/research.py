"""From the lake to a verdict: features, signal, sizing, backtest, sweep and report, each a DataFrame plan."""

from __future__ import annotations

import itertools
import logging
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators.backtest import Costs, buy_and_hold, run_backtest, with_equity
from tidebar.operators.features import build_features
from tidebar.operators.kernels import turnover_buffer
from tidebar.operators.metrics import drawdown, information_ratio, monthly_table, performance, rolling_sharpe
from tidebar.operators.risk import RiskConfig, vol_target_weights
from tidebar.operators.signals import Strategy
from tidebar.operators.validation import backtest_overfitting, cscv_splits, union_all, validation_report
from tidebar.plans.config import Config
from tidebar.sources.lake import Lake
from tidebar.sources.synthetic import funding_by_bar

log = logging.getLogger(__name__)

HOURS_OF = {"1m": 1 / 60, "5m": 1 / 12, "15m": 0.25, "30m": 0.5, "1h": 1.0, "2h": 2.0, "4h": 4.0, "8h": 8.0, "1d": 24.0}
BUFFER = 0.1


def load_feature_data(spark: SparkSession, config: Config, symbols: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, bars, funding by bar) of the symbols in one plan. A symbol without bars is warned of; none at all is an
    error. Eight-hourly funding is spread over its bars; a bar longer than that carries one rate."""
    lake = Lake(spark, config.data_root)
    symbols, interval = list(symbols or config.get("data.symbols")), config.get("data.interval", "1h")
    bars = lake.read("klines", symbols, interval).drop("interval")
    there = {r["symbol"] for r in bars.select("symbol").distinct().collect()}  # of the symbols asked for
    for symbol in sorted(set(symbols) - there):
        log.warning("no bars of %s in the lake", symbol)
    if not there:
        raise RuntimeError("the lake has no bars of any symbol: download first")
    rates, positions = lake.read("funding", symbols), lake.read("metrics", symbols)
    features = build_features(bars, rates if lake.exists("funding") else None, positions if lake.exists("metrics") else None)
    per_funding = max(int(8 / HOURS_OF[interval]), 1)
    funding = funding_by_bar(features, per_funding) if "funding" in features.columns else features.select("symbol", "ts", F.lit(0.0).alias("funding_rate"))
    return features, bars, funding


def sized(bars: DataFrame, signal: DataFrame, risk: RiskConfig, buffer: float = BUFFER, books: tuple[str, ...] = ()) -> DataFrame:
    """Weights of a signal: volatility target, caps, then the no-trade band."""
    weights = vol_target_weights(bars, signal, risk, books=books)
    if not buffer:
        return weights
    return turnover_buffer(weights, "weight", "_held", buffer, keys=("symbol", *books)).withColumn("weight", F.col("_held")).drop("_held")


def evaluate(
    strategy: Strategy, features: DataFrame, bars: DataFrame, funding: DataFrame | None = None, risk: RiskConfig = RiskConfig(), costs: Costs = Costs(), buffer: float = BUFFER,
    fit: bool = True, initial: float = 10_000.0, **how,
) -> tuple[DataFrame, DataFrame]:
    """(book with equity, weights) of a strategy: fit, signal, size, backtest."""
    if fit:
        strategy.fit(features)
    weights = sized(bars, strategy.signal(features, **how), risk, buffer)
    book = run_backtest(bars, weights, costs, funding, max_gross=risk.max_gross_leverage)
    return with_equity(book, initial), weights


def live_signal(strategy: Strategy, risk: RiskConfig = RiskConfig(), buffer: float = BUFFER) -> Callable[[DataFrame], DataFrame]:
    """Weights from fresh bars, by the very functions that evaluation uses."""
    return lambda bars: sized(bars, strategy.signal(build_features(bars)), risk, buffer)


def variant_name(i: int) -> str:
    return f"v{i:03d}"


def parameter_sweep(
    factory: Callable[..., Strategy], grid: list[dict], features: DataFrame, bars: DataFrame, funding: DataFrame | None = None, risk: RiskConfig = RiskConfig(), costs: Costs = Costs(),
    buffer: float = BUFFER,
) -> tuple[DataFrame, DataFrame]:
    """(returns (variant, ts, ret, ...), table (variant, parameters, performance)) of every combination that can be built:
    all variants are books of one backtest, so bars are read and sized once. One that fails is skipped with a warning."""
    signals, parameters = [], []
    for i, chosen in enumerate(grid):
        try:
            found = factory(**chosen).fit(features).signal(features)
        except Exception as e:  # whatever a strategy raises
            log.warning("variant %s failed: %s", variant_name(i), e)
            continue
        signals.append(found.select(F.lit(variant_name(i)).alias("variant"), "symbol", "ts", "signal"))
        parameters.append({"variant": variant_name(i)} | {k: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in chosen.items()})
    if not signals:
        raise ValueError("no variant could be built")
    weights = sized(bars, union_all(signals), risk, buffer, ("variant",))
    returns = run_backtest(bars, weights, costs, funding, max_gross=risk.max_gross_leverage, books=("variant",))
    named = features.sparkSession.createDataFrame([tuple(p.values()) for p in parameters], list(parameters[0]))
    table = performance(returns, risk.bars_per_year, keys=("variant",))
    return returns, named.join(table, "variant", "left")


def top_variants(table: DataFrame, n: int = 10, by: str = "sharpe") -> DataFrame:
    """The n best variants; equal ones by name."""
    return table.orderBy(F.desc_nulls_last(by), "variant").limit(n)


def best_variant(table: DataFrame, by: str = "sharpe") -> DataFrame:
    return top_variants(table, 1, by)


def grid_of(**values) -> list[dict]:
    """Every combination of the values of each parameter."""
    return [dict(zip(values, chosen, strict=True)) for chosen in itertools.product(*values.values())]


def full_report(book: DataFrame, bars_per_year: float = 8760.0, n_trials: int = 1, sweep: DataFrame | None = None, benchmark: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections that decide, each a DataFrame: performance, validation, monthly, and pbo, benchmark and
    information_ratio where there is a sweep or a benchmark."""
    out = {"performance": performance(book, bars_per_year), "validation": validation_report(book, n_trials, bars_per_year=bars_per_year), "monthly": monthly_table(book)}
    if sweep is not None:
        out["pbo"] = backtest_overfitting(cscv_splits(sweep))
    if benchmark is not None:
        out["benchmark"] = performance(benchmark, bars_per_year)
        out["information_ratio"] = information_ratio(book, benchmark, bars_per_year)
    return out


def print_report(sections: dict[str, DataFrame]) -> str:
    """The sections as text; a section has a few rows."""
    lines = []
    for name, frame in sections.items():
        rows = frame.limit(100).collect()
        lines.append(f"\n{name}")
        for row in rows:
            lines += [f"  {k:<24} {v:.4f}" if isinstance(v, float) else f"  {k:<24} {v}" for k, v in row.asDict().items()] if len(rows) == 1 else ["  " + "  ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in row)]
    return "\n".join(lines)


def report_series(book: DataFrame, bars_per_year: float = 8760.0, window: int = 24 * 90) -> DataFrame:
    """(ts, equity from 1, drawdown, rolling_sharpe): the three curves of a report."""
    return rolling_sharpe(drawdown(book.select("ts", "ret")), window, bars_per_year).select("ts", "equity", "drawdown", "rolling_sharpe")


def write_report(book: DataFrame, path: str, sections: dict[str, DataFrame], bars_per_year: float = 8760.0) -> None:
    """Each section as JSON and the curves as CSV below a path; a chart too where matplotlib is there and the path local."""
    for name, frame in sections.items():
        frame.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    series = report_series(book, bars_per_year)
    series.coalesce(1).sortWithinPartitions("ts").write.mode("overwrite").option("header", True).csv(f"{path}/series")
    if "://" not in path:
        plot_report(series, f"{path}/report.png")


def plot_report(series: DataFrame, path: str) -> bool:
    """Equity (log), drawdown and rolling Sharpe in one picture, a point a day at most; False without matplotlib."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        log.warning("no chart: matplotlib is not there")
        return False
    daily = series.groupBy(F.to_date("ts").alias("day")).agg(*[F.max_by(c, "ts").alias(c) for c in ("equity", "drawdown", "rolling_sharpe")]).orderBy("day").toPandas()  # days of one book
    figure, axes = plt.subplots(3, 1, figsize=(10, 9), sharex=True)
    for axis, name in zip(axes, ("equity", "drawdown", "rolling_sharpe"), strict=True):
        axis.plot(daily["day"], daily[name])
        axis.set_title(name)
    axes[0].set_yscale("log")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    figure.savefig(path)
    plt.close(figure)
    return True


def write_state(state: str, path: str) -> None:
    """Replace a small state file as a whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(state)
    os.replace(part, path)


def benchmark_book(bars: DataFrame, costs: Costs = Costs(), initial: float = 10_000.0) -> DataFrame:
    """Equal weights, held throughout."""
    return with_equity(run_backtest(bars, buy_and_hold(bars), costs), initial)
