"""python -m tidebar.cli download | research | selftest | paper | forward: thin commands over the plans."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from tidebar.operators import signals
from tidebar.operators.meta import MetaLabel
from tidebar.plans import ledger, research
from tidebar.plans.config import Config, costs_from_config, load_config, risk_from_config, setup_logging
from tidebar.session import build_session
from tidebar.sources import archive, synthetic
from tidebar.sources.feeds import collect_recent
from tidebar.sources.lake import Lake
from tidebar.streaming.live import LiveRunner, PaperBroker

SWEEP = {"trend": (0.3, 0.5, 0.7), "cross": (0.0, 0.3), "carry": (0.0, 0.2, 0.4), "squash": (0.5, 1.0)}
# Where the exchange answers for its newest bars.
REST = {
    "spot": ["https://api.binance.com/api/v3"],
    "futures_um": ["https://fapi.binance.com/fapi/v1", *[f"https://fapi{i}.binance.com/fapi/v1" for i in (1, 2, 3)]],
    "futures_cm": ["https://dapi.binance.com/dapi/v1", *[f"https://dapi{i}.binance.com/dapi/v1" for i in (1, 2, 3)]],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidebar", description="Research on bars with Spark.")
    top.add_argument("--config")
    top.add_argument("-v", "--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    download = commands.add_parser("download", help="fetch archives into the lake")
    download.add_argument("--symbols", nargs="*")
    download.add_argument("--metrics", action="store_true", help="open interest and positioning too")
    download.add_argument("--no-funding", action="store_true")
    for name, text in (("research", "backtest and validate what the lake has"), ("selftest", "the same on synthetic bars")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--sweep", action="store_true")
        command.add_argument("--outdir", default="reports")
        command.add_argument("--ml", action="store_true", help="the meta-labelled model too")
        if name == "selftest":
            command.add_argument("--trend", type=float, default=0.0, help="0 has nothing to find")
            command.add_argument("--bars", type=int, default=17_000)
    paper = commands.add_parser("paper", help="decide on paper")
    paper.add_argument("--once", action="store_true")
    forward = commands.add_parser("forward", help="the forward ledger")
    forward.add_argument("action", choices=("init", "update", "verify"))
    forward.add_argument("--directory", default="forward_evidence")
    return top


def trend_carry_of(trend: float = 0.5, cross: float = 0.3, carry: float = 0.2, squash: float = 1.5) -> signals.Rule:
    return signals.rule(signals.trend_carry, squash=squash, weights=(trend, cross, carry))


def cmd_download(spark, config: Config, args) -> int:
    lake = Lake(spark, config.data_root)
    cache = str(Path(config.data_root) / "raw")
    symbols = args.symbols or config.get("data.symbols")
    archive.ingest(spark, lake, cache, config.get("data.market", "futures_um"), symbols, config.get("data.interval", "1h"), str(config.get("data.start")), config.get("data.end"), not args.no_funding, args.metrics)
    return 0


def cmd_research(spark, config: Config, args) -> int:
    risk, costs = risk_from_config(config), costs_from_config(config)
    if args.command == "selftest":
        features, bars, funding = synthetic.synthetic_dataset(spark, n=args.bars, trend_strength=args.trend)
    else:
        features, bars, funding = research.load_feature_data(spark, config)
    features, bars = features.cache(), bars.cache()  # read by every strategy
    benchmark = research.benchmark_book(bars, costs).cache()
    candidates: dict[str, signals.Strategy] = {"ma_crossover": signals.Rule("ma_crossover", lambda _: signals.ma_crossover(bars)), "trend_carry": trend_carry_of(), "adaptive_multifactor": signals.rule(signals.adaptive_multifactor)}
    trials, sweep = 1, None
    if args.sweep:
        sweep, table = research.parameter_sweep(trend_carry_of, research.grid_of(**SWEEP), features, bars, funding, risk, costs)
        sweep, table = sweep.cache(), table.cache()
        trials = table.count()
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{args.outdir}/sweep")
        print(research.print_report({"sweep": research.top_variants(table).select("variant", *SWEEP, "sharpe", "max_drawdown", "ann_turnover")}))
        best = research.best_variant(table).first()
        candidates["best_variant"] = trend_carry_of(**{k: best[k] for k in SWEEP})
    if args.ml:
        candidates["meta_label"] = MetaLabel(trend_carry_of())
    for name, strategy in candidates.items():
        book = research.evaluate(strategy, features, bars, funding, risk, costs, initial=float(config.get("backtest.initial_equity", 10_000)))[0].cache()
        sections = research.full_report(book, risk.bars_per_year, trials if name in ("best_variant", "meta_label") else 1, sweep if name == "best_variant" else None, benchmark)
        print(f"\n{name}{research.print_report(sections)}")
        research.write_report(book, f"{args.outdir}/{name}", sections, risk.bars_per_year)
    return 0


def cmd_paper(spark, config: Config, args) -> int:
    weights = research.live_signal(signals.rule(signals.trend_carry), risk_from_config(config))
    runner = LiveRunner(spark, PaperBroker(Lake(spark, config.data_root)), weights, list(config.get("data.symbols")), f"{config.data_root}/live", config.get("data.interval", "1h"), risk_from_config(config))
    print(json.dumps(runner.step(), default=str) if args.once else json.dumps(runner.run(float(config.get("live.poll_seconds", 60))), default=str))
    return 0


def cmd_forward(spark, config: Config, args) -> int:
    if args.action == "verify":
        value = ledger.verify(args.directory)
    else:
        symbols, interval, market = list(config.get("data.symbols")), config.get("data.interval", "1h"), config.get("data.market", "futures_um")
        if args.action == "update":
            lake = Lake(spark, config.data_root)
            collect_recent(spark, lake, REST[market], symbols, interval, int(time.time() * 1000), market.startswith("futures"))
        features, bars, funding = research.load_feature_data(spark, config)
        if args.action == "init":
            value = ledger.initialise(args.directory, bars.agg(F.max("ts")).first()[0], "adaptive_multifactor", signals.__file__, config.path, symbols, interval)
        else:
            book, weights = research.evaluate(signals.rule(signals.adaptive_multifactor), features, bars, funding, risk_from_config(config), costs_from_config(config))
            value = ledger.append_snapshot(args.directory, book, weights)
    print(json.dumps(value, indent=2, default=str))
    return 0


COMMANDS = {"download": cmd_download, "research": cmd_research, "selftest": cmd_research, "paper": cmd_paper, "forward": cmd_forward}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    config = load_config(args.config)
    spark = spark or build_session()
    setup_logging(spark, args.verbose)
    return COMMANDS[args.command](spark, config, args)


if __name__ == "__main__":
    sys.exit(main())
