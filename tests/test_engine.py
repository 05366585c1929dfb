"""Operators that SQL cannot express, against plain loops, round trips and properties."""

import hashlib
import io
import json
import math
import urllib.error
import zipfile
from datetime import UTC, date, datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar import cli
from tidebar.operators import validation as V
from tidebar.operators.backtest import Costs, run_backtest
from tidebar.operators.kernels import turnover_buffer
from tidebar.operators.labels import triple_barrier
from tidebar.operators.meta import MetaLabel, held_positions
from tidebar.operators.risk import RiskConfig, kill_switch
from tidebar.operators.signals import adaptive_raw, ma_crossover, rule, trend_carry
from tidebar.plans import ledger, research
from tidebar.plans.config import Config, costs_from_config, load_config, risk_from_config
from tidebar.sources import archive, feeds
from tidebar.sources.lake import Lake
from tidebar.sources.synthetic import synthetic_bars, synthetic_dataset, synthetic_universe
from tidebar.streaming import live

BASE = datetime(2024, 1, 1)


def hours(*values):
    return [(BASE + timedelta(hours=i), v) for i, v in enumerate(values)]


def bars(spark, closes, symbol="X"):
    return spark.createDataFrame([(symbol, t, c) for t, c in hours(*closes)], "symbol string, ts timestamp_ntz, close double")


@pytest.fixture(scope="module")
def market(spark):
    features, rows, funding = synthetic_dataset(spark, ("A", "B"), n=1200, seed=11, trend_strength=0.05)
    return features.cache(), rows.cache(), funding.cache()


# Labels


def test_triple_barrier_needs_more_than_the_least_target(spark):
    rows = bars(spark, [1.0, 1.2, 0.9, 1.0, 1.1]).withColumns({"e": F.lit(True), "t": F.lit(0.05)})
    assert triple_barrier(rows, "e", "t", min_target=0.05).count() == 0
    assert triple_barrier(rows, "e", "t", min_target=0.049).count() == 4


def test_triple_barrier_side_and_filled_target(spark):
    rows = bars(spark, [1.0, 1.2, 0.9, 1.0]).withColumns({"e": F.col("close") > 0.95, "t": F.expr("CASE WHEN close = 1.0 AND hour(ts) = 0 THEN 0.05D END"), "s": F.expr("CASE WHEN close = 1.2D THEN NULL ELSE -1 END")})
    found = {r.ts.hour: r for r in triple_barrier(rows, "e", "t", side="s").collect()}
    assert (found[0].ret, found[0].bin, found[0].side) == (pytest.approx(-0.2), 0, -1.0)
    assert (found[1].ret, found[1].bin, found[1].trgt) == (0.0, 0, 0.05)


def test_held_positions(spark):
    t = [BASE + timedelta(hours=i) for i in range(8)]
    calendar = bars(spark, [1.0] * 8)
    bets = spark.createDataFrame([("X", t[1], t[3], 1.0, 0.5), ("X", t[2], t[5], -1.0, 0.25), ("X", t[4], t[7], 1.0, None)], "symbol string, ts timestamp_ntz, t1 timestamp_ntz, side double, size double")
    assert [r.signal for r in held_positions(calendar, bets).orderBy("ts").collect()] == [0, 0.5, -0.25, -0.25, -0.25, -0.25, 0, 0]


# Validation


def test_sharpe_statistics(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0.0004, 0.01, 500)
    rows = spark.createDataFrame([(t, float(x)) for t, x in hours(*r)], "ts timestamp_ntz, ret double")
    m = V.min_track_record_length(V.deflated_sharpe(V.probabilistic_sharpe(V.sharpe_moments(rows)), 20)).first()
    sr, z = r.mean() / r.std(ddof=1), (r - r.mean()) / r.std()
    spread = 1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr**2
    assert m.psr == pytest.approx(NormalDist().cdf(sr * math.sqrt(499 / spread)))
    assert m.sr0 == pytest.approx(V.expected_max_sharpe(20, r.var() / 500))
    assert m.dsr == pytest.approx(NormalDist().cdf((sr - m.sr0) * math.sqrt(499 / spread)))
    assert m.min_track == pytest.approx(1 + spread * (NormalDist().inv_cdf(0.95) / sr) ** 2) if sr > 0 else m.min_track == math.inf
    assert V.expected_max_sharpe(1, 1.0) == 0.0 and 2.4 < V.expected_max_sharpe(100, 1.0) < 2.7
    assert V.probabilistic_sharpe(V.sharpe_moments(rows.limit(10))).first().psr is None
    flat = spark.createDataFrame([(t, 0.0) for t, _ in hours(*range(40))], "ts timestamp_ntz, ret double")
    report = V.validation_report(flat, n_boot=5).first()
    assert report.sharpe_ann is None and report.note == "degenerate return series"
    x = spark.createDataFrame([(0.3,), (None,), (2.0,)], "p double")
    assert [round(v, 6) if v is not None and v == v else None for (v,) in x.select(V.normal_quantile("p")).collect()] == [round(NormalDist().inv_cdf(0.3), 6), None, None]


def test_overfitting_of_noise_and_of_an_edge(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(0, 0.01, (400, 6))
    edge = noise.copy()
    edge[:, 0] += 0.006

    def pbo(m):
        rows = spark.createDataFrame([(f"v{j}", BASE + timedelta(hours=i), float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1])], "variant string, ts timestamp_ntz, ret double")
        return V.backtest_overfitting(V.cscv_splits(rows, 8)).first()

    assert pbo(edge).pbo == 0 and pbo(edge).n_splits == 70
    assert pbo(noise).pbo > 0.1
    assert pbo(noise[:, :1]).n_splits == 0


def test_bootstrap_and_shuffle(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.002, 0.01, 300)
    rows = spark.createDataFrame([(t, float(x)) for t, x in hours(*r)], "ts timestamp_ntz, ret double")
    drawn = V.stationary_bootstrap(rows, 20, 10, seed=5)
    assert drawn.count() == 20 * 300 and drawn.select("rep", "t").distinct().count() == 20 * 300
    assert {x.ret for x in drawn.select("ret").distinct().collect()} <= set(r.tolist())
    sequence = [x.ret for x in drawn.where("rep = 3").orderBy("t").collect()]
    place = {x: i for i, x in enumerate(r.tolist())}
    runs = sum((place[b] - place[a]) % 300 == 1 for a, b in zip(sequence, sequence[1:], strict=False))
    assert 0.75 < runs / 299 < 1
    assert [x.ret for x in V.stationary_bootstrap(rows, 20, 10, seed=5).where("rep = 3").orderBy("t").collect()] == sequence
    ci = V.bootstrap_sharpe_ci(rows, 100, 10).first()
    assert ci.ci_low < ci.sharpe < ci.ci_high and 0 <= ci.p_sharpe_le_0 <= 0.2
    signal = rows.select(F.lit("X").alias("symbol"), "ts", F.signum("ret").alias("signal"))
    test = V.shuffle_test(lambda s: s.join(rows, "ts").select("rep", "ts", (F.col("signal") * F.col("ret")).alias("ret")), signal, 30).first()
    assert test.p_value == 0 and test.real_sharpe > test.null_p95
    shuffled = V.shuffle_test(lambda s: s.select("rep", "ts", F.col("signal").alias("ret")), signal, 3).first()
    assert shuffled.null_mean == pytest.approx(shuffled.real_sharpe)


def test_splits_do_not_look_ahead(spark):
    t = [BASE + timedelta(hours=i) for i in range(103)]
    labels = spark.createDataFrame([("X", t[i], t[min(i + 5, 102)]) for i in range(103)], "symbol string, ts timestamp_ntz, t1 timestamp_ntz")
    rows = V.purged_kfold(labels, 5, 0.05).collect()
    for fold in range(5):
        own = {r.ts: r.role for r in rows if r.fold == fold}
        test = [x for x, role in own.items() if role == "test"]
        begin, end = min(test), max(min(x + timedelta(hours=5), t[-1]) for x in test)
        assert len(test) == (21 if fold < 3 else 20)
        for x, role in own.items():
            if role == "train":
                assert not (min(x + timedelta(hours=5), t[-1]) > begin and x < end)
                assert not 0 < (x - max(test)).total_seconds() / 3600 <= 5
    with pytest.raises(ValueError, match="t1"):
        V.purged_kfold(labels.drop("t1"))
    walk = V.walk_forward(labels.drop("t1"), 4, embargo=3, expanding=False).collect()
    for split in range(4):
        train, test = ([r.ts for r in walk if r.split == split and r.role == role] for role in ("train", "test"))
        assert len(train) <= 30 and max(train) + timedelta(hours=4) == min(test)


# Risk, sizing, signals


def test_kill_switch_is_sticky_and_counts_days(spark):
    equity = [100, 99, 96.9, 98, 100] + [100] * 19 + [120, 97, 96]
    rows = spark.createDataFrame([("all", t, float(e)) for t, e in hours(*equity)], "book string, ts timestamp_ntz, equity double")
    found = kill_switch(rows, RiskConfig(max_daily_loss=0.03, max_drawdown=0.15)).orderBy("ts").collect()
    switch = live.KillSwitch(RiskConfig(max_daily_loss=0.03, max_drawdown=0.15))
    for r in found:
        reason = switch.update(r.equity, r.ts)
        assert (reason or "").split(":")[0] == (r.reason or "") and r.tripped == (reason is not None)
    assert found[1].reason is None and found[3].reason == "daily loss limit hit" and found[-1].reason == "max drawdown hit"


def test_backtest_timing_and_costs(spark):
    rows = bars(spark, [100.0, 110.0, 121.0, 133.1])
    weights = bars(spark, [1.0, 1.0, 1.0, 1.0]).withColumnRenamed("close", "weight")
    book = run_backtest(rows, weights, Costs(taker=0, slippage=10)).orderBy("ts").collect()
    assert [round(r.gross, 9) for r in book] == [0, 0, 0.1, 0.1]
    assert [round(r.cost, 9) for r in book] == [0, 0.001, 0, 0]
    two = run_backtest(rows, weights.withColumn("v", F.lit("a")).unionByName(weights.withColumn("v", F.lit("b")).withColumn("weight", F.lit(0.5))), books=("v",))
    assert {r.v: round(r.g, 9) for r in two.groupBy("v").agg(F.sum("gross").alias("g")).collect()} == {"a": 0.2, "b": 0.1}


def test_strategy_errors(spark, market):
    with pytest.raises(ValueError):
        ma_crossover(market[1], 5, 5)
    with pytest.raises(ValueError):
        adaptive_raw(market[0], {"trend": -1.0})
    with pytest.raises(ValueError):
        adaptive_raw(market[0], temperature=0)
    with pytest.raises(RuntimeError):
        MetaLabel(rule(trend_carry)).signal(market[0])


def test_sweep_equals_single_evaluations(spark, market):
    features, rows, funding = market
    grid = [{"fast": 5, "slow": 20}, {"fast": 9, "slow": 3}, {"fast": 10, "slow": 50}]
    returns, table = research.parameter_sweep(lambda fast, slow: rule(lambda f: ma_crossover(rows, fast, slow)), grid, features, rows, funding)
    assert {r.variant for r in table.collect()} == {"v000", "v002"}
    alone = research.evaluate(rule(lambda f: ma_crossover(rows, 10, 50)), features, rows, funding)[0]
    both = alone.select("ts", "ret").join(returns.where("variant = 'v002'").select("ts", F.col("ret").alias("other")), "ts")
    assert both.count() == rows.select("ts").distinct().count() and both.where("abs(ret - other) > 1e-12").count() == 0
    best = research.best_variant(table).first()
    assert best.sharpe == max(r.sharpe for r in table.collect())


def test_evaluate_respects_caps_and_future_does_not_matter(spark, market):
    features, rows, funding = market
    _, weights = research.evaluate(rule(trend_carry), features, rows, funding)
    gross = weights.groupBy("ts").agg(F.sum(F.abs("weight")).alias("g"), F.max(F.abs("weight")).alias("m"))
    assert gross.where("g > 2.0001 or m > 0.5001").count() == 0
    cut = rows.agg(F.expr("percentile_approx(ts, 0.7)")).first()[0]
    early = rows.where(F.col("ts") <= F.lit(str(cut)).cast("timestamp_ntz"))
    from tidebar.operators.features import build_features

    short = research.sized(early, trend_carry(build_features(early)), RiskConfig())
    whole = research.sized(rows, trend_carry(build_features(rows)), RiskConfig()).withColumnRenamed("weight", "w2")
    assert short.join(whole, ["symbol", "ts"]).where("abs(weight - w2) > 1e-9").count() == 0


def test_meta_label_is_out_of_sample(spark, market):
    features = market[0]
    model = MetaLabel(rule(trend_carry), min_events=40, n_splits=3).fit(features)
    events = model.events.collect()
    assert events and all(e.proba is None or 0 <= e.proba <= 1 for e in events)
    signal = model.signal(features)
    assert signal.count() == features.count() and signal.where("abs(signal) > 1").count() == 0
    assert model.signal(features, use_oos=False).count() == features.count()


# Synthetic markets


def test_synthetic_bars(spark):
    one = synthetic_bars(spark, {"A": 1, "B": 2}, 300, trend_strength=0.05).cache()
    again = synthetic_bars(spark, {"A": 1, "B": 2}, 300, trend_strength=0.05)
    assert one.exceptAll(again).count() == 0 and one.count() == 600
    assert one.where("high < greatest(open, close) or low > least(open, close) or low <= 0").count() == 0
    universe = synthetic_universe(spark, ("A", "B", "C"), 800, seed=3)
    wide = universe.groupBy("ts").pivot("symbol").agg(F.first("close")).orderBy("ts").toPandas().set_index("ts")
    assert np.log(wide).diff().corr().loc["A", "B"] > 0.25


# Lake and archives


def test_lake_round_trip_and_pruning(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.read("klines", "X").count() == 0 and lake.read("funding").columns == ["symbol", "ts", "funding_rate"]
    first = bars(spark, [1.0, 2.0, 3.0]).withColumn("interval", F.lit("1h"))
    lake.write(first.unionByName(bars(spark, [7.0], "Y").withColumn("interval", F.lit("1h"))), "klines")
    lake.write(first.where("close > 2").withColumn("close", F.lit(9.0)), "klines")
    lake.write(first.where("close > 2").withColumn("close", F.lit(9.0)), "klines")
    assert [r.close for r in lake.read("klines", "X", "1h").orderBy("ts").collect()] == [1.0, 2.0, 9.0]
    assert [r.close for r in lake.read("klines", "Y").collect()] == [7.0]
    ranged = lake.read("klines", ["X"], "1h", BASE + timedelta(hours=1), "2024-01-01 02:00:00")
    assert ranged.count() == 2
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan
    assert set(lake.read_many("klines", ["X", "Y"])) == {"X", "Y"}
    assert lake.panel(["Y", "X", "Z"], "1h").columns == ["ts", "Y", "X"]
    assert lake.sql("SELECT count(*) AS n FROM klines k LEFT JOIN metrics m ON k.symbol = m.symbol").first().n == 4


def zipped(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data.csv", text)
    return out.getvalue()


def test_archive_files(spark, tmp_path):
    row = "{},1,2,0.5,{},10,{},20,3,4,5,0"
    ms = 1704067200000
    (tmp_path / "a.zip").write_bytes(zipped("\n".join(row.format(ms + i * 3600000, c, 0) for i, c in enumerate(["1.5", "bad", "1.7"]))))
    (tmp_path / "b.zip").write_bytes(zipped(",".join(archive.KLINES) + "\n" + row.format((ms + 2 * 3600000) * 1000, "9.9", 0) + "\n" + row.format((ms + 3 * 3600000) * 1000, "1.8", 0)))
    (tmp_path / "c.zip").write_bytes(b"no zip")
    rows = archive.clean_klines(archive.parsed(archive.zipped_files(spark, str(tmp_path)), archive.KLINES), "X").orderBy("ts").collect()
    assert [(r.ts, r.close) for r in rows] == [(BASE, 1.5), (BASE + timedelta(hours=2), 1.7), (BASE + timedelta(hours=3), 1.8)]
    assert archive.unzip_csv(zipped("1,2,3\n4,5,6\n"), archive.FUNDING).to_pydict() == {"calc_time": ["1", "4"], "funding_interval_hours": ["2", "5"], "last_funding_rate": ["3", "6"]}


def test_archive_addresses_and_ranges():
    now = datetime(2024, 3, 5, 1, tzinfo=UTC)
    urls = archive.kline_urls("futures_um", "BTCUSDT", "1h", "2024-01-15", None, True, now)
    assert len(urls) == 2 + 4 and urls[0].endswith("/futures/um/monthly/klines/BTCUSDT/1h/BTCUSDT-1h-2024-01.zip") and urls[-1].endswith("BTCUSDT-1h-2024-03-04.zip")
    assert archive.month_range("2024-05-01", "2024-02-01", now) == [] and archive.day_range("2024-03-05", None, now) == []
    assert archive.day_range("2024-02-28", "2024-03-01", now) == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    with pytest.raises(ValueError, match="market"):
        archive.funding_urls("nowhere", "X", "2024-01-01", None, now)


def test_fetch_keeps_and_marks(tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        if "down" in url:
            raise urllib.error.URLError("no network")
        if "denied" in url:
            raise urllib.error.HTTPError(url, 403, "", None, None)
        return None if "gone" in url else b"body"

    cache = str(tmp_path)
    assert [archive.fetch("http://x/a", cache, get) for _ in range(2)] == [b"body"] * 2
    assert [archive.fetch("http://x/gone", cache, get) for _ in range(2)] == [None] * 2
    assert [archive.fetch("http://x/down", cache, get) for _ in range(2)] == [None] * 2
    with pytest.raises(urllib.error.HTTPError):
        archive.fetch("http://x/denied", cache, get)
    assert asked == ["http://x/a", "http://x/gone", "http://x/down", "http://x/down", "http://x/denied"]


def test_timestamps_by_size(spark):
    values = ["1704067200", "1704067200000", "1704067200000000", "1704067200000000000", "2024-01-01 00:00:00", "x", None]
    found = spark.createDataFrame([(v,) for v in values], "v string").select(archive.to_timestamp(F.col("v")).alias("t")).collect()
    assert [r.t for r in found] == [BASE] * 5 + [None, None]


def test_feeds(spark, tmp_path):
    pages = [[[i * 60000, 1, 2, 0.5, 1.5, 3] for i in range(1000)], [[60000000, 1, 2, 0.5, 1.5, 3]]]
    since = []
    rows = feeds.ohlcv_pages(spark, lambda s, t, at, n: since.append(at) or pages[len(since) - 1], "BTC/USDT", "1m", 0, 3000)
    assert rows.count() == 1001 and since == [0, 999 * 60000 + 1]
    markets = spark.createDataFrame([("B/USDT", True), ("A/USDT", None), ("C/USDT", False), ("D/EUR", True)], "symbol string, active boolean")
    assert [r.symbol for r in feeds.list_pairs(markets).collect()] == ["A/USDT", "B/USDT"] and feeds.list_pairs(markets, limit=1).count() == 1
    assert feeds.last_price(lambda s: {"last": "3.5"}, "X") == 3.5 and feeds.last_price(lambda s: {}, "X") is None
    assert feeds.fear_and_greed(spark, json.dumps({"data": [{"timestamp": "1704067200", "value": "40"}]})).first() == (BASE, 40.0)
    assert feeds.total_value_locked(spark, json.dumps([{"date": 1704067200, "tvl": 5.0}])).first() == (BASE, 5.0)
    assert feeds.stablecoin_supply(spark, json.dumps([{"date": "1704067200", "totalCirculatingUSD": {"a": 1.5, "b": 2}}])).first() == (BASE, 3.5)


def test_collect_recent(spark, tmp_path):
    now, hour = 1704067200000 + 10 * 3600000, 3600000
    lake = Lake(spark, str(tmp_path / "lake"))

    def get(url):
        if "//down" in url:
            raise OSError("blocked")
        if "fundingRate" in url:
            return json.dumps([{"fundingTime": now - 5 * hour, "fundingRate": "0.0001"}, {"fundingTime": now + 5 * hour, "fundingRate": "1"}]).encode()
        n = 9 if "symbol=A" in url else 8
        return json.dumps([[now - (10 - i) * hour, "1", "2", "0.5", "1.5", "3", now - (9 - i) * hour - 1 if i < n else now + hour, "1", 2, "1", "1", "0"] for i in range(n + 1)]).encode()

    last = feeds.collect_recent(spark, lake, ["http://down", "http://up"], ["A", "B"], "1h", now, get=get)
    assert last == BASE + timedelta(hours=7)
    assert {r.symbol: r.n for r in lake.read("klines").groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"A": 8, "B": 8}
    assert lake.read("funding").count() == 2
    assert feeds.collect_recent(spark, lake, ["http://down"], ["A"], "1h", now, get=get) is None


# Configuration, ledger, reports, command line


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "config.toml").write_text('[risk]\nmax_drawdown = 0.1\n[costs]\ntaker_fee_bps = 1.0\n[data]\nroot = "lake"\n')
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    monkeypatch.chdir(inner)
    monkeypatch.delenv("TIDEBAR_CONFIG", raising=False)
    config = load_config()
    assert config.path == (tmp_path / "config.toml").resolve() and config.data_root == str((tmp_path / "lake").resolve())
    assert risk_from_config(config).max_drawdown == 0.1 and costs_from_config(config) == Costs(taker=1.0)
    assert config.get("risk.nothing.there", 3) == 3
    (tmp_path / "other.json").write_text('{"risk": null}')
    monkeypatch.setenv("TIDEBAR_CONFIG", str(tmp_path / "other.json"))
    assert risk_from_config(load_config()) == RiskConfig()
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.toml")


def test_ledger(spark, tmp_path):
    strategy, config = tmp_path / "s.py", tmp_path / "c.json"
    strategy.write_text("x")
    config.write_text("{}")
    folder = tmp_path / "evidence"
    manifest = ledger.initialise(folder, BASE + timedelta(hours=1), "s", strategy, config, ["X"], "1h")
    with pytest.raises(FileExistsError):
        ledger.initialise(folder, BASE, "s", strategy, config, ["X"], "1h")
    book = spark.createDataFrame(hours(0.5, 0.5, 0.1, 0.1), "ts timestamp_ntz, ret double")
    weights = bars(spark, [0.1, 0.2, 0.3, 0.4]).withColumnRenamed("close", "weight")
    entry = ledger.append_snapshot(folder, book, weights)
    assert entry["n_forward_bars"] == 2 and entry["cumulative_return"] == pytest.approx(0.21) and entry["latest_weights"] == {"X": 0.4} and entry["previous_sha256"] == manifest["manifest_sha256"]
    assert ledger.append_snapshot(folder, book, weights)["status"] == "no_new_completed_bar"
    assert ledger.verify(folder)["status"] == "frozen"
    lines = (folder / "ledger.jsonl").read_text()
    (folder / "ledger.jsonl").write_text(lines.replace("0.4", "0.5"))
    with pytest.raises(RuntimeError, match="chain"):
        ledger.verify(folder)
    (folder / "ledger.jsonl").write_text(lines)
    strategy.write_text("y")
    with pytest.raises(RuntimeError, match="strategy"):
        ledger.verify(folder)


def test_chain_as_a_query(spark):
    rows, before = [], "root"
    for i in range(5):
        own = hashlib.sha256(f"{before}body{i}".encode()).hexdigest()
        rows.append((i, f"body{i}", before, own))
        before = own
    table = spark.createDataFrame(rows, "seq int, body string, previous_sha256 string, entry_sha256 string")
    assert ledger.chain_breaks(table, "root").where("broken").count() == 0
    changed = table.withColumn("body", F.when(F.col("seq") == 2, "other").otherwise(F.col("body")))
    assert [r.seq for r in ledger.chain_breaks(changed, "root").where("broken").collect()] == [2]


def test_report_and_load(spark, tmp_path, market):
    features, rows, funding = market
    lake = Lake(spark, str(tmp_path / "data"))
    lake.write(rows.withColumn("interval", F.lit("1h")), "klines")
    config = Config({"data": {"root": str(tmp_path / "data"), "symbols": ["A", "B", "missing"], "interval": "1h"}}, tmp_path / "config.json")
    loaded, again, rates = research.load_feature_data(spark, config)
    assert again.count() == rows.count() and loaded.count() == rows.count() and rates.where("funding_rate <> 0").count() == 0
    with pytest.raises(RuntimeError, match="no bars"):
        research.load_feature_data(spark, config, ["missing"])
    book, _ = research.evaluate(rule(lambda f: ma_crossover(rows)), features, rows, funding)
    sections = research.full_report(book.cache(), benchmark=research.benchmark_book(rows))
    assert set(sections) == {"performance", "validation", "monthly", "benchmark", "information_ratio"}
    text = research.print_report({k: sections[k] for k in ("performance", "information_ratio")})
    assert "sharpe" in text and "information_ratio" in text
    research.write_report(book, str(tmp_path / "out"), {"performance": sections["performance"]})
    assert spark.read.json(str(tmp_path / "out" / "performance")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "series")).count() == book.count()


def test_command_line():
    args = cli.parser().parse_args(["--config", "c.toml", "selftest", "--trend", "0.03", "--sweep"])
    assert (args.command, args.trend, args.sweep, args.config) == ("selftest", 0.03, True, "c.toml")
    assert set(cli.COMMANDS) == {"download", "research", "selftest", "paper", "forward"}
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["forward", "undo"])


# Streams


def run_stream(frame, path):
    frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_streamed_kill_switch_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    equity = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))
    rows = spark.createDataFrame([(b, t, float(e) * k) for t, e in hours(*equity) for b, k in (("a", 1.0), ("b", 2.0))], "book string, ts timestamp_ntz, equity double")
    risk = RiskConfig(max_daily_loss=0.02, max_drawdown=0.05)
    source = str(tmp_path / "in")
    for low, high in ((0, 20), (20, 45), (45, 60)):
        part = rows.where((F.col("ts") >= F.lit(BASE + timedelta(hours=low))) & (F.col("ts") < F.lit(BASE + timedelta(hours=high))))
        part.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("book string, ts timestamp, equity double").parquet(source)
        run_stream(live.kill_switch_stream(stream, risk), tmp_path)
    streamed = {(r.book, r.ts): r.reason for r in spark.read.parquet(str(tmp_path / "out")).select("book", F.col("ts").cast("timestamp_ntz").alias("ts"), "reason").collect()}
    batch = {(r.book, r.ts): r.reason for r in kill_switch(rows, risk).collect()}
    assert streamed == batch and None in batch.values() and len(set(batch.values())) > 1


def test_streamed_band_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = bars(spark, rng.normal(0, 0.2, 50).tolist()).withColumnRenamed("close", "weight")
    source = str(tmp_path / "in")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    run_stream(live.turnover_buffer_stream(spark.readStream.schema("symbol string, ts timestamp, weight double").parquet(source)), tmp_path)
    streamed = {r.ts: r.held for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "held").collect()}
    assert streamed == {r.ts: r.held for r in turnover_buffer(rows, "weight", "held").collect()}


def test_redelivered_bars_are_dropped_and_upserted(spark, tmp_path):
    source, lake = str(tmp_path / "in"), Lake(spark, str(tmp_path / "lake"))
    rows = bars(spark, [1.0, 2.0, 3.0]).withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        rows.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_stream(live.once(stream), tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    query = stream.withColumn("interval", F.lit("1h")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).writeStream.foreachBatch(live.upserting(lake)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert lake.read("klines").count() == 3


def test_live_runner(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.write(bars(spark, [100.0] * 5, "A").unionByName(bars(spark, [50.0] * 5, "B")).withColumn("interval", F.lit("1h")), "klines")
    broker = live.PaperBroker(lake, held={"B": 10.0})
    clock = [datetime(2024, 1, 1, 5, 0, tzinfo=UTC)]
    weights = lambda rows: rows.select("symbol", "ts", F.when(F.col("symbol") == "A", 0.5).otherwise(0.0).alias("weight"))
    runner = live.LiveRunner(spark, broker, weights, ["A", "B"], str(tmp_path / "state"), clock=lambda: clock[0])
    done = runner.step()
    assert done["equity"] == 10_500 and [(a["symbol"], a["reduce_only"]) for a in done["actions"]] == [("A", False), ("B", True)]
    assert broker.positions() == {"A": pytest.approx(52.5)} and broker.equity() == pytest.approx(10_500)
    assert json.loads((tmp_path / "state" / "live_state.json").read_text())["equity"] == 10_500
    assert runner.step()["actions"] == []
    clock[0] += timedelta(hours=3)
    with pytest.raises(RuntimeError, match="stale"):
        runner.step()
    assert runner.run(0, cycles=2, sleep=lambda s: None) == []
    clock[0] -= timedelta(hours=3)
    broker.cash -= 5_000
    with pytest.raises(live.Halted):
        runner.run(0, cycles=1, sleep=lambda s: None)
    assert broker.positions() == {} and json.loads((tmp_path / "state" / "live_state.json").read_text())["halted"]


