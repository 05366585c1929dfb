"""A forward test that cannot be rewritten: a frozen manifest, and a chain of entries that each hash the one before.

Entries are few (one for each new bar that was evaluated) and their order is the point, so they are a file of lines, and
only the figures in them come from Spark. `chain_breaks` checks a chain of any length as a query."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(value: dict) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digest(value: dict) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def file_digest(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def initialise(folder: str | Path, cutoff: datetime, strategy: str, strategy_file: str | Path, config_file: str | Path, symbols: list[str], interval: str) -> dict:
    """Freeze the strategy, the configuration and the last bar that was known. A folder that has a manifest is refused."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    manifest_file = folder / "manifest.json"
    if manifest_file.exists():
        raise FileExistsError(f"a forward test is there already: {manifest_file}")
    cutoff = cutoff.replace(tzinfo=UTC) if cutoff.tzinfo is None else cutoff.astimezone(UTC)
    manifest = {
        "version": 1, "created_at": datetime.now(UTC).isoformat(), "cutoff": cutoff.isoformat(), "strategy": strategy, "strategy_file": str(strategy_file),
        "strategy_sha256": file_digest(strategy_file), "config_file": str(config_file), "config_sha256": file_digest(config_file), "symbols": list(symbols), "interval": interval, "status": "frozen",
    }
    manifest["manifest_sha256"] = digest(manifest)
    manifest_file.write_text(json.dumps(manifest, indent=2) + "\n", encoding="utf-8")
    (folder / "ledger.jsonl").touch(exist_ok=False)
    return manifest


def entries(folder: str | Path) -> list[dict]:
    return [json.loads(line) for line in (Path(folder) / "ledger.jsonl").read_text(encoding="utf-8").splitlines()]


def verify(folder: str | Path) -> dict:
    """The manifest, if it, the frozen files and the whole chain are as they were; else an error says what is not."""
    manifest = json.loads((Path(folder) / "manifest.json").read_text(encoding="utf-8"))
    if digest({k: v for k, v in manifest.items() if k != "manifest_sha256"}) != manifest["manifest_sha256"]:
        raise RuntimeError("the manifest was changed")
    for what in ("strategy", "config"):
        if file_digest(manifest[f"{what}_file"]) != manifest[f"{what}_sha256"]:
            raise RuntimeError(f"the {what} was changed after the cutoff")
    before = manifest["manifest_sha256"]
    for entry in entries(folder):
        own = entry.pop("entry_sha256")
        if entry["previous_sha256"] != before or digest(entry) != own:
            raise RuntimeError("the chain of entries is broken")
        before = own
    return manifest


def append_snapshot(folder: str | Path, book: DataFrame, weights: DataFrame) -> dict:
    """Verify, then append the returns since the cutoff and the weights of the last bar; nothing without a new bar."""
    manifest = verify(folder)
    last = weights.agg(F.max("ts")).first()[0]
    done = entries(folder)
    if done and datetime.fromisoformat(done[-1]["last_bar"]).replace(tzinfo=None) >= last:
        return done[-1] | {"status": "no_new_completed_bar"}
    cutoff = datetime.fromisoformat(manifest["cutoff"]).astimezone(UTC).replace(tzinfo=None)
    after = book.where(F.col("ts") > F.lit(str(cutoff)).cast("timestamp_ntz")).agg(F.count("*").alias("n"), F.product(1 + F.col("ret")).alias("growth")).first()
    entry = {
        "recorded_at": datetime.now(UTC).isoformat(), "last_bar": last.isoformat(), "cutoff": manifest["cutoff"], "n_forward_bars": after["n"],
        "cumulative_return": float(after["growth"] - 1) if after["n"] else 0.0,
        "latest_weights": {r["symbol"]: float(r["weight"]) for r in weights.where(F.col("ts") == F.lit(str(last)).cast("timestamp_ntz")).orderBy("symbol").collect()},
        "previous_sha256": done[-1]["entry_sha256"] if done else manifest["manifest_sha256"],
    }
    entry["entry_sha256"] = digest(entry)
    with (Path(folder) / "ledger.jsonl").open("a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True) + "\n")
    return entry | {"status": "appended"}


def chain_breaks(rows: DataFrame, first: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows (seq, body, previous_sha256, entry_sha256) with broken: the hash of previous and body is not the entry's, or
    previous is not the entry before's (for the first one: `first`)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("seq")
    expected = F.coalesce(F.lag("entry_sha256").over(w), F.lit(first))
    hashed = F.sha2(F.concat(F.col("previous_sha256"), F.col("body")).cast("binary"), 256)
    return rows.withColumn("broken", ~(F.col("previous_sha256").eqNullSafe(expected) & F.col("entry_sha256").eqNullSafe(hashed)))
