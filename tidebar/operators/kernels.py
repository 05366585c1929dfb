"""Sequential recursions that no window frame expresses. Each runs once over a symbol's rows, in Arrow batches, and a
query that needs several columns gets all of them from one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidebar.session import ship


def by_group(df: DataFrame, compute: Callable[[pd.DataFrame], dict[str, np.ndarray]], columns: dict[str, str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """df with the columns that compute gives for the rows of each group in ts order; NaN comes back as null."""
    ship(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable").reset_index(drop=True)
        for name, values in compute(rows).items():
            rows[name] = pd.Series(values).astype(object).where(pd.notna(values), None)
        return rows

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in columns] + [f"`{k}` {v}" for k, v in columns.items()])
    return df.drop(*columns).groupBy(*keys).applyInPandas(run, schema)


def ewm(df: DataFrame, specs: dict[str, dict], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """df with exponentially weighted means or deviations. A spec has column, stat (mean or std) and what weights it:
    alpha, span or halflife; adjust and min_periods as usual. Null rows decay the weights and repeat the last value."""

    def compute(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        out = {}
        for name, spec in specs.items():
            how = {k: v for k, v in spec.items() if k in ("alpha", "span", "halflife", "adjust", "min_periods")}
            weighted = rows[spec["column"]].astype(float).ewm(**how)
            out[name] = (weighted.mean() if spec["stat"] == "mean" else weighted.std()).to_numpy()
        return out

    return by_group(df, compute, dict.fromkeys(specs, "double"), keys)


def frac_diff_weights(d: float, threshold: float = 1e-5, longest: int = 10_000) -> np.ndarray:
    """Weights of (1 - L)^d, newest first, up to the first one below the threshold."""
    k = np.arange(1, longest)
    w = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
    small = np.flatnonzero(np.abs(w) < threshold)
    return w[: small[0]] if len(small) else w


def frac_diff(df: DataFrame, column: str, out: str, d: float = 0.4, threshold: float = 1e-5) -> DataFrame:
    """Fractional difference by FFT; null where the window is not full or holds a null."""
    weights = frac_diff_weights(d, threshold)

    def compute(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[column].astype(float).to_numpy()
        n, width = len(x), len(weights)
        result = np.full(n, np.nan)
        if n >= width:
            good = np.isfinite(x)
            size = 1 << (n + width - 1).bit_length()
            filtered = np.fft.irfft(np.fft.rfft(np.where(good, x, 0.0), size) * np.fft.rfft(weights, size), size)[:n]
            count = np.cumsum(good)
            full = count - np.concatenate([np.zeros(width, int), count[:-width]]) == width
            result[full] = filtered[full]
        return {out: result}

    return by_group(df, compute, {out: "double"})


def cusum_events(df: DataFrame, ret: str, threshold: str, out: str = "event") -> DataFrame:
    """Symmetric CUSUM of returns: 1 or -1 on the bar where the rise or fall exceeds the threshold, which resets that
    side alone. A bar without return or without a positive threshold neither adds nor fires."""

    def compute(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        up = down = 0.0
        fired = np.zeros(len(rows), int)
        for i, (r, h) in enumerate(zip(rows[ret].astype(float), rows[threshold].astype(float), strict=True)):
            if not (h > 0) or r != r:
                continue
            up, down = max(0.0, up + r), min(0.0, down + r)
            if up > h:
                fired[i], up = 1, 0.0
            elif down < -h:
                fired[i], down = -1, 0.0
        return {out: fired}

    return by_group(df, compute, {out: "int"})


def turnover_buffer(df: DataFrame, target: str, out: str, buffer: float = 0.1, min_band: float = 0.01, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """No-trade band: the weight moves to the target only if that is further than buffer * max(|target|, |held|,
    min_band) away from what is held; it starts from nothing."""

    def compute(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        held, path = 0.0, []
        for x in rows[target].astype(float):
            if abs(x - held) > buffer * max(abs(x), abs(held), min_band):
                held = x
            path.append(held)
        return {out: np.array(path, float)}

    return by_group(df, compute, {out: "double"}, keys)
