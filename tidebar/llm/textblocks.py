"""Arrow text columns as flat byte arrays, cut into blocks of whole texts, and vectorised hashing over them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19


class Block(NamedTuple):
    """Texts lo..hi-1 of a column: their UTF-8 bytes end to end, and where each begins (one entry more than texts)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of at most `limit` bytes, or of one text where that is longer. A null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place: every input bit reaches every output bit."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


POWER = _powers(0x9E3779B97F4A7C15, 256)
BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27))


def word_spans(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of kept bytes; no run goes over the end of a text."""
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(kept), bool)
    before[0] = False
    before[1:] = kept[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(kept)]] = False
    starts = np.flatnonzero(kept & ~before)
    gone = np.empty(len(kept), bool)
    gone[-1] = True
    gone[:-1] = ~kept[1:]
    gone[cuts[cuts > 0] - 1] = True
    ends = np.flatnonzero(kept & gone) + 1
    return starts, ends - starts


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (spans in order and apart)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    value = BYTE_VALUE[data[place + np.repeat(starts, lengths)]]
    value *= POWER[place & 255]
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def per_text_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] for ascending bounds; an empty range gives 0."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: bounds[-1]], bounds[some], dtype=np.float64)
    return out


def list_views(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, without a copy."""
    flat, cuts = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
