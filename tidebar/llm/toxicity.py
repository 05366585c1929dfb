"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the presence of its words, adjacent word pairs and pairs with one word between, each hashed to
2**BITS coordinates. Every coordinate has its own learning rate, and the L1 term leaves few non-zero weights: the model
that is broadcast is those few (key, weight) pairs, whatever the number of coordinates.

Defined results: a null or empty text, or one without words, has no features and scores by the bias alone; repeated
rows score alike; an empty table gives an empty table; other columns pass through, and a column that has the name of a
result is replaced by it. Without any labelled example the model has no weights and scores 0.5 everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.labelled import bounded_sample, encoded, held_out_flag, release
from tidebar.llm.textblocks import Block, blocks, mix64, span_hashes, word_spans
from tidebar.session import ship

BITS = 28
#: Labelled rows of each class that are used for fitting, at most.
PER_CLASS = 3000
THRESHOLD = 0.7
#: One pass shows each example this often at least, so that few labels still converge.
MIN_UPDATES = 60_000

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
_KINDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text number within the block, coordinate) of each word, word pair and skip pair; repeats included."""
    data = _LOWER[block.data]
    starts, lengths = word_spans(_IN_WORD[block.data], block.offsets)
    words = span_hashes(data, starts, lengths)
    bounds = np.searchsorted(starts, block.offsets)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys, owners = [mix64(words ^ _KINDS[0])], [owner]
    for gap in (1, 2):
        if len(words) > gap:
            same = owner[:-gap] == owner[gap:]
            keys.append(mix64(words[:-gap] * _KINDS[gap] + words[gap:])[same])
            owners.append(owner[:-gap][same])
    return np.concatenate(owners), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class ToxicityModel:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._seen = np.zeros(1 << 20, bool)
        self._seen[self.keys & ((1 << 20) - 1)] = True

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for block in blocks(column):
            if not len(self.keys):
                break
            owner, key = features(block)
            near = np.flatnonzero(self._seen[key & ((1 << 20) - 1)])
            owner, key = owner[near], key[near]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            pairs = np.unique(owner[hit] * len(self.keys) + at[hit])
            out[block.lo : block.hi] += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], block.hi - block.lo)
        return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 6)


def encode(column: pa.Array) -> list[pa.Array]:
    """The distinct coordinates of each text."""
    rows: list[np.ndarray] = []
    for block in blocks(column):
        owner, key = features(block)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(block.hi - block.lo + 1))
        rows += [np.unique(key[order[a:b]]).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [pa.array(rows, pa.list_(pa.int32()))]


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    alpha: float = 3.0,
    beta: float = 1.0,
    l1: float = 20.0,
    l2: float = 0.01,
    min_count: int = 2,
    min_updates: int = MIN_UPDATES,
) -> ToxicityModel:
    """FTRL-proximal over the examples in the given order; the bias is not penalised. A coordinate that fewer than
    min_count examples have is left out."""
    if not len(labels):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    y = np.asarray(labels, float)
    flat = np.concatenate(rows)
    flat.sort()
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, int)
    vocabulary = flat[first[np.diff(np.append(first, len(flat))) >= min_count]]
    del flat, first
    compact = []
    for own in rows:
        at = np.minimum(np.searchsorted(vocabulary, own), max(len(vocabulary) - 1, 0))
        compact.append(at[vocabulary[at] == own].astype(np.int32) if len(vocabulary) else np.zeros(0, np.int32))
    z, n = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    bz = bn = 0.0
    epochs = max(2, -(-min_updates // len(compact)))
    # The classes weigh the same, whatever their shares.
    share = max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)
    for _ in range(epochs):
        for f, label in zip(compact, y, strict=True):
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            b = -bz / ((beta + np.sqrt(bn)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = (p - label) * 0.5 / share[0 if label else 1]
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b
            bn += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return ToxicityModel(vocabulary[w != 0].astype(np.int64), w[w != 0], float(-bz / ((beta + np.sqrt(bn)) / alpha)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on a bounded sample of labels.toxic, of rows whose crc32(doc_id) mod 3 is not 1."""
    keyed = labels.where(~held_out_flag(F.col("doc_id"), 3, 1) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"))
    found, rows = encoded(bounded_sample(keyed, docs, per_class), encode, ["int"])
    model = fit([keys for (keys,) in rows], np.array(found))
    del rows
    release()
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """df with the score of each whole text (0 to 1) and predicted (1 if the score is THRESHOLD or more)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(column), pa.float64())

    return df.withColumn(score, scored(F.col(text))).withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out_flag(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
