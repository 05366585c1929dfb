"""Quality classifier: supervised subword embeddings.

Every white-space separated word, every pair of adjacent words, and every n-gram of 2 to 4 bytes within a word (with its
ends marked) is hashed to a bucket; a bucket has a learned vector. Pairs of equal words share one bucket. A text is the average of its
vectors, a softmax over the classes stands on top, and all is trained by stochastic gradient descent in numpy. As
the softmax is linear in the average, a bucket's share of the logits is its vector times the output matrix: that one
number for each bucket is what scoring looks up.

Defined results: a null or empty text, or one of white space alone, has no features and scores by the output bias;
repeated rows score alike; an empty table gives an empty table; other columns pass through, and a column that has the
name of a result is replaced by it. Without any labelled example the score is 0.5 everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.labelled import bounded_sample, encoded, held_out_flag, release
from tidebar.llm.textblocks import BYTE_VALUE, Block, blocks, mix64, per_text_sums, span_hashes, word_spans
from tidebar.session import ship

BITS = 16
DIMENSIONS = 8
#: Labelled rows of each class that are used for fitting, at most.
PER_CLASS = 2500
THRESHOLD = 0.7
#: Steps of training at least, so that few labels still converge.
MIN_STEPS = 15_000

_SHIFT = np.uint64(64 - BITS)
_GRAM = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_PAIR = np.uint64(0x8EBC6AF09C88C6E3)
#: The bucket of all pairs of equal words: few of them recur, and together they tell junk.
_TWICE = np.int32(int(mix64(np.array([0x52EA7], np.uint64))[0]) >> 64 - BITS)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and where each kind's run for each text begins: (buckets, bounds), bounds being
    (kinds, texts + 1) positions in buckets."""
    n = len(block.offsets) - 1
    inside = block.data > 32
    starts, lengths = word_spans(inside, block.offsets)
    words = span_hashes(block.data, starts, lengths)
    at = np.searchsorted(starts, block.offsets)
    parts, bounds = [(words >> _SHIFT).astype(np.int32)], [at]
    # Pairs lie at their first word, but for the last word of each text.
    first = np.ones(max(len(words) - 1, 0), bool)
    ends = at[1:] - 1
    first[ends[(ends >= 0) & (ends < len(first))]] = False
    pairs = np.flatnonzero(first)
    pair = (mix64(words[pairs] * _PAIR + words[pairs + 1]) >> _SHIFT).astype(np.int32)
    parts.append(np.where(words[pairs] == words[pairs + 1], _TWICE, pair))
    bounds.append(np.searchsorted(pairs, at))
    # n-grams of bytes within a word: the byte after each word (or the text's end) stands for its end.
    value = np.where(inside, block.data, 0).astype(np.uint8)
    code = BYTE_VALUE[value]
    text_end = np.zeros(len(value), bool)
    text_end[block.offsets[1:][block.offsets[1:] > block.offsets[:-1]] - 1] = True
    gram, open_ = code, inside & ~text_end
    begin = np.flatnonzero(inside)
    for k in range(3):
        if len(gram) < 2:
            gram, begin = gram[:0], begin[:0]
        else:
            gram = gram[:-1] * _GRAM[k] + code[k + 1 :]
            ok = inside[: len(gram)].copy()
            for j in range(k + 1):  # no gram goes over the end of a text or over white space, but may end on one
                ok &= open_[j : j + len(gram)]
            begin = np.flatnonzero(ok)
        parts.append((gram[begin] * _GRAM[0] >> _SHIFT).astype(np.int32))
        bounds.append(np.searchsorted(begin, block.offsets))
    shift = np.cumsum([0, *map(len, parts)])[:-1]
    return np.concatenate(parts), np.stack([b + s for b, s in zip(bounds, shift, strict=True)]).reshape(-1, n + 1)


@dataclass
class QualityModel:
    """share: each bucket's part of the logit of class 1 against class 0."""

    share: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for block in blocks(column):
            buckets, bounds = features(block)
            values = self.share[buckets]
            total = sum(per_text_sums(values, b) for b in bounds)
            count = np.diff(bounds, axis=1).sum(0)
            out[block.lo : block.hi] += total / np.maximum(count, 1)
        return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 6)


def encode(column: pa.Array) -> list[pa.Array]:
    """The distinct buckets of each text, and their shares of its features."""
    buckets_of, shares = [], []
    for block in blocks(column):
        buckets, bounds = features(block)
        for i in range(bounds.shape[1] - 1):
            own = np.concatenate([buckets[b[i] : b[i + 1]] for b in bounds])
            unique, count = np.unique(own, return_counts=True)
            buckets_of.append(unique)
            shares.append((count / max(len(own), 1)).astype(np.float32))
    return [pa.array(buckets_of, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    dimensions: int = DIMENSIONS,
    rate: float = 0.5,
    min_steps: int = MIN_STEPS,
    seed: int = 7,
) -> QualityModel:
    """Stochastic gradient descent, one text a step, with a rate that falls linearly to 0; the classes weigh the same."""
    if not rows:
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0)
    y = np.asarray(labels, int)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << BITS, dimensions)).astype(np.float32)
    output = rng.uniform(-1, 1, (dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.array([0.5 / max((y == c).mean(), 1e-9) for c in (0, 1)])
    steps = max(min_steps, 2 * len(rows))
    for step in range(steps):
        i = step % len(rows)
        unique, part = rows[i]
        own = vectors[unique]
        hidden = part @ own
        logits = hidden @ output + bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[y[i]] -= 1
        p *= rate * (1 - step / steps) * weight[y[i]]
        back = output @ p
        output -= np.outer(hidden, p)
        bias -= 0.1 * p
        vectors[unique] = own - np.outer(part, back) * 10
    share = vectors @ (output[:, 1] - output[:, 0])
    touched = np.zeros(1 << BITS, bool)
    for unique, _ in rows:
        touched[unique] = True
    # A bucket that no example has keeps its random vector in training; it says nothing, so it gets no share.
    return QualityModel(np.where(touched, share, 0).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on a bounded sample of labels.quality, of rows whose crc32(doc_id) mod 4 is not 2."""
    keyed = labels.where(~held_out_flag(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    found, rows = encoded(bounded_sample(keyed, docs, per_class), encode, ["int", "float"])
    model = fit(rows, np.array(found))
    del rows
    release()
    return model


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """df with the score of each whole text (0 to 1) and predicted (1 if the score is THRESHOLD or more)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(column), pa.float64())

    return df.withColumn(score, scored(F.col(text))).withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out_flag(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
