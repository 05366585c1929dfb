"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters (A-Z lower-cased, every other ASCII non-letter as a space) form n-grams of 1 to 3, hashed to buckets. A
bucket's value is its share of the text's n-grams times its inverse document frequency, which is counted over all rows
that may be learned from. Weights are fitted by follow-the-regularised-leader with elastic-net penalties on a bounded
sample; a part of that sample is kept back to calibrate the temperature of the softmax.

Defined results: a null text, or one without any letter, is `und` with score 1; repeated rows get equal results; an
empty table gives an empty table; other columns pass through, and a column that has the name of a result is replaced
by it. Where no language can be learned, every text is `und` with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.labelled import bounded_sample, encoded, held_out_flag, release
from tidebar.llm.textblocks import Block, blocks, per_text_sums
from tidebar.session import ship

BITS = 15
#: Rows of each language that are used for fitting, at most.
PER_CLASS = 800
MIN_UPDATES = 12_000
#: Each CALIBRATE-th example sets the temperature and is not fitted.
CALIBRATE = 5

_BYTES = np.arange(256)
_PLAIN = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, np.where((_BYTES < 128) & ~((_BYTES >= 97) & (_BYTES <= 122)), 32, _BYTES)).astype(np.uint8)
_SHIFT = np.uint64(64 - BITS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1342543DE82EF95)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and, for each n, where each text's run begins: (buckets, bounds (3, texts + 1))."""
    data = _PLAIN[block.data]
    lead = (data & 0xC0) != 0x80
    lead[block.offsets[:-1][block.offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    char = data[at].astype(np.uint64)
    wide = np.flatnonzero(char >= 128)
    for k in (1, 2, 3):  # the bytes that follow a leading byte
        place = at[wide] + k
        ok = place < np.append(at, len(data))[wide + 1]
        wide, place = wide[ok], place[ok]
        char[wide] |= data[place].astype(np.uint64) << np.uint64(8 * k)
    edges = np.searchsorted(at, block.offsets)
    last = np.zeros(len(char) + 2, bool)  # the last character of a text: no n-gram goes past it
    last[edges[1:][edges[1:] > edges[:-1]] - 1] = True
    parts, bounds, gram = [(char * _SPREAD >> _SHIFT).astype(np.int32)], [edges], char
    allowed = np.ones(len(char), bool)
    for n in (2, 3):
        m = max(len(char) - n + 1, 0)
        gram = gram[:m] * _STEP + char[n - 1 :][:m] + np.uint64(1)
        allowed = allowed[:m] & ~last[n - 2 :][:m]
        begin = np.flatnonzero(allowed)
        parts.append((gram[begin] * _SPREAD >> _SHIFT).astype(np.int32))
        bounds.append(np.searchsorted(begin, edges))
    shift = np.cumsum([0, *map(len, parts)])[:-1]
    return np.concatenate(parts), np.stack([b + s for b, s in zip(bounds, shift, strict=True)])


@dataclass
class LanguageModel:
    """weights: (buckets, languages), with the inverse document frequency multiplied in."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.tile(self.bias, (len(column), 1)).astype(float)
        for block in blocks(column):
            buckets, bounds = features(block)
            # Few languages: a column of weights at a time keeps the arrays flat and small.
            count = np.maximum(np.diff(bounds, axis=1).sum(0), 1)
            for k in range(len(self.languages)):
                values = self.weights[k][buckets]
                out[block.lo : block.hi, k] += sum(per_text_sums(values, b) for b in bounds) / count
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and its calibrated probability."""
        p = _softmax(self.logits(column) / self.temperature)
        best = p.argmax(1)
        return best, np.round(p[np.arange(len(best)), best], 6)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def document_frequency(texts: DataFrame, column: str = "text") -> tuple[int, np.ndarray]:
    """Number of rows, and in how many of them each bucket occurs: one row of counts for each task is summed up."""
    ship(texts.sparkSession)

    def counted(batches):
        total, rows = np.zeros(1 << BITS, np.int64), 0
        seen = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            rows += batch.num_rows
            for block in blocks(batch.column(0)):
                buckets, bounds = features(block)
                for i in range(bounds.shape[1] - 1):
                    for b in bounds:
                        seen[buckets[b[i] : b[i + 1]]] = 1
                    total += seen
                    seen[:] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["bucket", "n"])

    table = texts.select(column).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return int(n[bucket < 0].sum()), out


def encode(column: pa.Array) -> list[pa.Array]:
    """The distinct buckets of each text, and their shares of its n-grams."""
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
    counted: list[tuple[np.ndarray, np.ndarray]],
    labels: list[str],
    rows: int,
    frequency: np.ndarray,
    alpha: float = 30.0,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.001,
    min_updates: int = MIN_UPDATES,
) -> LanguageModel:
    """FTRL with elastic net over the examples in the given order, then temperature calibration on those kept back."""
    languages = sorted(set(labels))
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    width = len(languages)
    if not width:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    number = {language: i for i, language in enumerate(languages)}
    y = np.array([number[label] for label in labels])
    values = [(unique, (share * idf[unique]).astype(np.float32)) for unique, share in counted]
    z, n = np.zeros((1 << BITS, width)), np.zeros((1 << BITS, width))
    bias = np.zeros(width)
    fitted = [i for i in range(len(values)) if i % CALIBRATE or len(values) < 4 * CALIBRATE]
    kept_back = [i for i in range(len(values)) if i % CALIBRATE == 0]

    def weights(zf: np.ndarray, nf: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))

    for step in range(max(min_updates, 2 * len(fitted))):
        i = fitted[step % len(fitted)]
        f, x = values[i]
        zf, nf = z[f], n[f]
        w = weights(zf, nf)
        error = _softmax((x @ w + bias)[None])[0]
        error[y[i]] -= 1
        bias -= 0.01 * error
        g = np.outer(x, error)
        grown = nf + g * g
        z[f] = zf + g - (np.sqrt(grown) - np.sqrt(nf)) / alpha * w
        n[f] = grown
    w = weights(z, n)
    model = LanguageModel(languages, np.ascontiguousarray((w * idf[:, None]).T, np.float32), bias)
    logits = np.array([values[i][1] @ w[values[i][0]] + bias for i in kept_back])
    losses = []
    grid = np.geomspace(0.05, 20, 61)
    for t in grid:
        p = _softmax(logits / t)[np.arange(len(kept_back)), y[kept_back]]
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def train(docs: DataFrame, per_class: int = PER_CLASS) -> LanguageModel:
    """Fit on documents whose crc32(doc_id) mod 4 is not 2 and whose lang is not null: the document frequencies over
    all of them, the weights on a bounded sample of each language."""
    rows = docs.where(~held_out_flag(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found, counted = encoded(bounded_sample(rows.select("doc_id", F.col("lang").alias("label")), rows, per_class), encode, ["int", "float"])
    model = fit(counted, found, *document_frequency(rows))
    del counted
    release()
    return model


def identify(df: DataFrame, model: LanguageModel, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language of each whole text and the model's calibrated probability of it."""
    if not model.languages:
        return df.withColumn(predicted, F.lit("und")).withColumn(score, F.lit(0.0))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,p:double>")
    def guessed(column: pa.Array) -> pa.Array:
        best, p = shared.value.predict(column)
        names = pa.array(shared.value.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(p, pa.float64())], ["lang", "p"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # One UDF call gives both results; the struct takes the place of the score until it is taken apart.
    out = df.withColumn(score, F.struct(guessed(F.col(text)).alias("guess"), lettered.alias("lettered")))
    return out.withColumn(predicted, F.when(F.col(f"{score}.lettered"), F.col(f"{score}.guess.lang")).otherwise(F.lit("und"))).withColumn(
        score, F.when(F.col(f"{score}.lettered"), F.col(f"{score}.guess.p")).otherwise(F.lit(1.0))
    )


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out_flag(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
