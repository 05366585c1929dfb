"""A bounded, balanced sample of labelled rows, encoded where it lies: a classifier is fitted on the driver from numbers.

Defined results: rows without id, label or text are no examples; ids may be of any type; a doc_id that several rows bear
gives its smallest text; repeated labels count once, and an id with two labels is an example of both; of equally good
rows the smaller id is taken; no labelled row gives an empty sample.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.textblocks import list_views
from tidebar.session import ship, written

#: Bytes of text that the examples of one label have at most, but for the last one, which may go beyond.
LABEL_BYTES = 16 << 20
#: Chosen ids that are broadcast at most; beyond it (very many labels) they are joined by shuffling.
BROADCAST_IDS = 200_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def held_out_flag(doc_id: Column, modulus: int, remainder_held: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == remainder_held, F.lit(False))


def bounded_sample(keyed: DataFrame, docs: DataFrame, per_class: int, label_bytes: int = LABEL_BYTES) -> DataFrame:
    """(h, label, text): at most per_class whole texts of each label, and of label_bytes in all.

    keyed has doc_id and label. The rows with the smallest hashes h of doc_id are taken, so the choice does not depend on
    partitioning. Labels are ranked in one pass, in which each task keeps per_class rows of a label at most, and the texts
    of the chosen ids are read in another.
    """
    keyed = keyed.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", "label").distinct()
    first = Window.partitionBy("label").orderBy("h", "doc_id")
    ranked = keyed.withColumn("h", F.xxhash64("doc_id")).withColumn("k", F.row_number().over(first))
    chosen = written(ranked.where(F.col("k") <= per_class).select("doc_id", "label", "h"), "chosen")
    ids = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(ids, "doc_id")
    texts = texts.groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    return written(texts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < label_bytes).select("h", "label", "text"), "sample")


def encoded(sample: DataFrame, encode: Callable[[pa.Array], list[pa.Array]], kinds: list[str]) -> tuple[list, list[tuple[np.ndarray, ...]]]:
    """Labels and rows of the sample in the order of h, a fixed shuffle. encode turns a column of texts into list columns
    of the kinds given, and a row has a view of each of its lists: what the executors sent is held once."""
    ship(sample.sparkSession)
    label = sample.schema["label"].dataType.simpleString()
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *encode(part.column(2))], ["h", "label", *names])

    schema = ", ".join([f"h long, label {label}", *[f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True)]])
    table = sample.select("h", "label", "text").mapInArrow(run, schema).toArrow()
    labels, h, rows = table["label"].to_pylist(), table["h"].to_pylist(), []
    for batch in table.select(names).to_batches():
        rows += zip(*[list_views(c) for c in batch.columns], strict=True)
    order = sorted(range(len(rows)), key=lambda i: (h[i], str(labels[i])))
    return [labels[i] for i in order], [rows[i] for i in order]


def release() -> None:
    """Give memory that fitting no longer needs back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
