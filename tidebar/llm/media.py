"""Media columns: payloads stored as progressive JPEG files, read back, and their full-resolution RGB tensors.

Defined results: a null or empty text is padded to one unit of 255s; equal texts have equal values throughout; repeated
rows are stored each for itself; an empty table gives an empty table; only the id and text columns are read, so other
columns never clash. `rgb_column` gives null for a null file and fails on bytes that are no JPEG.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import jpeg
from tidebar.session import ship

#: Bytes of payload that are decoded together, at least where there are as many.
TOGETHER = 1 << 19

FIELDS = "doc_id {0}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of the unit."""
    return text + b"\xff" * (max(1, -(-len(text) // jpeg.UNIT)) * jpeg.UNIT - len(text))


def feature(rgb: np.ndarray) -> str:
    """Shape, and mean and deviation of each channel, as text."""
    flat, level = rgb.reshape(-1, 3), np.arange(256)
    told = []
    for k in range(3):
        share = np.bincount(flat[:, k], minlength=256) / len(flat)
        mean = share @ level
        told.append(f"{mean:.3f}/{np.sqrt(share @ (level - mean) ** 2):.3f}")
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(told)


def stored_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """The digests of each row's stored payload; with keep also `media` (the file) and `rgb` (its tensor's bytes,
    row by row; the feature begins with its width and height)."""
    ship(docs.sparkSession)

    def groups(texts: list[bytes]):
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER:
                yield lo, i + 1
                lo, size = i + 1, 0
        if lo < len(texts):
            yield lo, len(texts)

    def made(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                for lo, hi in groups(texts):
                    files = [jpeg.store(payload(t)) for t in texts[lo:hi]]
                    images = [jpeg.parse(f) for f in files]
                    jpeg.decode(images)
                    rows = []
                    for t, f, image, samples in zip(texts[lo:hi], files, images, jpeg.planes(images), strict=True):
                        back, rgb = jpeg.read_back(image), jpeg.tensor(image, samples)
                        row = (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(rgb))
                        rows.append(row + ((f, rgb.tobytes()) if keep else ()))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "rgb"]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), *columns], ["doc_id", *names[: len(columns)]])

    schema = FIELDS.format(docs.schema[doc_id].dataType.simpleString()) + ", media binary, rgb binary" * keep
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(made, schema)


def rgb_column(df: DataFrame, media: str = "media", rgb: str = "rgb") -> DataFrame:
    """df with the decoded tensor of a column of JPEG files: struct<height, width, data>."""
    ship(df.sparkSession)

    @F.arrow_udf("struct<height:int,width:int,data:binary>")
    def decoded(column: pa.Array) -> pa.Array:
        files = column.to_pylist()
        some = iter(jpeg.rgb_tensors([f for f in files if f is not None]))
        out = [None if f is None else (lambda t: {"height": t.shape[0], "width": t.shape[1], "data": t.tobytes()})(next(some)) for f in files]
        return pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

    return df.withColumn(rgb, decoded(F.col(media)))


def op5_media(spark, sf_dir: str) -> DataFrame:
    return stored_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
