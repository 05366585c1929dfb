"""Packing documents into training sequences by minimum bin slack.

A document is its token ids and a closing id; one longer than the capacity is cut into pieces of that many tokens. Bins
are planned from the histogram of piece lengths alone, which has at most `capacity` entries however many documents
there are: the longest length left opens a bin, a bitset subset-sum over the lengths left finds the fullest
combination for the rest, and the combination is taken as often as its lengths last. Pieces are then numbered within
their length, without gathering a length in one task, and look their place up in the plan.

Defined results: a null text counts as empty and is the closing id alone; repeated rows are packed each for itself; an
empty table gives an empty table; only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebar.session import ship, written

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLOSING_ID = 0
#: Entries of the word cache of a Python worker.
CACHED_WORDS = 300_000
#: Pieces of one length that a task numbers, about.
NUMBERED = 100_000

_encoders: dict[str, "WordEncoder"] = {}


# Fixed values of the tokenizer's own split, for lower-cased words of printable ASCII and composed Latin-1 letters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """What byte-level merges write for a Latin-1 letter: printable bytes stand for themselves, others for 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit values. The tokenizer's merges never go over white space,
    so the parts between blanks and line ends are encoded apart and kept. A plain word's split is done here and its
    parts go to the tokenizer's model alone, which saves it the normalising of each new word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = _Words(self.word)
        self.parts: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one part between blanks."""
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self._part, _SPLIT.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]).tobytes()
            self.parts[part] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        for kept in (self.known, self.parts):
            if len(kept) > CACHED_WORDS:
                kept.clear()
        found = self.known.__getitem__
        return [b"".join(map(found, t.replace("\n", " ").split(" "))) for t in texts]


class _Words(dict):
    """Words and their ids; a word that is not there is encoded, and kept unless it is long."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenized_pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with keep_ids also ids."""
    ship(docs.sparkSession)
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def cut(batches):
        own = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(1).fill_null("").to_pylist()
                rows: list[tuple] = []
                for i, ids in enumerate(own.encode(texts)):
                    ids += closing
                    for n, low in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[low : low + 4 * capacity]
                        rows.append((i, n, low // 4, len(piece) // 4, zlib.crc32(piece), piece))
                owner, number, start, length, crc, pieces = zip(*rows, strict=True)
                arrays = [part.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def fullest(room: int, left: dict[int, int]) -> Counter:
    """The combination of lengths (as often as each is left) with the largest sum up to room.

    Bit s of `sums` says that the sum s can be made. Longer lengths come first and the search ends as soon as room is
    met exactly, so few long pieces are preferred to many short ones.
    """
    mask = (1 << room + 1) - 1
    sums, steps, goal = 1, [], 1 << room
    for length in sorted((x for x in left if x <= room), reverse=True):
        most, taken = min(left[length], room // length), 1
        while most > 0 and not sums & goal:
            n = min(taken, most)  # 1, 2, 4, ... and the rest: every number up to most can be made
            steps.append((sums, length, n))
            sums |= sums << n * length & mask
            most -= n
            taken *= 2
        if sums & goal:
            break
    at, out = sums.bit_length() - 1, Counter()
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            out[length] += n
            at -= n * length
    return out


@dataclass
class Plan:
    """Entry e places the pieces of length key[e] >> 40 from number key[e] & (2**40 - 1) on: `times` bins from bin
    `first` on take one each, at `offset`, then one more each, a length further."""

    key: np.ndarray
    times: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.searchsorted(self.key, (length << 40) + number, "right") - 1
        turn = number - (self.key[e] & ((1 << 40) - 1))
        return self.first[e] + turn % self.times[e], self.offset[e] + turn // self.times[e] * length


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Each bin holds the longest length left and the fullest combination beside it. A combination is taken for as
    many bins as its lengths last, so the work is bounded by the number of lengths, not of pieces."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    used: Counter = Counter()
    entries: list[tuple[int, int, int, int]] = []
    bins = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(capacity - longest, {k: v for k, v in left.items() if v})
        left[longest] += 1
        chosen[longest] += 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            entries.append(((length << 40) + used[length], times, bins, offset))
            offset += n * length
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    key, times, first, offset = (np.array(x, np.int64) for x in (zip(*sorted(entries), strict=True) if entries else ((), (), (), ())))
    return Plan(key, times, first, offset, bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. It is read more than once, so it should be a table, not a long plan.

    A piece as long as the capacity is a sequence for itself and needs no number within its length.
    """
    spark = pieces.sparkSession
    ship(spark)
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}  # at most `capacity` rows
    groups = max(16, -(-max(histogram.values(), default=0) // NUMBERED))
    part = part.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    counts = part.groupBy("length", "_group").agg(F.count("*").alias("_n")).select("length", "_group", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = part.join(counts, ["length", "_group"]).withColumn("_number", F.col("_before") + within)
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacity))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pa.Array, number: pa.Array) -> pa.Array:
        where, offset = plan.value.place(length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(where, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    numbered = numbered.withColumn("_place", placed("length", "_number"))
    columns = pieces.columns
    return whole.unionByName(numbered.select(*columns, "_place.sequence_id", "_place.offset"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return pack(written(tokenized_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
