"""SentencePiece merge encoding with seeded merge-dropout, and its decoding.

A text is cut where no piece can go on (before blanks, around line ends). Inside a part the agenda holds every adjacent
pair whose joined text is a piece; the best score goes first, then the leftmost, and a candidate is skipped for good
where the keyed hash of (seed, variant, part, its bounds) falls below the dropout. As that hash does not depend on when
a candidate comes up, all parts of a batch are worked off side by side: a round merges the best candidate of each. A
text's variant is one of VARIANTS and follows from its bytes, so copies are segmented alike and other texts in other
ways, and parts seen before in the same variant are kept.

Characters without a piece become byte pieces, and so does a literal U+2581, which otherwise stands for a blank:
decoding gives every text back. Defined results: a null text has no pieces and decodes to null; an empty one has none
and decodes to the empty text; repeated rows give equal results; an empty table gives an empty table; other columns
pass through, and a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidebar.llm.textblocks import mix64
from tidebar.session import ship

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DROPOUT = 0.1
SEED = 2024
VARIANTS = 8
#: Parts that a Python worker keeps, of all variants.
CACHED = 250_000

BLANK = "▁"
#: Stands for a literal U+2581 while a text is cut; no UTF-8 text can hold it.
LITERAL = "\udc81"
_LATER = np.int64(2**62)

_codecs: dict[tuple, "PieceCodec"] = {}


class PieceCodec:
    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> None:
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.dropout, self.seed = dropout, seed
        text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = [t.replace(BLANK, " ").encode() for t in text]
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
                self.raw[i] = bytes([int(text[i][3:5], 16)])
        ids = {text[i]: i for i in plain}
        self.char_id = np.full(0x110000, -1, np.int64)
        for t, i in ids.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
        # Equal scores rank alike, so the leftmost of them goes first.
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.n = n
        self.pair = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[p] for p in self.pair], np.int64)
        self.pair_rank = rank[self.joined].astype(np.int64)
        self.known: list[dict[str, bytes]] = [{} for _ in range(VARIANTS)]

    def _candidates(self, a, b, key, start, middle, end) -> tuple[np.ndarray, np.ndarray]:
        """The piece that a and b make (-1: none, or dropped) and its place in the agenda."""
        wanted = np.where((a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        there = self.pair[at] == wanted
        if self.dropout > 0:
            drawn = mix64(mix64(key ^ (start.astype(np.uint64) << np.uint64(32)) ^ middle.astype(np.uint64)) + end.astype(np.uint64))
            there &= drawn >= np.uint64(min(self.dropout, 1.0) * (2**64 - 2**11))
        return np.where(there, self.joined[at], -1), np.where(there, self.pair_rank[at] << 32 | start, _LATER)

    def segment(self, parts: list[str], variant: int) -> list[bytes]:
        """Piece ids of each part as little-endian unsigned 32-bit values."""
        if not parts:
            return []
        size = np.array([len(p) for p in parts])
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(size) - size
        part_key = mix64(np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in parts], np.uint64) + np.uint64(((self.seed * VARIANTS + variant) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        owner = np.repeat(np.arange(len(parts)), size)
        piece = self.char_id[code]
        start = np.arange(len(code)) - first[owner]
        end = start + 1
        made, turn = np.full(len(code), -1, np.int64), np.full(len(code), _LATER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        made[inner], turn[inner] = self._candidates(piece[inner], piece[inner + 1], part_key[owner[inner]], start[inner], start[inner + 1], end[inner + 1])
        done: list[tuple] = []
        while len(owner):
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(head, len(owner)))
            best = np.minimum.reduceat(turn, head)
            busy = np.repeat(best < _LATER, count)
            if not busy.all():
                done.append((owner[~busy], start[~busy], piece[~busy]))
                best = np.repeat(best, count)[busy]
                owner, piece, start, end, made, turn = (x[busy] for x in (owner, piece, start, end, made, turn))
            else:
                best = np.repeat(best, count)
            if not len(owner):
                break
            at = np.flatnonzero(turn == best)
            piece[at], end[at] = made[at], end[at + 1]
            stay = np.ones(len(owner), bool)
            stay[at + 1] = False
            owner, piece, start, end, made, turn = (x[stay] for x in (owner, piece, start, end, made, turn))
            at -= np.arange(len(at))  # one symbol fewer for each merge before
            made[at], turn[at] = -1, _LATER
            right = at[(at + 1 < len(owner)) & (owner[np.minimum(at + 1, len(owner) - 1)] == owner[at])]
            left = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            for x in (left, right):
                made[x], turn[x] = self._candidates(piece[x], piece[x + 1], part_key[owner[x]], start[x], start[x + 1], end[x + 1])
        owner, start, piece = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner * (int(size.max()) + 1) + start)
        owner, start, piece = owner[order], start[order], piece[order]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            spelled = [(BLANK if chr(c) == LITERAL else chr(c)).encode() for c in code[first[owner[odd]] + start[odd]]]
            wide = np.ones(len(piece), np.int64)
            wide[odd] = [len(s) for s in spelled]
            where = np.repeat(piece < 0, wide)
            owner, piece = np.repeat(owner, wide), np.repeat(piece, wide)
            piece[where] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        cut = np.searchsorted(owner, np.arange(len(parts) + 1)) * 4
        raw = piece.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text with its leading blank, cut where no piece goes on: before blanks, and around line ends."""
        if not text:
            return []
        out: list[str] = []
        for i, line in enumerate(text.replace(BLANK, LITERAL).split("\n")):
            if i:
                out.append("\n")
            words = line.split(" ")
            blanks = "" if i else BLANK
            for k, w in enumerate(words):
                if k:
                    blanks += BLANK
                if w or k == len(words) - 1:
                    if blanks or w:
                        out.append(blanks + w)
                    blanks = ""
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, self.known)) > CACHED:
            for kept in self.known:
                kept.clear()
        split = [self.parts(t) for t in texts]
        variant = [zlib.crc32(t.encode()) % VARIANTS for t in texts]
        long: list[tuple] = []
        for v in set(variant):
            known = self.known[v]
            new = [p for p in set().union(*(s for s, own in zip(split, variant, strict=True) if own == v)) if p not in known]
            known.update(zip(new, self.segment(new, v), strict=True))
            long += [(known, p) for p in new if len(p) > 64]
        out = [b"".join(map(self.known[v].__getitem__, s)) for s, v in zip(split, variant, strict=True)]
        for kept, p in long:
            del kept[p]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode()


def codec(path: str, dropout: float, seed: int) -> PieceCodec:
    key = path, dropout, seed
    if key not in _codecs:
        _codecs[key] = PieceCodec(*key)
    return _codecs[key]


def encode_pieces(df: DataFrame, text: str = "text", pieces: str = "pieces", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """df with the array of piece ids of each whole text."""
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        own, out = codec(model, dropout, seed), []
        for at in range(0, len(column), 256):
            part = column.slice(at, 256)
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in own.encode(part.fill_null("").to_pylist())]
            out += [i if ok else None for i, ok in zip(ids, part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.int32()))

    return df.withColumn(pieces, encoded(F.col(text)))


def decode_pieces(df: DataFrame, pieces: str = "pieces", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text that each array of piece ids stands for."""
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        own = codec(model, 0.0, 0)
        return pa.array([None if ids is None else own.decode(np.asarray(ids, np.int64)) for ids in column.to_pylist()], pa.string())

    return df.withColumn(text, decoded(F.col(pieces)))


def piece_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, lossless): the ids are encoded and decoded where they are, and only
    their digests leave the worker."""
    ship(docs.sparkSession)

    def made(batches):
        own = codec(model, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                rows = []
                for t, raw in zip(texts, own.encode([t or "" for t in texts]), strict=True):
                    if t is None:
                        rows.append((0, 0, None, True))
                        continue
                    back = own.decode(np.frombuffer(raw, "<u4"))
                    rows.append((len(raw) // 4, zlib.crc32(raw), zlib.crc32(back.encode()), back == t))
                n, crc, back_crc, same = zip(*rows, strict=True)
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back_crc, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(made, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
