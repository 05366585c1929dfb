"""SimHash near-duplicates: fingerprints linked within a Hamming radius, found with vantage-point trees.

A tree over a bounded sample of fingerprints cuts the space into shards. Each fingerprint has one home shard; one that
lies outside a vantage point's sphere, but within the radius of it, is sent inside as a query too, and goes on to every
shard that the triangle inequality does not rule out. So each pair within the radius meets in exactly the home shard of
one of the two. In a shard the same splitting goes on until few are left, which are compared. Equal fingerprints count
once, a shard returns a spanning forest of its links and not the links, and components are found on fingerprints.

Defined results: a null, empty or white-space text has fingerprint zero, which is linked like any other; fewer than
three words are one shingle; repeated rows keep their rows and share a component; a null doc_id is never the smallest;
an empty table gives an empty table; only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.links import components
from tidebar.session import ship, written

WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints a shard has, about; the tree is built from SAMPLED fingerprints a shard, and by the driver: beyond
#: SHARDS of them (300 million distinct fingerprints) shards grow with the data, and what they find stays the same.
SHARD = 5_000
SHARDS = 65_536
SAMPLED = 24
#: At most so many are compared one with another without a further split.
FEW = 256
#: From so many on, looking up all words within the radius costs less than comparing.
DENSE = 60_000


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, the highest bit first: a bit is 1 if more than half of the shingles' hashes have it."""
    parts = text.lower().split()
    if not parts:
        return bytes(8)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        hashes = digest(joined, seed)
    else:
        ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 14):
        total += np.unpackbits(rows[i : i + (1 << 14)], axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * total > len(rows)).tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint of each whole text as a signed long."""
    ship(docs.sparkSession)

    def computed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = b"".join([fingerprint(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.frombuffer(raw, ">u8").astype("<u8").view(np.int64))], ["doc_id", "bits"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(computed, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, bits long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree: node i has point[i] and mu[i]; what is at most mu away goes to low[i], the rest to high[i].
    A child number below zero is shard -1 - number."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        self.point: list = []
        self.mu: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.shards = 0
        self.root = self._grow(np.unique(sample), shards)

    def _grow(self, own: np.ndarray, shards: int) -> int:
        if shards > 1 and len(own) > 1:
            point = own[len(own) // 2]
            d = _distance(own, point)
            mu = int(np.median(d))
            inside = d <= mu
            if inside.all():
                mu -= 1
                inside = d <= mu
            if inside.any() and not inside.all():
                node = len(self.point)
                self.point.append(point)
                self.mu.append(mu)
                self.low.append(0)
                self.high.append(0)
                some = max(1, min(shards - 1, round(shards * inside.mean())))
                self.low[node] = self._grow(own[inside], some)
                self.high[node] = self._grow(own[~inside], shards - some)
                return node
        self.shards += 1
        return -self.shards

    def route(self, own: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, fingerprints, which of them are at home there)."""
        out, todo = [], [(self.root, own, np.ones(len(own), bool))]
        while todo:
            node, some, home = todo.pop()
            if not len(some):
                continue
            if node < 0:
                out.append((-1 - node, some, home))
                continue
            d, mu = _distance(some, self.point[node]), self.mu[node]
            low, high = d <= mu, d > mu
            inner = low | (d <= mu + radius)  # from outside, as queries
            outer = np.where(home, high, d > mu - radius)
            todo.append((self.low[node], some[inner], (home & low)[inner]))
            todo.append((self.high[node], some[outer], home[outer]))
        return out


def near_pairs(home: np.ndarray, others: np.ndarray, radius: int):
    """Yields (positions in home, positions in others) of all pairs at most radius apart; others may be home itself."""
    if len(home) > DENSE and radius <= 2:
        order = np.argsort(home)
        sorted_home = home[order]
        for flipped in (c for n in range(radius + 1) for c in combinations(range(64), n)):
            m = np.uint64(sum(1 << bit for bit in flipped))
            at = np.minimum(np.searchsorted(sorted_home, others ^ m), len(home) - 1)
            hit = np.flatnonzero(sorted_home[at] == others ^ m)
            yield order[at[hit]], hit
        return
    step = max(1, (1 << 20) // max(len(home), 1))
    for i in range(0, len(others), step):
        b, a = np.nonzero(_distance(others[i : i + step, None], home[None, :]) <= radius)
        yield a, b + i


class Forest:
    """A spanning forest over sorted vertices, grown by arrays of links."""

    def __init__(self, everyone: np.ndarray) -> None:
        self.everyone, self.parent, self.out = everyone, np.arange(len(everyone)), []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of a[i] and b[i], all at once, and note the links that joined two trees."""
        parent = self.parent
        x, y = np.searchsorted(self.everyone, a), np.searchsorted(self.everyone, b)
        while True:
            rx, ry = parent[x], parent[y]
            apart = np.flatnonzero(rx != ry)
            if not len(apart):
                return
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            high, low = np.maximum(rx, ry), np.minimum(rx, ry)
            root, first = np.unique(high, return_index=True)
            parent[root] = low[first]  # each root is hung under one smaller root: no circle
            self.out.append(np.stack([self.everyone[x[first]], self.everyone[y[first]]], 1))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up

    def edges(self) -> np.ndarray:
        return np.concatenate(self.out) if self.out else np.zeros((0, 2), self.everyone.dtype)


def shard_links(home: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest, as (n, 2) fingerprints, of all links within home and between home and queries."""
    grown = Forest(np.unique(np.concatenate([home, queries])))
    todo = [(home, queries)]
    while todo:
        own, asked = todo.pop()
        if not len(own):
            continue
        split = None
        if len(own) > FEW:
            point = own[len(own) // 2]
            d, e = _distance(own, point), _distance(asked, point)
            mu = int(np.median(d))
            if (d <= mu).all():
                mu -= 1
            low = d <= mu
            near, far = np.concatenate([asked[e <= mu + radius], own[~low & (d <= mu + radius)]]), asked[e > mu - radius]
            work = low.sum() * (low.sum() / 2 + len(near)) + (~low).sum() * ((~low).sum() / 2 + len(far))
            if low.any() and not low.all() and work < 0.8 * len(own) * (len(own) / 2 + len(asked)):
                split = [(own[low], near), (own[~low], far)]
        if split:
            todo += split
            continue
        for others in (own, asked):
            for a, b in near_pairs(own, others, radius):
                grown.link(own[a], others[b])
    return grown.edges()


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column bits) that connect all within the radius of each other."""
    spark = distinct.sparkSession
    ship(spark)
    shards = int(min(SHARDS, max(1, -(-distinct.count() // SHARD))))
    sample = distinct.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(SAMPLED * shards).toArrow()["bits"].to_numpy()
    tree = spark.sparkContext.broadcast(Tree(sample.astype(np.int64).view(np.uint64), shards))

    def routed(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for shard, some, home in tree.value.route(own, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, np.int32)), pa.array(some.view(np.int64)), pa.array(home)], ["shard", "bits", "home"])

    def met(table: pa.Table) -> pa.Table:
        bits, home = table["bits"].to_numpy().view(np.uint64), table["home"].to_numpy()
        found = shard_links(bits[home], bits[~home], radius).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return distinct.select("bits").mapInArrow(routed, "shard int, bits long, home boolean").groupBy("shard").applyInArrow(met, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, bits, component_id) for each row: component_id is the smallest doc_id that links reach."""
    marked = written(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = written(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct", few=True)
    parts = components(fingerprint_links(distinct, radius))
    rooted = distinct.join(parts, distinct["bits"] == parts["vertex"], "left").select("bits", "least", F.coalesce("component", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(smallest, "root").select("bits", "component_id"), "bits").select("doc_id", "bits", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
