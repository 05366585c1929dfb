"""Near-duplicates by word-shingle sets: SimHash fingerprints give candidates, exact sets decide.

Texts (A-Z lower-cased, split at white space) become sets of hashed shingles; equal sets count once. A set has a
fingerprint of 256 bits, whose first word goes through op9's vantage-point tree: each word has one home shard and asks in
every other one that the triangle inequality does not rule out. A set's size decides too: of two similar sets neither
has more than 1 / similarity times the other's shingles, so a shard is cut into classes of size, of which only the same
and the next one meet. Sets whose first words, first two words and whole fingerprints are within radii of six to seven
deviations are candidates, and components of candidates are groups. Only texts in a group are read a second time, and there each is
linked with every other one whose sets reach the similarity. By the binomial law a pair at 0.8 is no candidate with a
probability below 1 in a million (5 in a million for sets of four and five shingles, where ties are most frequent); inside a
group nothing is missed. At this radius the tree rules out hardly any shard: what saves comparing is size, and the work
grows with the square of the distinct sets, about 3 ns for each pair of like size.

A group of few sets is one task's work. A larger one is compared with a pivot first, by as many tasks as it has sets for:
what reaches it is linked, and of these all that no other member can reach, by the triangle inequality of Jaccard
distances, are done with. That goes on until few are left; should many be left after all, tiles of them meet pairwise, so
no task gathers a group.

Defined results: a null, empty or white-space text has the empty set, which equals itself alone; fewer words than a
shingle has are one shingle; repeated rows keep their rows and share a component; a null doc_id is never the smallest;
an empty table gives an empty table; only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

from itertools import accumulate
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.hot import join_hot
from tidebar.llm.links import components
from tidebar.llm.simhash import SAMPLED, Forest, Tree
from tidebar.llm.textblocks import mix64
from tidebar.session import ship, written

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Words of 64 bits that a fingerprint has; the deviations of the bits that differ, in the first word, the first two and
#: all, within which a pair at the similarity lies.
FINGERPRINT = 4
DEVIATIONS = {1: 6.1, 2: 7.1, FINGERPRINT: 7.2}
#: The tree has a shard for each so many of the root of the number of sets: copies of a set grow with the root as well.
ROOT = 60
#: Vantage points around which large clusters are linked before a shard is compared, and the share that is one.
VANTAGE = 8
CLUSTER = 1 / 16
#: Keys or texts that are broadcast at most (8 bytes each); beyond it they are joined by shuffling.
BROADCAST_KEYS = 500_000
#: Sets that one task gathers at most, about (100 MB of sets of 600 words), and the rounds with a pivot before a group is
#: cut into tiles.
GATHERED = 20_000
ROUNDS = 8

_SALTS = mix64(np.arange(1, 2 * FINGERPRINT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :])], np.uint64))


def set_key(own: np.ndarray) -> int:
    """Stands for a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """FINGERPRINT words: a bit is 1 if more than half of the hashes have it; a tie is settled by the smallest hash."""
    votes = np.zeros(64 * FINGERPRINT, np.int64)
    if not len(own):
        return np.zeros(FINGERPRINT, np.uint64)
    for at in range(0, len(own), 4096):
        drawn = mix64(own[at : at + 4096, None] ^ _SALTS[:FINGERPRINT])
        votes += np.unpackbits(drawn.view(np.uint8), axis=1).sum(0, dtype=np.uint32)
    settled = np.unpackbits(mix64(own[0] ^ _SALTS[FINGERPRINT:]).view(np.uint8))
    return np.packbits(2 * votes + settled > len(own)).view(np.uint64)


def radii(similarity: float) -> tuple[int, ...]:
    """So many bits of the first word, the first two and all differ at most, but for DEVIATIONS, at the similarity."""
    p = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return tuple(int(64 * n * p + d * sqrt(64 * n * p * (1 - p))) for n, d in DEVIATIONS.items())


def size_class(size: int, similarity: float) -> int:
    """Of sets that reach the similarity the classes are the same or neighbours; -1: only an equal set reaches it."""
    apart = max(1 - similarity, 1e-9)
    if size < ceil(similarity / apart - 1e-9):
        return -1
    return int(log(size) / (-log(1 - apart) * (1 + 1e-9)))


def placed(tree: Tree, own: np.ndarray, home: bool, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places in own, which of them are at home there); without home, all ask in each shard within the radius."""
    out, todo = [], [(tree.root, np.arange(len(own)), np.full(len(own), home))]
    while todo:
        node, at, homes = todo.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((-1 - node, at, homes))
            continue
        d, mu = np.bitwise_count(own[at] ^ tree.point[node]).astype(np.int16), tree.mu[node]
        low, high = d <= mu, d > mu
        inner = d <= mu + radius  # from outside, as queries
        outer = np.where(homes, high, d > mu - radius)
        todo.append((tree.low[node], at[inner], (homes & low)[inner]))
        todo.append((tree.high[node], at[outer], homes[outer]))
    return out


def candidate_links(own: np.ndarray, asked: np.ndarray, within: tuple[int, ...]) -> np.ndarray:
    """A spanning forest, as (n, 2) places in own and then asked, of all pairs within own and between own and asked whose
    first words, first two words and whole fingerprints are within those radii.

    What is near a vantage point is linked with it; where that is a large share, it is not compared among itself."""
    radius, two, whole = within
    words = np.concatenate([own, asked])
    grown = Forest(np.arange(len(words)))
    first, second = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])

    def compare(a: np.ndarray, b: np.ndarray | None = None) -> None:
        """All of a with all of b, or with each other."""
        if not len(a):
            return
        others = a if b is None else b
        step = max(1, (1 << 16) // len(a))
        for i in range(0, len(others), step):
            y, x = others[i : i + step], a[i:] if b is None else a
            d = np.bitwise_count(first[y][:, None] ^ first[x][None, :]).ravel()
            hit = np.flatnonzero(d <= radius)
            i_y, i_x = np.divmod(hit.astype(np.uint32), np.uint32(len(x)))
            y, x = y[i_y], x[i_x]
            some = np.flatnonzero(d[hit] + np.bitwise_count(second[y] ^ second[x]) <= two)
            if len(some):
                y, x = y[some], x[some]
                some = np.bitwise_count(words[y] ^ words[x]).sum(1) <= whole
                grown.link(y[some], x[some])

    inside, outside = np.arange(len(own)), np.arange(len(own), len(words))
    for i in range(VANTAGE):
        if not len(inside):
            break
        point = inside[(i + 1) * len(inside) // (VANTAGE + 1)]
        near = np.bitwise_count(words ^ words[point]).sum(1) <= whole
        a, b = inside[near[inside]], outside[near[outside]]
        if len(a) + len(b) > max(1, CLUSTER * (len(inside) + len(outside))):
            grown.link(np.full(len(a) + len(b), point), np.concatenate([a, b]))
            inside, outside = inside[~near[inside]], outside[~near[outside]]
            compare(a, np.concatenate([inside, outside]))
            compare(inside, b)
    compare(inside)
    compare(inside, outside)
    return grown.edges()


def candidates(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between sets (bits, class, words) that connect all whose fingerprints are within the radii."""
    spark = sets.sparkSession
    within = radii(similarity)
    shards = max(1, ceil(sqrt(sets.count()) / ROOT))
    word = F.element_at("words", 1).alias("word")
    sample = sets.select(word, "bits").orderBy(F.xxhash64("bits"), "bits").limit(SAMPLED * shards).toArrow()["word"].to_numpy()
    tree = spark.sparkContext.broadcast(Tree(sample.astype(np.int64).view(np.uint64), shards))
    columns = [f"w{i}" for i in range(FINGERPRINT)]

    def routed(batches):
        for batch in batches:
            first = batch.column(2).to_numpy().view(np.uint64)
            for home in (True, False):
                for shard, at, homes in placed(tree.value, first, home, within[0]):
                    part = batch.take(pa.array(at))
                    classes = part.column(1).to_numpy() - (not home)  # the class below is asked as well
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), shard, np.int32)), pa.array(classes.astype(np.int32)), pa.array(homes), part.column(0), *part.columns[2:]],
                        ["shard", "class", "home", "bits", *columns],
                    )

    def met(table: pa.Table) -> pa.Table:
        words = np.stack([table[c].to_numpy().view(np.uint64) for c in columns], 1)
        home, bits = table["home"].to_numpy(), table["bits"].to_numpy()
        found = candidate_links(words[home], words[~home], within)
        bits = np.concatenate([bits[home], bits[~home]])
        return pa.table({"a": bits[found[:, 0]], "b": bits[found[:, 1]]})

    source = sets.select("bits", "class", *[F.element_at("words", i + 1).alias(c) for i, c in enumerate(columns)])
    kinds = ", ".join(f"{c} long" for c in columns)
    return source.mapInArrow(routed, f"shard int, class int, home boolean, bits long, {kinds}").groupBy("shard", "class").applyInArrow(met, "a long, b long")


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the number of the first one it is connected with, over all pairs that reach the similarity.

    The rarest shingles of a set come first; of two similar sets each has one of the other's first few. A breadth-first
    search compares a set only with those not reached yet."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    everything, code, count = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(everything), np.int64)
    rank[np.lexsort((everything, count))] = np.arange(len(everything))
    value = rank[code]
    order = np.lexsort((value, owner))
    value = value[order]
    begin = np.cumsum(size) - size
    first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    chosen = (np.arange(len(value)) - np.repeat(begin, size)) < np.repeat(first, size)
    who, what = owner[chosen], value[chosen]
    by = np.argsort(what, kind="stable")
    who, what = who[by], what[by]
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], todo = seed, [seed]
        while todo:
            i = todo.pop()
            own = value[begin[i] : begin[i] + size[i]]
            key = own[: first[i]]
            runs = [who[a:b] for a, b in zip(np.searchsorted(what, key), np.searchsorted(what, key, "right"), strict=True)]
            other = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.int64)
            other = other[root[other] < 0]
            other = other[(size[other] >= similarity * size[i] - 1e-9) & (size[i] >= similarity * size[other] - 1e-9)]
            for j in other.tolist():
                both = len(np.intersect1d(own, value[begin[j] : begin[j] + size[j]], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                    root[j] = seed
                    todo.append(j)
    return root


def _some(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _sizes(todo: DataFrame) -> DataFrame:
    """The parts in which each large group is dealt out: those of more than GATHERED sets."""
    return todo.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > GATHERED).select("component", F.ceil(F.col("n") / GATHERED).cast("int").alias("parts"))


def _against_pivots(todo: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """One round for the groups of todo (component, bits, shingles, linked), all large: links (bits, root) with a pivot of
    each, and the members that are left. The pivot is one that no pivot reached yet, where there is one."""
    parts = _sizes(todo)
    salted = todo.join(F.broadcast(parts), "component").withColumn("salt", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))  # groups of over GATHERED sets
    first = F.struct("linked", F.xxhash64("bits").alias("h"), "bits")
    chosen = todo.groupBy("component").agg(F.min(first).alias("p")).select("component", F.col("p.bits").alias("bits"))
    pivots = todo.join(F.broadcast(chosen), ["component", "bits"]).join(F.broadcast(parts), "component")
    pivots = pivots.select(F.col("component").alias("p_component"), F.col("bits").alias("pivot"), F.col("shingles").alias("p_shingles"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_salt"))

    def measured(members: pa.Table, pivot: pa.Table) -> pa.Table:
        own = np.frombuffer(pivot["p_shingles"][0].as_py(), np.uint64)
        distance: list[float] = []
        if not len(members):  # a part that no member fell into
            return pa.table({"component": pa.array([], pa.int64()), "bits": pa.array([], pa.int64()), "shingles": pa.array([], pa.binary()), "linked": pa.array([], pa.bool_()), "pivot": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        for raw in members["shingles"].to_pylist():
            other = np.frombuffer(raw, np.uint64)
            both = len(np.intersect1d(own, other, assume_unique=True))
            distance.append(1 - both / max(len(own) + len(other) - both, 1))
        return members.select(["component", "bits", "shingles", "linked"]).append_column("pivot", pa.array([pivot["pivot"][0].as_py()] * len(members), pa.int64())).append_column("d", pa.array(distance, pa.float64()))

    found = salted.groupBy("component", "salt").cogroup(pivots.groupBy("p_component", "p_salt")).applyInArrow(measured, "component long, bits long, shingles binary, linked boolean, pivot long, d double")
    found = written(found, "measured")
    reach = 1 - similarity + 1e-9
    nearest = found.where(F.col("d") > reach).groupBy("component").agg(F.min("d").alias("nearest"))
    left = found.where("bits <> pivot").join(F.broadcast(nearest), "component").where((F.col("d") > reach) | (F.col("d") >= F.col("nearest") - reach))
    links = found.where((F.col("d") <= reach) & (F.col("bits") != F.col("pivot"))).select("bits", F.col("pivot").alias("root"))
    return links, left.select("component", "bits", "shingles", (F.col("linked") | (F.col("d") <= reach)).alias("linked"))


def near_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, bits, root, component_id) for each row: component_id is the smallest doc_id that links reach, root tells
    groups apart (rows of one doc_id can be in several), bits the set's key, th the hash of the text."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def marked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, words) for t in part.column(2).to_pylist()]
                bits, classes = pa.array([set_key(s) for s in sets], pa.int64()), pa.array([size_class(len(s), similarity) for s in sets], pa.int32())
                drawn = pa.array([fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bits, classes, drawn], ["doc_id", "th", "bits", "class", "words"])

    def shown(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t, words) for t in batch.slice(at, 512).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["bits", "shingles"])

    def met(table: pa.Table) -> pa.Table:
        bits = table["bits"].to_numpy()
        root = linked([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()], similarity)
        return pa.table({"bits": bits, "root": bits[root]})

    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw).alias("th"), raw.alias("text"))
    rows = written(source.mapInArrow(marked, f"doc_id {kind}, th long, bits long, class int, words array<long>"), "shingled")
    sets = written(rows.where("class >= 0").groupBy("bits").agg(F.first("class").alias("class"), F.first("words").alias("words")), "sets", few=True)
    groups = written(components(candidates(sets, similarity)), "groups", few=True)
    wanted = written(rows.select("bits", "th").join(_some(groups.select(F.col("vertex").alias("bits"))), "bits").groupBy("bits").agg(F.min("th").alias("th")).select("th"), "wanted", few=True)
    again = source.join(_some(wanted), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")).select("text")
    held = again.mapInArrow(shown, "bits long, shingles binary").join(groups.withColumnRenamed("vertex", "bits"), "bits").select("component", "bits", "shingles", F.lit(False).alias("linked"))
    large = written(_sizes(groups), "large", few=True)
    if large.isEmpty():
        found = written(held.groupBy("component").applyInArrow(met, "bits long, root long").where("bits <> root"), "linked")
    else:
        held = written(held, "held")
        links = [held.join(F.broadcast(large), "component", "left_anti").groupBy("component").applyInArrow(met, "bits long, root long")]
        todo = held.join(F.broadcast(large), "component", "left_semi")
        for _ in range(ROUNDS):
            some, left = _against_pivots(todo, similarity)
            left = written(left, "left")
            many = _sizes(left)
            links += [some, left.join(F.broadcast(many), "component", "left_anti").groupBy("component").applyInArrow(met, "bits long, root long")]
            todo = left.join(F.broadcast(many), "component", "left_semi")
            if todo.isEmpty():
                break
        else:
            tile = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
            cut = todo.join(F.broadcast(_sizes(todo)), "component").withColumn("i", tile)
            met_by = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("i", j).alias("l"), F.greatest("i", j).alias("r"))))
            links.append(cut.select("component", "bits", "shingles", met_by.alias("t")).groupBy("component", "t").applyInArrow(met, "bits long, root long"))
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        found = components(edges.where("bits <> root"), "bits", "root").select(F.col("vertex").alias("bits"), F.col("component").alias("root"))
    distinct = rows.groupBy("bits").agg(F.min("doc_id").alias("least"))
    rooted = distinct.join(found, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    near = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    parts = rooted.join(near, "root").select("bits", "root", "component_id")
    counted = rows.groupBy("bits").agg(F.count("*").alias("n"))
    known = written(parts.join(counted, "bits"), "known", few=True)
    return join_hot(rows.select("doc_id", "th", "bits"), known, ["bits"], F.xxhash64("doc_id", "th")).select("doc_id", "th", "bits", "root", "component_id")
