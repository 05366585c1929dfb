"""Near-duplicate embeddings by product quantisation.

Unit vectors belong to the inverted list of their nearest coarse centre, and their residual is coded by subspace. A
vector asks its own list and every other whose border (the plane halfway between two centres) is within reach of the
link radius: no pair can be missed, so that is what sufficient probes are. In a list, distances come from per-subspace
tables (asymmetric: the asking vector is not coded); a pair whose table distance, less the coding error that is kept
with the stored vector, exceeds the radius is no link, and the rest are decided by their exact cosine in doubles.

Equal vectors of a label count once. A list with many vectors is cut into tiles of bounded size. A tile gives each
asking vector's number of links and a spanning forest, never the links, and components are found on the forest.

Defined results: a vector with a null or zero or non-finite content, or without a label, links with nothing, and so does
a row without vec_id (its component is null and it is not kept); vectors of different lengths do not link; rows that
repeat a vec_id and vector are one vector and each get the same result; an empty table gives an empty table; only the
id, vector and label columns are read, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.links import components
from tidebar.llm.simhash import Forest
from tidebar.session import ship, written

THRESHOLD = 0.98
LISTS = 32
SUBSPACES = 8
CODES = 128
#: Vectors the index is fitted on, at most; every vector is indexed.
FITTED = 8192
#: Stored and asking vectors of a tile, about.
STORED, ASKING = 1500, 3000


def _means(points: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Lloyd's k-means from a seeded start; a centre that loses all its points stays."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _squared(points, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(0)
    return centres


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


@dataclass
class Index:
    width: int
    coarse: np.ndarray
    books: list[np.ndarray]
    radius: float

    def fitted_part(self, vectors: np.ndarray) -> np.ndarray:
        """The coordinates that the index sees: shorter vectors have zeros behind, longer ones are cut. Distances only
        fall by that, so what is ruled out stays ruled out."""
        out = np.zeros((len(vectors), self.width))
        out[:, : vectors.shape[1]] = vectors[:, : self.width]
        return out

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each vector, and which lists it has to ask (rows x lists)."""
        d = _squared(x, self.coarse)
        home = d.argmin(1)
        between = np.sqrt(_squared(self.coarse, self.coarse))[home]
        gap = (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * between, 1e-12)
        return home, gap <= self.radius + 1e-9

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each subspace, and the distance between the residual and what the codes stand for."""
        codes, error = [], np.zeros(len(residual))
        for part, book in zip(self.parts(residual), self.books, strict=True):
            d = _squared(part, book)
            codes.append(d.argmin(1).astype(np.uint8))
            error += d.min(1)
        return np.stack(codes, 1), np.sqrt(error)

    def table_distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of uncoded residuals (rows) to coded ones (columns), summed from one table for each subspace."""
        total = np.zeros((len(residual), len(codes)), np.float32)
        for m, (part, book) in enumerate(zip(self.parts(residual), self.books, strict=True)):
            total += _squared(part, book).astype(np.float32)[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def fit_index(sample: np.ndarray, threshold: float = THRESHOLD, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
    coarse = _means(sample, lists)
    residual = sample - coarse[_squared(sample, coarse).argmin(1)]
    books = [_means(part, codes) for part in np.array_split(residual, min(subspaces, sample.shape[1]), axis=1)]
    return Index(sample.shape[1], coarse, books, float(np.sqrt(2 - 2 * threshold)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def tile_links(index: Index, centre: int, stored: np.ndarray, asking: np.ndarray, threshold: float):
    """Yields (positions in asking, positions in stored) of pairs with the cosine wanted. Both are unit vectors."""
    base = index.coarse[centre]
    codes, error = index.code(index.fitted_part(stored) - base)
    step = max(1, (1 << 21) // max(len(stored), 1))
    for at in range(0, len(asking), step):
        some = asking[at : at + step]
        near = index.table_distances(index.fitted_part(some) - base, codes) <= index.radius + error[None, :] + 1e-4
        row, col = np.nonzero(near)
        for cut in range(0, len(row), 1 << 17):
            r, c = row[cut : cut + (1 << 17)], col[cut : cut + (1 << 17)]
            link = np.einsum("ij,ij->i", some[r], stored[c]) >= threshold
            yield r[link] + at, c[link]


def near_embeddings(
    table: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    distinct = written(
        valid.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("n")).withColumn("g", F.monotonically_increasing_id()),
        "vectors",
    )
    width = distinct.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not width:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    sample = distinct.where(F.size("v") == width[0]["w"]).orderBy(F.xxhash64("g"), "g").limit(FITTED).select("v").toArrow()
    index = spark.sparkContext.broadcast(fit_index(unit(_matrix(sample["v"])), threshold))

    def listed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                length = np.asarray(part.column("w"))
                for w in np.unique(length):
                    own = part.filter(pa.array(length == w))
                    home, asks = index.value.probes(index.value.fitted_part(unit(_matrix(own.column("v")))))
                    row, probe = np.nonzero(asks | (np.arange(asks.shape[1]) == home[:, None]))
                    taken = own.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("label"), taken.column("w"), pa.array(probe.astype(np.int32)), taken.column("g"), taken.column("n"), pa.array(home[row] == probe), taken.column("v")],
                        ["label", "w", "list", "g", "n", "stored", "v"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    probed = distinct.select("label", F.size("v").alias("w"), "g", "n", "v").mapInArrow(listed, f"label {kinds['label']}, w int, list int, g long, n long, stored boolean, v {kinds['v']}")
    probed = written(probed, "probes")
    sizes = probed.groupBy("label", "w", "list").agg(
        F.ceil(F.sum(F.col("stored").cast("int")) / STORED).cast("int").alias("s_parts"), F.ceil(F.count("*") / ASKING).cast("int").alias("q_parts")
    )
    tiled = probed.join(sizes.where("s_parts > 0"), ["label", "w", "list"])
    s_own, q_own = F.pmod(F.xxhash64("g"), F.col("s_parts")).cast("int"), F.pmod(F.xxhash64("g", F.lit(1)), F.col("q_parts")).cast("int")
    columns = ["label", "w", "list", "g", "n", "v"]
    held = tiled.where("stored").select(*columns, F.lit(True).alias("stored"), s_own.alias("s"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q"))
    asking = tiled.select(*columns, F.lit(False).alias("stored"), F.explode(F.sequence(F.lit(0), F.col("s_parts") - 1)).alias("s"), q_own.alias("q"))

    def met(tile: pa.Table) -> pa.Table:
        stored = np.asarray(tile["stored"])
        g, n, vectors = np.asarray(tile["g"]), np.asarray(tile["n"]), unit(_matrix(tile["v"]))
        s, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        grown = Forest(np.unique(g))
        links = np.zeros(len(q), np.int64)
        for a, b in tile_links(index.value, tile["list"][0].as_py(), vectors[s], vectors[q], threshold):
            other = g[q[a]] != g[s[b]]
            a, b = a[other], b[other]
            np.add.at(links, a, n[s[b]])
            grown.link(g[q[a]], g[s[b]])
        some, edges = np.flatnonzero(links), grown.edges()
        return pa.table({"a": np.concatenate([g[q[some]], edges[:, 0]]), "b": np.concatenate([np.full(len(some), -1), edges[:, 1]]), "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)])})

    found = written(held.unionByName(asking).groupBy("label", "w", "list", "s", "q").applyInArrow(met, "a long, b long, links long"), "tiles")
    counts = found.where("b < 0").groupBy(F.col("a").alias("g")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b >= 0"))
    rooted = distinct.join(counts, "g", "left").join(parts, distinct["g"] == parts["vertex"], "left")
    rooted = rooted.select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "g").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    known = rooted.join(smallest, "root").select("label", "v", "links", "smallest")
    linked = rows.where(usable).join(known, ["label", "v"]).select("vec_id", F.col("links").alias("n_links"), F.col("smallest").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
