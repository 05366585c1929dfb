"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step aggregates by key with partial aggregation and joins back with keys that have a large share of the links
broadcast (they are few, whatever the size), so a vertex with very many links is not gathered in one task. Each round is
written to the shared folder, which cuts the lineage, and the round before is deleted. Few links need no rounds: one task
joins them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.hot import LEAST, join_hot
from tidebar.session import forget, ship, written

#: Links that one task joins, at most (16 bytes each).
SMALL = 250_000


def rooted(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links (v[i], u[i]), each once, and the smallest vertex that each can reach."""
    everyone = np.unique(np.concatenate([v, u]))
    x, y, parent = np.searchsorted(everyone, v), np.searchsorted(everyone, u), np.arange(len(everyone))
    while True:
        rx, ry = parent[x], parent[y]
        apart = np.flatnonzero(rx != ry)
        if not len(apart):
            return everyone, everyone[parent]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))  # each root is hung under a smaller one: no circle
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _at_once(links: DataFrame) -> DataFrame:
    def joined(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            table = pa.Table.from_batches(tables)
            vertex, root = rooted(table["v"].to_numpy(), table["u"].to_numpy())
            yield from pa.table({"vertex": vertex, "component": root}).to_batches(max_chunksize=10_000)

    ship(links.sparkSession)
    return links.repartition(1).mapInArrow(joined, "vertex long, component long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex that has a link: component is the smallest vertex it can reach.

    Vertices are longs. Null ends are no vertices; loops and repeated links change nothing; no links give an empty table.
    """
    found = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    found = written(found, "links")
    if found.count() <= SMALL:
        done = written(_at_once(found), "components")
        forget(found)
        return done
    edges = written(found.distinct(), "links", few=True)
    forget(found)
    known = _state(edges)
    while known[0]:
        total = 2 * known[0]
        # Tables that join_hot looks at more than once; few links need none of that.
        made: list[DataFrame] = []

        def table(df: DataFrame, name: str) -> DataFrame:
            if total <= LEAST:
                return df
            made.append(written(df, name, few=True))
            return made[-1]

        # Large-star: every vertex sends its larger neighbours to its smallest one (itself included).
        both = edges.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))).alias("e")).select("e.*")
        least = table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count(F.when(F.col("y") > F.col("x"), 1)).alias("n")), "least")
        large = join_hot(both.where("y > x"), least.where("n > 0"), ["x"], F.xxhash64("y"), total=total, least=LEAST).select(F.col("y").alias("v"), F.col("m").alias("u")).where("v > u").distinct()
        large = table(large, "large")
        # Small-star: every vertex and its smaller neighbours go to the smallest of those.
        lowest = table(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "lowest")
        small = join_hot(large, lowest, ["v"], F.xxhash64("u"), total=total, least=LEAST).select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v > u").distinct()
        after = written(small, "links", few=True)
        state = _state(after)
        for done in (edges, *made):
            forget(done)
        edges = after
        if state == known:
            break
        known = state
    # Stars: every vertex has one link, to its root.
    return edges.select(F.col("v").alias("vertex"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("vertex"), F.col("u").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
