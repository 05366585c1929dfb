"""Resharding by minimum-cost flow.

Rows lie in old shards, each cut into a fixed number of blocks by hash. The flow network has an arc from every old
shard to every new one, free if they are the same and else at one a byte; old sizes are the supplies, near-equal sizes
the capacities, so its optimum moves the fewest bytes. Whole blocks then follow the flow, largest first, and a last
pass exchanges single blocks between the fullest and the emptiest shard while that brings their sizes together. Only
the sizes of blocks, a fixed number of rows, reach the driver; `rewrite` writes the shards that change and no others,
and deletes those that lose all rows. op6 lays whole rows out as old shards, reshards these files, and reads its
columns back from them.

Defined results: a null text has no bytes and the crc32 of the empty text; rows with equal values are placed each for
itself; rows without doc_id are spread like others; an empty table gives an empty table; other columns go along in one
struct, so they never clash.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidebar.session import shared_dir

OLD_SHARDS = 16
SHARDS = 24
#: Blocks of an old shard.
BLOCKS = 512
#: Parts in which a new shard is dealt out, and so files it has, about.
PARTS = 8
#: Bytes of a row besides its text.
ROW_BYTES = 8


def minimum_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """flow[i][j] from supply i to capacity j at the least total cost(i, j) a unit, by successive shortest paths with
    potentials. The capacities add up to the supplies at least."""
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    graph: list[list[list[int]]] = [[] for _ in range(m + n + 2)]  # [to, left, cost, number of the arc back]

    def arc(a: int, b: int, most: int, price: int) -> None:
        graph[a].append([b, most, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(n):
            arc(i, m + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        arc(m + j, sink, c, 0)
    potential = [0] * len(graph)
    while True:
        far = {source: 0}
        came: dict[int, tuple[int, int]] = {}
        todo, done = [(0, source)], set()
        while todo:
            d, a = heapq.heappop(todo)
            if a in done:
                continue
            done.add(a)
            for k, (b, left, price, _) in enumerate(graph[a]):
                e = d + price + potential[a] - potential[b]
                if left and b not in done and e < far.get(b, e + 1):
                    far[b], came[b] = e, (a, k)
                    heapq.heappush(todo, (e, b))
        if sink not in came:
            break
        top = max(far.values())
        for a in range(len(graph)):
            potential[a] += far.get(a, top)
        path, b = [], sink
        while b != source:
            a, k = came[b]
            path.append(graph[a][k])
            b = a
        amount = min(x[1] for x in path)
        for x in path:
            x[1] -= amount
            graph[x[0]][x[3]][1] += amount
    flow = [[0] * n for _ in range(m)]
    for i in range(m):
        for b, left, _, _ in graph[i]:
            if m <= b < m + n:
                flow[i][b - m] = supply[i] - left
    return flow


def capacities(blocks: dict[tuple[int, int], int], shards: int) -> list[int]:
    """Near-equal sizes of the new shards. A block larger than an equal share takes a shard for itself, its own one if
    that is free, and the others share the rest."""
    out: dict[int, int] = {}
    rest = sum(blocks.values())
    for (old, _), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        if len(out) == shards - 1 or size * (shards - len(out)) <= rest:
            break
        out[old if old < shards and old not in out else min(set(range(shards)) - set(out))] = size
        rest -= size
    free = [j for j in range(shards) if j not in out]
    for k, j in enumerate(free):
        out[j] = rest // len(free) + (k < rest % len(free))
    return [out[j] for j in range(shards)]


def transfers(blocks: dict[tuple[int, int], int], old_shards: int, shards: int) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, number): sizes near equal, and the fewest bytes moved up to a block."""
    supply = [sum(v for (old, _), v in blocks.items() if old == i) for i in range(old_shards)]
    flow = minimum_cost_flow(supply, capacities(blocks, shards), lambda i, j: int(i != j))
    placed: dict[tuple[int, int], int] = {}
    for i in range(old_shards):
        need = [(-f, j != i, j) for j, f in enumerate(flow[i]) if f]
        heapq.heapify(need)
        for key, size in sorted(((k, v) for k, v in blocks.items() if k[0] == i), key=lambda x: (-x[1], x[0])):
            f, away, j = heapq.heappop(need)
            placed[key] = j
            heapq.heappush(need, (f + size, away, j))
    held: list[set] = [set() for _ in range(shards)]
    sizes = [0] * shards
    for key, j in placed.items():
        held[j].add(key)
        sizes[j] += blocks[key]
    while True:
        full, empty = max(range(shards), key=lambda j: (sizes[j], -j)), min(range(shards), key=lambda j: (sizes[j], j))
        gap = sizes[full] - sizes[empty]
        better = [k for k in held[full] if 0 < blocks[k] < gap]
        if not better:
            return placed
        key = min(better, key=lambda k: (abs(2 * blocks[k] - gap), k[0] == full, k))
        held[full].remove(key)
        held[empty].add(key)
        sizes[full] -= blocks[key]
        sizes[empty] += blocks[key]
        placed[key] = empty


def reshard(rows: DataFrame, old_shards: int, shards: int) -> DataFrame:
    """rows (doc_id, size, text_crc32, old_shard and others; a table, read more than once) with shard and slot."""
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("block")), F.lit(BLOCKS)).cast("int"))
    found = rows.groupBy("old_shard", "_block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # old_shards * BLOCKS at most
    placed = transfers({(r["old_shard"], r["_block"]): r["size"] for r in found}, old_shards, shards)
    first, plan = [0] * shards, []
    for r in sorted(found, key=lambda r: (r["old_shard"], r["_block"])):
        shard = placed[r["old_shard"], r["_block"]]
        plan.append((r["old_shard"], r["_block"], shard, first[shard]))
        first[shard] += r["n"]
    table = rows.sparkSession.createDataFrame(plan, "old_shard int, _block int, shard int, _first long")
    # Dealt once, so that a shard is written by few tasks and the window needs no other exchange.
    dealt = rows.join(F.broadcast(table), ["old_shard", "_block"]).withColumn("_part", F.pmod("_block", F.lit(PARTS))).repartition("shard", "_part")
    within = F.row_number().over(Window.partitionBy("shard", "_part", "old_shard", "_block").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("slot", F.col("_first") + within).drop("_block", "_first", "_part")


def measured(docs: DataFrame, old_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, old_shard): a row's old shard is given by the hash of its id."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(old_shards)).cast("int").alias("old_shard"),
    )


def rewrite(rows: DataFrame, path: str) -> list[int]:
    """Write the shards that change (rows as `reshard` deals them, with old_shard, old_slot, shard and slot) below path,
    and return their numbers. A shard that neither loses nor gains a row, and whose rows have slots, keeps its files; one that loses all
    its rows is deleted."""
    spark = rows.sparkSession
    held = rows.groupBy("old_shard", "shard").agg(F.max(F.col("old_slot").isNull()).alias("new")).collect()  # at most a row for each pair of shards
    affected = sorted({s for r in held if r["new"] or r["old_shard"] != r["shard"] for s in (r["old_shard"], r["shard"])})
    out = rows.where(F.col("shard").isin(affected)).drop("old_shard", "old_slot")
    out.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for emptied in set(affected) - {r["shard"] for r in held}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={emptied}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return affected


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(shard, slot, row) of the shards below path as their files are now; schema is the rows'."""
    whole = StructType().add("slot", "long").add("row", schema).add("shard", "integer")
    return spark.read.schema(whole).parquet(path)


def lay_out(docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id") -> None:
    """Write the whole rows as shards below path, yet without slots: the shard by the hash of the id."""
    shard = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(shards)).cast("int")
    rows = docs.select(F.lit(None).cast("long").alias("slot"), F.struct(*docs.columns).alias("row"), shard.alias("shard"))
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def reshard_files(spark: SparkSession, path: str, schema: StructType, old_shards: int, shards: int, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """Bring the shards below path from old_shards to shards, in place; returns the shards that were written or deleted."""
    files = stored(spark, path, schema)
    rows = files.select(*_measures(F.col("row")[doc_id], F.col("row")[text]), F.col("shard").alias("old_shard"), F.col("slot").alias("old_slot"), "row")
    return rewrite(reshard(rows, old_shards, shards).select("old_shard", "old_slot", "shard", "slot", "row"), path)


def _measures(doc_id, text) -> list:
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return [doc_id.alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")]


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/tidebar/shards-{uuid.uuid4().hex}"
    lay_out(docs, path, OLD_SHARDS)
    reshard_files(spark, path, docs.schema, OLD_SHARDS, SHARDS)
    files = stored(spark, path, docs.schema)
    return files.select(*_measures(F.col("row.doc_id"), F.col("row.text")), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
