"""Joins whose key may be hot: one key can hold a third of all rows, and must not be one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that count as hot, at most: those with more than a share of 1 / HOT_KEYS of the rows.
HOT_KEYS = 2_000
#: A key with so many rows or fewer is never hot.
LEAST = 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], spread: Column, count: str = "n", how: str = "inner", total: int | None = None, least: int = LEAST) -> DataFrame:
    """rows joined with keyed, a table with one row for each key; `count` says how many of rows its key has.

    Keys with more than max(least, total / HOT_KEYS) rows can be no more than HOT_KEYS, so they are broadcast, whatever
    the size of the tables. Their rows take `spread` (a long that differs from row to row) for the first key, a long as
    well, in the shuffle that joins the others: they match nothing there and lie evenly over its tasks. total is the number
    of rows, at least, where the caller knows it. how: inner or left.
    """
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    limit = max(least, total // HOT_KEYS)
    more = [c for c in keyed.columns if c not in on]
    hot = keyed.where(F.col(count) > limit)
    if total <= limit or hot.isEmpty():
        return rows.join(keyed, on, how).select(*rows.columns, *more)
    cold = keyed.where(F.col(count) <= limit).select(*[F.col(c).alias(f"_cold_{c}") for c in on], F.lit(False).alias("_cold_hot"), F.struct(*more).alias("_cold"))
    marked = rows.join(F.broadcast(hot.select(*on, F.struct(*more).alias("_hot"))), on, "left")
    marked = marked.withColumns({"_is_hot": F.col("_hot").isNotNull(), "_key": F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col(on[0]))})
    same = [marked["_is_hot"] == cold["_cold_hot"], marked["_key"] == cold[f"_cold_{on[0]}"], *[marked[c] == cold[f"_cold_{c}"] for c in on[1:]]]
    out = marked.join(cold, reduce(Column.__and__, same), "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return (out if how == "left" else out.where("_found is not null")).select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in more])
