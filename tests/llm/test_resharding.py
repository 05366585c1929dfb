"""Resharding of real files: each row exactly once when the number of shards grows or shrinks."""

from collections import Counter
from pathlib import Path

import pytest

from tidebar.llm import sharding


@pytest.mark.parametrize(("old", "new"), [(3, 5), (5, 3)])
def test_each_row_once(spark, tmp_path, old, new):
    rows = [(i, f"text {i} " * (i % 7), i % 3, "s") for i in range(200)] + [(7, None, 1, "s"), (7, None, 1, "s"), (None, "x", 0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string").repartition(3)
    path = f"file://{tmp_path}/shards"
    sharding.lay_out(docs, path, old)
    sharding.reshard_files(spark, path, docs.schema, old, new)
    found = sharding.stored(spark, path, docs.schema).collect()
    assert Counter(tuple(r.row) for r in found) == Counter(rows)
    assert {p.name for p in Path(tmp_path, "shards").glob("shard=*")} == {f"shard={i}" for i in range(new)}
    for i in range(new):
        assert sorted(r.slot for r in found if r.shard == i) == list(range(sum(r.shard == i for r in found)))


def test_query_reads_files(spark, tmp_path):
    spark.createDataFrame([(i, "t" * i, "en") for i in range(300)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sharding.op6_sharding(spark, str(tmp_path))
    assert all("/shards-" in f for f in found.inputFiles())
    assert sorted((r.doc_id, r["size"]) for r in found.collect()) == [(i, i + 8) for i in range(300)]
