"""Files of the tables between steps: each costs processes on the executors, so many small partitions share one."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar import session
from tidebar.llm import links, simhash
from tidebar.llm.linededup import dedup_lines

COALESCE, PARTITIONS = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"


@pytest.fixture
def made(spark, tmp_path, monkeypatch):
    """The files that are written meanwhile in tables of the shared folder, with 64 shuffle partitions that stay apart."""
    before = {k: spark.conf.get(k) for k in (COALESCE, PARTITIONS)}
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    for k, v in {COALESCE: "false", PARTITIONS: "64"}.items():
        spark.conf.set(k, v)
    yield lambda: {p.name.rsplit("-", 1)[0]: len(list(p.glob("part-*"))) for p in Path(tmp_path, "tidebar").iterdir()}
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tables_of_fingerprints_and_links_have_few_files(spark, made, monkeypatch):
    """op9: a round for each step of the components, and a file for each partition of each, were over 200 files here."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:100])], "doc_id long, text string").repartition(4)
    rounds = []
    monkeypatch.setattr(links, "written", lambda df, name, few=False: rounds.append(name) or session.written(df, name, few))
    found = {r.doc_id: (r.bits, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert all(found[300 + i] == found[i] for i in range(100))
    assert rounds == ["links", "components"]
    assert made() == {"fingerprints": 4, "distinct": 8, "components": 1}


def test_tables_of_line_dedup_have_few_files(spark, made, monkeypatch):
    monkeypatch.setattr("tidebar.llm.linededup.forget", lambda df: None)
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefghijkl ") for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, lines[i % 400] if i < 500 else lines[i % 400][:30] + "_" + lines[i % 400][30:]) for i in range(800)], "doc_id long, text string").repartition(4)
    assert dedup_lines(docs, short_repeats=True).agg(F.sum("n_removed")).first()[0] == 400
    assert max(made()[k] for k in ("held", "wanted", "texts", "sized", "parts", "near")) <= 8


def test_few_links_at_once_equal_rounds(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(350)] + [(2000 - i, 2001 - i) for i in range(300)] + [(2**62, -(2**62)), (7, 7), (None, 1)]
    table = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    once = {tuple(r) for r in links.components(table).collect()}
    monkeypatch.setattr(links, "SMALL", 0)
    assert {tuple(r) for r in links.components(table).collect()} == once
    assert (1701, 1701) in once and (2001, 1701) in once
    v, u = np.array([5, 9, 9]), np.array([3, 8, 3])
    assert [x.tolist() for x in links.rooted(v, u)] == [[3, 5, 8, 9], [3, 3, 3, 3]]


def test_keys_and_repeated_lines_have_few_files(spark, made, monkeypatch):
    """Of the pipeline's line dedup and op10: what these are found in is large, they are not. There were 64 files of each here.
    They are dealt out once more for it, else few tasks would read the whole of what they are found in."""
    plans = {}

    def seen(df, name, few=False):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return session.written(df, name, few)

    monkeypatch.setattr("tidebar.llm.linededup.written", seen)
    monkeypatch.setattr("tidebar.llm.linededup.forget", lambda df: None)
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefghijkl ") for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, lines[i % 400] if i < 500 else lines[i % 400][:30] + "_" + lines[i % 400][30:]) for i in range(800)], "doc_id long, text string").repartition(4)
    assert dedup_lines(docs, short_repeats=True).agg(F.sum("n_removed")).first()[0] == 400
    for k in ("keys", "repeated"):
        assert 0 < made()[k] <= 8
        assert "REPARTITION_BY_COL" in plans[k]
