"""Joins with hot keys, and components of links with a vertex that has very many."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidebar.llm import hot, links
from tidebar.llm.hot import join_hot
from tidebar.llm.links import components


def test_join_hot_equals_join(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 60), rng.choice(["a", "b", None]), i) for i in range(2000)]
    keyed = [(k, s, f"{k}{s}", n) for (k, s), n in Counter(r[:2] for r in rows if r[1] and r[0] % 7).items()]
    left, right = spark.createDataFrame(rows, "k long, s string, i long"), spark.createDataFrame(keyed, "k long, s string, v string, n long")
    for how in ("inner", "left"):
        plain = Counter(left.join(right, ["k", "s"], how).select("k", "s", "i", "v").collect())
        for least in (1, 100, 10_000):
            found = join_hot(left, right, ["k", "s"], F.xxhash64("i"), how=how, least=least)
            assert found.columns == ["k", "s", "i", "v", "n"]
            assert Counter(found.select("k", "s", "i", "v").collect()) == plain


def test_components_of_a_star_and_chains(spark, monkeypatch):
    pairs = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (None, 3), (299, 0), (299, 0)]
    for least in (hot.LEAST, 20):
        monkeypatch.setattr(links, "LEAST", least)
        monkeypatch.setattr(hot, "LEAST", least)
        found = {r.vertex: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert found == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
