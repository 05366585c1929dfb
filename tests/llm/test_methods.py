"""Tests that reach the method of an operator: many shards and tiles, plain loops beside vectorised code, and the law of sharding."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidebar.llm import embeddings, labelled, langid, pieces, quality, sharding, simhash, toxicity


def reached(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# SimHash


def near_bits(n, seed):
    rng = random.Random(seed)
    own = [rng.getrandbits(64) for _ in range(n // 3)]
    out = set(own)
    while len(out) < n:
        x = rng.choice(own)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_many_shards_find_all_links(spark, monkeypatch):
    bits = near_bits(1200, 1)
    signed = [b - 2**64 if b >= 2**63 else b for b in bits]
    links = [(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (bits[i] ^ bits[j]).bit_count() <= 2]
    expected = reached(signed, links)
    monkeypatch.setattr(simhash, "FEW", 8)
    for shard in (5000, 40):
        monkeypatch.setattr(simhash, "SHARD", shard)
        found = simhash.fingerprint_links(spark.createDataFrame([(b,) for b in signed], "bits long")).collect()
        assert reached(signed, [(r.a, r.b) for r in found]) == expected
    tree = simhash.Tree(np.array(bits, np.uint64), 30)
    routed = tree.route(np.array(bits, np.uint64), 2)
    assert tree.shards > 20 and Counter(int(b) for _, some, home in routed for b in some[home]) == Counter(bits)


def test_dense_shards_find_the_same_pairs(monkeypatch):
    bits = np.array(near_bits(900, 2), np.uint64)

    def pairs():
        return {(int(bits[a]), int(bits[b])) for x, y in simhash.near_pairs(bits, bits, 2) for a, b in zip(x, y, strict=True) if a != b}

    plain = pairs()
    monkeypatch.setattr(simhash, "DENSE", 10)
    assert pairs() == plain and len(plain) > 100


# Embeddings


def test_several_tiles_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "STORED", 20)
    monkeypatch.setattr(embeddings, "ASKING", 30)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(10, 24))
    rows = [(i, (base[i % 10] + rng.normal(size=24) * (0.05 if i % 3 else 0.4)).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, rows[i][1], 0) for i in range(5)] + [(3, rows[3][1], 0)]
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    ids = sorted(vectors)
    cosine = np.array([vectors[i] for i in ids]) @ np.array([vectors[i] for i in ids]).T
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(cosine >= 0.98, 1)), strict=True)]
    count, parts = Counter(x for link in links for x in link), reached(ids, links)
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, v string, g double")
    found = embeddings.near_embeddings(table).collect()
    assert len(found) == len(rows) and len(links) > 500
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (count[i], parts[i], parts[i] == i) for i in ids}


# Sharding


def test_sizes_are_near_equal_and_few_bytes_move(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i if i % 50 else None, "x" * rng.randint(0, 400)) for i in range(6000)], "doc_id long, text string")
    found = sharding.reshard(sharding.measured(docs, 16), 16, 24).collect()
    sizes, moved, old = Counter(), 0, Counter()
    for r in found:
        sizes[r.shard] += r["size"]
        old[r.old_shard] += r["size"]
        moved += r["size"] * (r.shard != r.old_shard)
    share = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 0.02 * share
    least = sum(sizes.values()) - sum(min(s, share) for s in old.values())
    assert abs(moved - least) < 0.03 * least  # up to what the sizes differ from an equal share


# Pieces


def plain_agenda(codec, part, variant):
    """Merges one at a time: of the pairs that make a piece and are not dropped, the best rank, leftmost first."""
    key = pieces.mix64(np.array([zlib.crc32(part.encode())], np.uint64) + np.uint64(((codec.seed * pieces.VARIANTS + variant) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    symbols = [(i, i + 1, int(codec.char_id[ord(c)])) for i, c in enumerate(part)]
    at = {int(p): k for k, p in enumerate(codec.pair)}

    def candidate(a, b):
        if a[2] < 0 or b[2] < 0 or a[2] * codec.n + b[2] not in at:
            return None
        drawn = pieces.mix64(pieces.mix64(key.copy() ^ (np.uint64(a[0]) << np.uint64(32)) ^ np.uint64(b[0])) + np.uint64(b[1]))
        if drawn[0] < np.uint64(codec.dropout * (2**64 - 2**11)):
            return None
        k = at[a[2] * codec.n + b[2]]
        return int(codec.pair_rank[k]), a[0], int(codec.joined[k])

    while True:
        found = [(c[0], c[1], i, c[2]) for i in range(len(symbols) - 1) if (c := candidate(symbols[i], symbols[i + 1]))]
        if not found:
            return [s[2] for s in symbols]
        _, _, i, piece = min(found)
        symbols[i : i + 2] = [(symbols[i][0], symbols[i + 1][1], piece)]


def test_merges_leave_the_agenda_in_order():
    rng = random.Random(7)
    for dropout in (0.0, 0.3):
        codec = pieces.codec(pieces.MODEL, dropout, 11)
        letters = [chr(c) for c in range(97, 123) if codec.char_id[c] >= 0]
        parts = ["▁" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["▁internationalisation", "▁unbelievable", "▁the"]
        for variant in (0, 3):
            found = codec.segment(parts, variant)
            for part, raw in zip(parts, found, strict=True):
                assert np.frombuffer(raw, "<u4").tolist() == plain_agenda(codec, part, variant)


# Classifiers


def test_scores_equal_plain_loops(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "délta", "x", "scum", "trash", "der", "la"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["", " \n", "one"]
    docs = spark.createDataFrame([(f"id{i}", t, "en" if i % 2 else "fr", "extra") for i, t in enumerate(texts)] + [("id5", "zz", "en", "extra"), (None, "q", "de", "e"), ("n", None, "de", "e")], "doc_id string, text string, lang string, k string")
    labels = spark.createDataFrame([(f"id{i}", int("scum" in t), i % 2) for i, t in enumerate(texts)] + [("id3", None, 7), (None, 1, 1)], "doc_id string, toxic int, quality int")
    column = pa.array(texts, pa.large_string())
    model = toxicity.train(docs, labels)
    for text, score in zip(texts, model.score(column), strict=True):
        (keys,) = toxicity.encode(pa.array([text], pa.large_string()))
        weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
        z = model.bias + sum(weight.get(k, 0.0) for k in keys[0].as_py())
        assert score == pytest.approx(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))), abs=2e-6)
    model = quality.train(docs, labels)
    for text, score in zip(texts, model.score(column), strict=True):
        buckets, shares = (c[0].as_py() for c in quality.encode(pa.array([text], pa.large_string())))
        z = model.bias + sum(float(model.share[b]) * s for b, s in zip(buckets, shares, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))), abs=2e-5)
    model = langid.train(docs)
    assert set(model.languages) <= {"en", "fr", "de"} and len(model.languages) >= 2
    best, p = model.predict(column)
    for text, b, own in zip(texts, best, p, strict=True):
        buckets, shares = (c[0].as_py() for c in langid.encode(pa.array([text], pa.large_string())))
        z = [(float(model.bias[k]) + sum(float(model.weights[k][x]) * s for x, s in zip(buckets, shares, strict=True))) / model.temperature for k in range(len(model.languages))]
        q = np.exp(np.array(z) - max(z)) / np.exp(np.array(z) - max(z)).sum()
        assert own == pytest.approx(q.max(), abs=1e-4) and q[b] == pytest.approx(q.max(), abs=1e-4)


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(i, i % 3, "t" * (i % 40 + 1)) for i in range(600)] + [(1, 1, "again"), (7, 1, None)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    keyed = spark.createDataFrame([(i, c) for i, c, _ in rows] + [(None, 1), (5, None)], "doc_id long, label int")
    found = labelled.bounded_sample(keyed, docs, 50).collect()
    again = labelled.bounded_sample(keyed.repartition(7), docs.repartition(3), 50).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert all(n <= 50 for n in Counter(r.label for r in found).values()) and len(found) >= 149
    small = labelled.bounded_sample(keyed, docs, 50, label_bytes=100).collect()
    assert all(100 <= sum(len(r.text) for r in small if r.label == c) <= 140 for c in range(3))
