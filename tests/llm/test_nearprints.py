"""Candidates of the pipeline's near dedup: fingerprints, the tree's shards and the links, against plain loops."""

import random

import numpy as np

import corpus_pipeline
from tidebar.llm import nearsets
from tidebar.llm.simhash import Tree

RADIUS, TWO, WHOLE = nearsets.radii(0.8)


def differing(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))


def within(a, b):
    return differing(a[:1], b[:1]) <= RADIUS and differing(a[:2], b[:2]) <= TWO and differing(a, b) <= WHOLE


def drawn(rng, n, like=None, changed=0):
    fresh = [rng.getrandbits(64) for _ in range(n)]
    kept = list(like)[changed:] if like is not None else []
    return np.unique(np.array(kept + fresh[: n - len(kept)], np.uint64))


def test_similar_sets_are_within_the_radii_and_others_are_not():
    rng = random.Random(1)
    for size in (5, 10, 40, 300):
        for _ in range(60):
            a = drawn(rng, size)
            b = drawn(rng, size - size // 9, a, size // 9)  # drops a ninth and adds none: Jaccard at least 0.8
            own, other, apart = (nearsets.fingerprint(s) for s in (a, b, drawn(rng, size)))
            assert within(own, other)
            assert differing(own, apart) > WHOLE
            assert abs(nearsets.size_class(len(a), 0.8) - nearsets.size_class(len(b), 0.8)) <= 1
    a = drawn(rng, 7)
    hashes = [[int(x) for x in nearsets.mix64(np.array([h]) ^ nearsets._SALTS)] for h in a]
    bits = [sum(((sum(h[i] >> k & 1 for h in hashes) * 2 > len(a)) << k) for k in range(64)) for i in range(4)]
    assert [int(x) for x in nearsets.fingerprint(a)] == bits
    for size in range(4, 3000):
        assert nearsets.size_class(size * 5 // 4, 0.8) - nearsets.size_class(size, 0.8) in (0, 1)


def test_links_connect_what_a_plain_loop_connects():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)
    words = []
    for i in range(400):  # a third in one cluster
        flips = np.packbits(rng.random(256) < rng.choice([0.0, 0.05, 0.15, 0.22])).view(np.uint64)
        words.append(base[0 if i % 3 == 0 else rng.integers(40)] ^ flips)
    words = np.array(words)
    root = list(range(400))
    for a in range(250):
        for b in range(a + 1, 400):
            if within(words[a], words[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    own = list(range(400))
    for a, b in nearsets.candidate_links(words[:250], words[250:], nearsets.radii(0.8)).tolist():
        x, y = sorted((own[a], own[b]))
        own = [x if r == y else r for r in own]
    assert own == root
    assert 40 <= len(set(root)) < 300


def test_each_pair_within_the_radius_meets_in_one_home_shard():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 2**64, 300, dtype=np.uint64)
    tree = Tree(own, 8)
    assert tree.shards > 4
    for radius in (4, 20, RADIUS):
        home, asked, all_asked = [{} for _ in range(3)]
        for shard, at, homes in nearsets.placed(tree, own, True, radius):
            for i, h in zip(at.tolist(), homes.tolist(), strict=True):
                (home if h else asked).setdefault(i, []).append(shard)
        for shard, at, homes in nearsets.placed(tree, own, False, radius):
            assert not homes.any()
            for i in at.tolist():
                all_asked.setdefault(i, []).append(shard)
        assert all(len(s) == 1 for s in home.values()) and len(home) == 300
        for a in range(300):
            for b in range(a):
                if differing(own[a : a + 1], own[b : b + 1]) <= radius:
                    x, y = home[a][0], home[b][0]
                    assert x == y or (x in asked.get(b, [])) != (y in asked.get(a, []))
                    assert x in all_asked[b] and y in all_asked[a]


def test_the_stage_finds_its_candidates_by_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        texts += [" ".join(base), " ".join(base + [rng.choice(vocabulary) for _ in range(len(base) // 12)])]
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d", "a b c e", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted([*range(0, 80, 2), 80, 82, 83, 84, 85])
    asked = []
    searched = nearsets.candidates
    monkeypatch.setattr(nearsets, "candidates", lambda sets, similarity: asked.append(sets.count()) or searched(sets, similarity))
    for root in (nearsets.ROOT, 1):  # one shard, and nine
        monkeypatch.setattr(nearsets, "ROOT", root)
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == expected
    assert asked == [82, 82]  # sets that only an equal one reaches are not asked for
