"""The pipeline's near-dedup stage against brute force over all pairs."""

import random

import corpus_pipeline


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_matches_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "one two", "ONE two"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 220))] + common
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    docs = list(enumerate(texts))
    sets = [shingled(t) for t in texts]
    root = list(range(len(docs)))
    near = 0
    for a in range(len(docs)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not either or both >= 0.8 * either:
                near += sets[a] != sets[b]
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert near > 20
    found = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(root))
