"""The pipeline on rows with nulls, repeats, empties and clashing names, each stage against a plain loop."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_linededup import distance
from tidebar.llm import linededup, nearsets, packing, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _score double, _predicted string, n_lines long, n_removed long, _id long, _th long, _row string, h1 long"


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    bad, junk = ["scum", "trash", "idiot"], ["zzzz", "qqqq", "xkcd"]
    texts = []
    for i in range(90):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 14))) for _ in range(rng.randint(1, 5))]
        if i % 9 == 0:
            lines.append(" ".join(rng.choice(bad) for _ in range(8)))
        if i % 7 == 0:
            lines.append(" ".join(rng.choice(junk) for _ in range(12)))
        texts.append("\n".join(lines))
    texts += [texts[1], texts[1] + " more", texts[2] + "\n" + texts[3], None, "", "  ", "one", "One"]
    found = [(i, t) for i, t in enumerate(texts)] + [(5, "another text with an old id and some words"), (5, texts[5]), (5, texts[5]), (None, texts[4]), (None, "no id here"), (None, "no id here")]
    return [(i, t, "en", None, len(t or ""), 5.0, "p", -1, -2, 7, 8, "r", 9) for i, t in found]


def plain_lines(docs):
    """Texts by row, lines removed that an earlier one equals, or is within two edits of where both have 40 characters."""
    order = sorted({(r[0] is None, r[0] or 0, h, r[1]) for r, h in docs if r[1] is not None})
    seen, long, out = set(), [], {}
    for none, i, h, text in order:
        kept = []
        for line in text.split("\n"):
            near = len(line) >= 40 and any(abs(len(line) - len(x)) <= 2 and x != line and distance(line, x) <= 2 for x in long)
            if line.strip() and (line in seen or near):
                long += [line] * (len(line) >= 40)
                continue
            if line.strip():
                seen.add(line)
                long += [line] * (len(line) >= 40)
            kept.append(line)
        out[None if none else i, text] = "\n".join(kept)
    return out


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, int(i % 7 != 0), int(i % 9 == 0)) for i in range(90)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    for stage, module, score, keeps in ((corpus_pipeline.drop_toxic, toxicity, "score_toxicity", 0), (corpus_pipeline.keep_quality, quality, "score_quality", 1)):
        model = module.train(docs, labels)
        judged = {r.text: r.predicted for r in getattr(module, score)(docs.select("text"), model).collect()}
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert Counter(map(tuple, found.collect())) == Counter(r for r in rows if judged[r[1]] == keeps)
        assert 10 < found.count() < len(rows)
    hashes = [r[0] for r in docs.select(F.xxhash64("text")).collect()]
    expected = plain_lines(list(zip(rows, hashes, strict=True)))
    found = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert found.columns == docs.columns
    want = Counter((r[0], None, None, *r[2:4], *r[5:]) if r[1] is None else (r[0], t := expected[r[0], r[1]], len(t), *r[2:4], *r[5:]) for r in rows)
    assert Counter((r[0], r[1], r[4], *r[2:4], *r[5:]) for r in map(tuple, found.collect())) == want


def test_near_copies_keep_one_row_of_each_group(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = [shingled(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not either or both >= 0.8 * either:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    groups = {}
    for r, g in zip(rows, root, strict=True):
        groups.setdefault(g, set()).add((r[0], r[1]))
    for gathered in (nearsets.GATHERED, 2):
        monkeypatch.setattr(nearsets, "GATHERED", gathered)
        found = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert found.columns == docs.columns
        kept = Counter((r.doc_id, r.text) for r in found.collect())
        assert max(kept.values()) == 1
        for group in groups.values():
            own = [x for x in kept if x in group]
            assert len(own) == 1
            ids = [i for i, _ in group if i is not None]
            assert own[0][0] == (min(ids) if ids else None)


def test_large_groups_link_like_small_ones(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(200)]
    texts, base = [], [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # a chain that drifts away from its first text
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in nearsets.near_sets(docs).collect()}
    for gathered, rounds in ((10, 8), (10, 1), (3, 2)):
        monkeypatch.setattr(nearsets, "GATHERED", gathered)
        monkeypatch.setattr(nearsets, "ROUNDS", rounds)
        assert {r.doc_id: r.component_id for r in nearsets.near_sets(docs).collect()} == whole
    assert 1 < len(set(whole.values())) < 100 or len(set(whole.values())) == 1


def test_whole_run(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), int(i % 9 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), SCHEMA)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in found) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack_documents(step).collect())
    assert found


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_hot_keys_of_lines_are_refined_without_loss(spark, monkeypatch):
    rng = random.Random(3)
    lines = []
    for _ in range(30):  # the same first third, so one key has them all
        line = "the same beginning of each" + "".join(rng.choice("abcdefgh ") for _ in range(52))
        lines += [line, line[:40] + "#" + line[41:], line[:30] + line[31:], line[:50] + "x" + line[50:60] + "y" + line[60:]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    expected = [i for i, t in enumerate(lines) if not any(abs(len(t) - len(o)) <= 2 and distance(t, o) <= 2 for o in lines[:i])]
    for refined, tile in ((linededup.REFINED, 64), (4, 5), (10**9, 3)):
        monkeypatch.setattr(linededup, "REFINED", refined)
        monkeypatch.setattr(linededup, "TILE", tile)
        found = linededup.dedup_lines(docs).where("n_removed = 0").collect()
        assert sorted(r.doc_id for r in found) == expected
