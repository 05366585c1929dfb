"""Line dedup's segment keys: fewer of them, for each place of two edits, and characters beyond two bytes."""

import random

from pyspark.sql import functions as F

from tests.llm.test_linededup import expected
from tidebar.llm.linededup import dedup_lines, segment_keys


def test_a_line_has_eleven_keys(spark):
    assert len(segment_keys(F.col("line"), mutual=True)) == 11
    assert len(segment_keys(F.col("line"))) == 12


def test_every_place_of_an_insertion_and_a_deletion_is_found(spark):
    rng = random.Random(6)
    docs = []
    for a in range(0, 44):
        for b in range(a % 3, 44, 3):  # own lines for each pair: no other line makes up for a key that is missing
            line = "".join(rng.choice("abcdefghijklmnop") for _ in range(44))
            cut = line[:b] + line[b + 1 :]
            other = cut[:a] + "Z" + cut[a:]
            docs += [(len(docs), line), (len(docs) + 1, other)] if rng.random() < 0.5 else [(len(docs), other), (len(docs) + 1, line)]
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed = 1").collect()
    assert sorted(r.doc_id for r in found) == list(range(1, len(docs), 2))
    assert len(docs) > 1200


def test_characters_beyond_two_bytes_match_brute_force(spark):
    rng = random.Random(7)
    letters = "ab é漢😀😁𝒳"
    docs = []
    for _ in range(12):
        base = [rng.choice(letters) for _ in range(rng.randint(40, 50))]
        docs.append("".join(base))
        for changed in (1, 2, 3, 5):
            line = list(base)
            for i in rng.sample(range(len(line)), changed):
                line[i] = {"😀": "😁", "😁": "𝒳", "𝒳": "😀"}.get(line[i], rng.choice(["", "😀b", "x"]))
            docs.append("".join(line))
    docs = list(enumerate(docs))
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == expected(docs)
    assert 12 < sum(r.n_removed for r in found) < 40
