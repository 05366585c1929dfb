"""Line dedup against brute force over all pairs of lines."""

import random

from tidebar.llm.linededup import MIN_CHARS, THRESHOLD, dedup_lines


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(rng: random.Random, line: str) -> str:
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(line))
        line = rng.choice([line[:i] + line[i + 1 :], line[:i] + "é" + line[i:], line[:i] + "x" + line[i + 1 :]])
    return line


def expected(docs: list[tuple]) -> list:
    seen, out = [], []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            if len(line) >= MIN_CHARS and any(abs(len(line) - len(o)) <= THRESHOLD and distance(line, o) <= THRESHOLD for o in seen):
                seen.append(line)
                continue
            if len(line) >= MIN_CHARS:
                seen.append(line)
            kept.append(line)
        out.append("\n".join(kept))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdeñ ") for _ in range(rng.randint(38, 60))) for _ in range(12)]
    docs = [(i, "\n".join(edited(rng, rng.choice(bases)) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, "\n\n"), (43, "short\nshort")]
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == expected(docs)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string, h string")).count() == 0
