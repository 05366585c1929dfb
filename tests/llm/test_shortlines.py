"""Exact repeats of lines below the edit join's length, in op10_linededup and in the pipeline's stage."""

import zlib

import corpus_pipeline
from tidebar.llm.linededup import op10_linededup

LONG = "a line that is long enough for the edit join to look at it"
DOCS = [
    (1, "All rights reserved.\n\n  \n}\n" + LONG),
    (2, "All rights reserved.\nAll rights reserved!\n\n  \n}\n" + LONG + "."),
    (3, "x\nx\n\nAll rights reserved"),
    (4, None),
]
EXPECTED = {1: DOCS[0][1], 2: "All rights reserved!\n\n  ", 3: "x\n\nAll rights reserved", 4: None}


def test_short_repeats_go(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op10_linededup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_crc32 for r in found} == {i: zlib.crc32((t or "").encode()) for i, t in EXPECTED.items()}
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 3, 3: 1, 4: 0}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == EXPECTED
