"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm.embeddings import op8_embeddings
from tidebar.llm.langid import op3_langid
from tidebar.llm.linededup import op10_linededup
from tidebar.llm.media import op5_media
from tidebar.llm.packing import op2_packing
from tidebar.llm.pieces import op7_pieces
from tidebar.llm.quality import op1_quality
from tidebar.llm.sharding import op6_sharding
from tidebar.llm.simhash import op9_simhash
from tidebar.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_langid": op3_langid,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_sharding": op6_sharding,
    "op7_pieces": op7_pieces,
    "op8_embeddings": op8_embeddings,
    "op9_simhash": op9_simhash,
    "op10_linededup": op10_linededup,
}

ORACLES: dict[str, str] = {}
