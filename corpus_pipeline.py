"""A corpus pipeline: toxicity filter, quality filter, line dedup, near-dedup by SimHash of 5-word shingles, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; a stage's result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever else these
have and however they are named. Rows with a null text score as empty ones and are near copies of empty texts; rows that
share a doc_id are told apart by their texts; of ties the smaller text hash stays; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import linededup, nearsets, packing, quality, toxicity
from tidebar.llm.hot import join_hot
from tidebar.session import written

#: SQL can express neither the classifiers nor the fingerprints; tests/llm holds stages and the whole against plain loops.
ORACLE_SQL = None
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that documents do not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = _unused(docs, "_score"), _unused(docs, "_predicted")
    scored = toxicity.score_toxicity(docs, model, score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = _unused(docs, "_score"), _unused(docs, "_predicted")
    scored = quality.score_quality(docs, model, score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = linededup.dedup_lines(docs.select("doc_id", "text", *[F.col(c).alias(name) for c, name in others.items()]), short_repeats=True)
    shown = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(name) for c, name in others.items()}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[shown[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (null comes last), and of its texts that of the smallest
    hash. Rows are told apart by doc_id and text; of rows equal in both one stays. SimHash and its
    tree find the candidates, exact sets decide; only ids and hashes are compared here."""
    found = nearsets.near_sets(docs).groupBy("doc_id", "th", "root").agg(F.count("*").alias("copies"))
    found = written(found.withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")), "near_rows", few=True)
    best = written(found.groupBy("root").agg(F.min("place").alias("best"), F.count("*").alias("n")), "near_best", few=True)
    judged = join_hot(found, best, ["root"], F.xxhash64("th", "doc_id")).withColumn("keeps", F.col("place").eqNullSafe(F.col("best")))
    marks = written(judged.where("copies > 1 or not keeps").select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"), "keeps"), "near_ids", few=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_th"))
    few = marks.count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(marks) if few else marks.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th")), "left")
    kept = marked.where("keeps is null").select("_row.*")
    if marks.where("keeps").isEmpty():
        return kept
    repeated = marked.where("keeps").groupBy("_id", "_th").agg(F.min("_row").alias("_row")).select("_row.*")
    return kept.unionByName(repeated)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
