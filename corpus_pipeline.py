"""A corpus pipeline of five of the numbered operators; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import minmax_hash, mixing, packing, secret_forest, weak_quality
from gradeframe.llm.queries import tokenizer_file
from gradeframe.llm.shared import written

#: The columns that all stages but the last return.
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of the near-dedup stage; four are the contract of the op9 query alone.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts; texts that are null or without words are rejected, repeated rows judged alike, no rows give none."""
    return weak_quality.score_quality(docs.select(*DOCUMENTS)).where("accepted").select(*DOCUMENTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates by five-word shingles: that with the smallest doc_id.

    Rows are compared, not ids: of equal rows one stays, and two texts under one
    doc_id are judged each. Rows without words (null or empty text) all stay; a
    row without doc_id stays if its group has no row with one.
    """
    rows = written(docs.select(*DOCUMENTS).withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    groups = minmax_hash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k=SHINGLE)
    placed = groups.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", F.col("doc_id").alias("own")), "_row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("without"), "own", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*DOCUMENTS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; null texts and texts without secrets as they are, no rows give none."""
    return secret_forest.redact(docs, secret_forest.scan(docs)).select(*DOCUMENTS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once or more often, by its source's weight (null is a source); no source more than twice over; no rows give none."""
    return mixing.mix(docs, repetition_limit=2.0, keep=["text", "lang", "n_chars"]).select(*DOCUMENTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 1024 tokens; a null text is its end token alone."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources", mix), ("packing", pack)]

#: Training, hashing and tokenising are not expressible in SQL; tests hold near-dedup against brute force and the other stages by their effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
