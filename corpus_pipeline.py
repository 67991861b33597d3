"""Cleaning of a training corpus, stage by stage.

Every stage takes the documents that its predecessor kept, as written to the shared checkpoint
folder and read again, and is judged on these alone. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom.llm import bpe, decontaminate, langid, minhash, suffix_dedup
from revloom.llm.queries import RANKS, table, vocabulary_path
from revloom.session import scratch_path

LEAST_SCORE = 0.5  # posterior of a language
NO_ID = -(2**63)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language: not ``und``, and likelier than all others together."""
    found = langid.identify(docs, carry=docs.columns)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select("row.*")


def _keys(docs: DataFrame) -> DataFrame:
    """Documents by id and text; a null id is one of its own kind, a null text is like an empty one."""
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn(
        "__text", F.xxhash64(F.coalesce("text", F.lit("")))
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies, and of repeated rows one."""
    found = minhash.deduplicate(docs, threshold=80).where("kept")
    kept = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.col("text_hash").alias("__text"))
    once = _keys(docs).dropDuplicates(["__doc", "__text"])
    return once.join(kept.distinct(), ["__doc", "__text"], "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 100 bytes or more that occur earlier; documents stay with the rest of their text."""
    found = suffix_dedup.remove_repeats(docs, carry=docs.columns)
    # A text without repeats stays as it is (a null one, too).
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark")).select("doc", "text_hash").distinct()
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    keyed = docs.withColumn("__doc", key).withColumn("__text", F.xxhash64("text"))
    found = found.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__text"))
    return keyed.join(found, ["__doc", "__text"], "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with hashes of the ids and of what they decode to."""
    return bpe.encode(docs, vocabulary_path(RANKS)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("encoded", encoded),
]

# Stages that learn or draw have no SQL; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
