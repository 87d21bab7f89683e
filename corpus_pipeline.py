"""The corpus pipeline: raw documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import line_dedup, mixing, near_dedup, packing, toxicity
from scoreweave.llm.common import shared_folder
from scoreweave.llm.queries import TOKENIZER, categories, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # the classifier and the tokenizer have no SQL; tests run all stages and test their operators apart


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not flag."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories())
    return toxicity.score(docs, chain).where("not flagged").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with many others; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; repeated rows of it once.  Documents without words stay, they resemble none."""
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    # null-safe: a document without an id is a group of its own
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources nearer to equal weights: every document at least once, those of rarer sources again."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext.applicationId}-{abs(hash((sf_dir, id(spark))))}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
