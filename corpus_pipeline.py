"""The corpus pipeline: each stage's output is written and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm import decontamination, line_dedup, packing, quality_rules, simhash, tokens
from zonewright.llm.common import remove, shared_dir, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go. Shortness alone is no fault here: a short text goes if it is empty or fails another rule."""
    return quality_rules.keep_good(docs, base=(quality_rules.EMPTY, quality_rules.REPEATS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated lines go. A document of which nothing is left goes too; n_chars follows the text."""
    got = line_dedup.dedup_lines(docs)
    n_lines, n_removed = unused(docs, *line_dedup.COUNTS)
    emptied = (F.col(n_removed) > 0) & (F.trim("text") == "")
    got = got.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.drop(n_lines, n_removed)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokens.word_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What is between stages is Parquet in the shared folder; it goes when the next stage is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if before:
            remove(before)
        docs, before = spark.read.parquet(here), here
    return docs


#: Tokens and fingerprints of the stages are not SQL; tests/llm/test_pipeline.py holds the chain against a second version without Spark.
ORACLE_SQL = None
