"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, line_dedup, minhash_dedup, mixing, quality
from quantloom.llm.common import released, remove, shared_folder, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1, quality classifier: documents that it rejects go. Null and empty texts score as the bias does, rows alike stay
    or go together, all columns stay; an empty table gives an empty one (so do all stages)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: lines found in at least ten documents go; documents stay, with all columns, null texts as null."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each group of near copies (four fifths of the shingles of both) stays, of rows alike one; null and
    empty texts are no copies."""
    return minhash_dedup.drop_near_duplicates(docs, 80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents that hold four fifths of a benchmark item's shingles go, row by row; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the mixture, each document once for each epoch, with its epoch and place. A null source is one of its own;
    sources without words give no rows."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_common_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_to_weights),
]
#: The first stage is learned, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, read from its folder. What a stage stored and read goes once its result is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
