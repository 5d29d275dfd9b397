"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of documents, under whatever names extra ones have.

Rows with a null doc_id or text and empty texts are judged like any other: quality scores them, near_duplicates
and repeated_passages let them pass (nothing is linked with or found in an empty text; rows without doc_id are
never second), benchmark_leaks finds nothing in them, and sequences makes them one end token. Rows that repeat doc_id and text are
one row after near_duplicates; a doc_id on different texts keeps each. Empty tables give empty results. Ties in a group go to the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import boosted_trees, jaccard_join, packing, rlz_dedup, wu_manber
from tidewell.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    return boosted_trees.keep_good(docs, boosted_trees.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document of each group linked at a Jaccard similarity of 0.8 over 5-word shingles."""
    return jaccard_join.keep_first(docs, 5, 80, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of 50 words and more that a document with a smaller id holds, too."""
    return rlz_dedup.remove_spans(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which 10 consecutive words of a benchmark item occur."""
    return wu_manber.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("sequences", sequences),
]
#: The classifier and the tokenizer are not SQL; tests/llm/test_pipeline.py compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents; what a stage kept is written to the shared folder."""
    from uuid import uuid4

    from tidewell.llm.common import prepare

    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
