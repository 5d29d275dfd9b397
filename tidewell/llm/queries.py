"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, boosted_trees, byte_cnn, hard_negatives, host_reputation, html_diff, jaccard_join, length_histogram, packing, rlz_dedup, token_alignment, winnowing, wu_manber
from .common import table


def op1_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_tree.quantised(table(spark, sf_dir, "embeddings"))
    return ball_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.digest(table(spark, sf_dir, "documents"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.digest(wu_manber.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.at_limits(table(spark, sf_dir, "documents"))


def op9_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return boosted_trees.score(documents, boosted_trees.train(documents, table(spark, sf_dir, "labels")))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return byte_cnn.predict(documents, byte_cnn.train(documents))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.links(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.prepared(table(spark, sf_dir, "embeddings")), "vec_id % 100 = 0")


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_diff, op2_host_reputation, op3_jaccard_join, op4_ball_tree, op5_packing, op6_rlz_dedup, op7_wu_manber, op8_length_histogram, op9_boosted_trees, op10_byte_cnn, op11_token_alignment, op12_hard_negatives, op13_winnowing)
}
ORACLE_SQL: dict[str, str] = {
    "op2_host_reputation": host_reputation.ORACLE_SQL,
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op4_ball_tree": ball_tree.ORACLE_SQL,
    "op6_rlz_dedup": rlz_dedup.ORACLE_SQL,
    "op7_wu_manber": wu_manber.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
