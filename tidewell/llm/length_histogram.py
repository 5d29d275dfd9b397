"""Exact histogram of encoded lengths; suffix sums answer every context limit at once.

Documents are aggregated by encoded length (partial sums first, so a common length costs one row
a task). Suffix sums over the lengths run in two levels: inside blocks of lengths, and
over the block totals, so that no task sees all lengths. A null or empty text has length 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, prepare
from .tokens import cache_for, default_path

BLOCK = 1024


def lengths(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(length) of every document, in tokens."""
    path = path or default_path()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = cache_for(path).packed(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([len(p) // 4 for p in packed], pa.int64())], ["length"])

    return map_batches(documents.select("text"), count, "length long")


def length_table(encoded: DataFrame, limits: Sequence[int] = ()) -> DataFrame:
    """One row for each length that occurs and for each of ``limits``, taken as context limit.

    n_docs have this very length, n_longer exceed it and lose tokens at this limit;
    n_tokens are those of all documents, n_kept what is left when each is cut to the limit;
    rank is the share of documents of at most this length, so the least length with rank >= q is
    the q-quantile. Limits between two lengths follow: n_kept grows by n_longer a token. Without
    documents there are no rows, whatever the limits.
    """
    prepare(encoded.sparkSession)
    counts = encoded.groupBy("length").agg(F.count("*").alias("n_docs"))
    if limits:
        asked = encoded.sparkSession.createDataFrame([(int(x), 0) for x in set(limits)], "length long, n_docs long")
        counts = counts.union(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    counts = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).checkpoint()
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(every).alias("all_docs"),
        F.sum("tokens").over(every).alias("n_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, "block")
    out = out.withColumn("n_longer", F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    out = out.withColumn("longer_tokens", F.col("tokens_above") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), F.lit(0)))
    kept = F.col("n_tokens") - F.col("longer_tokens") + F.col("n_longer") * F.col("length")
    rank = (F.col("all_docs") - F.col("n_longer")) / F.col("all_docs")
    return out.where("all_docs > 0").select("length", "n_docs", "n_longer", "n_tokens", kept.alias("n_kept"), rank.alias("rank"))


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): of each share the least length that at least so many documents don't exceed, of a ``length_table``."""
    least = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when((F.col("rank") >= q) & (F.col("n_docs") > 0), F.col("length"))).alias("length")) for q in shares]
    return table.agg(F.array(*least).alias("found")).select(F.inline("found")).where("length IS NOT NULL")


def at_limits(documents: DataFrame, path: str | None = None) -> DataFrame:
    return length_table(lengths(documents, path))
