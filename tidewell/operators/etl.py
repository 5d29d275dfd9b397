"""From wide measurements to series: unpivot, join with samples, two-level mean, densify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import missing, sum0

#: Time points in one list of the grid; there are far fewer of them than series.
MOST_INDEXES = 100_000
#: Rows that one task sorts and sums, where the number of tasks goes with the rows.
TASK_ROWS = 500_000
#: Parts in which the samples of a group are summed first, so that a group of very many samples lies in several tasks.
SPREAD = 16


def melt(wide: DataFrame, ids: list[str], names: str = "sample_id", values: str = "value") -> DataFrame:
    """Every column but the ids as rows; nulls stay."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], names, values)


def tasks_for(rows: int, spark: SparkSession) -> int:
    """Tasks that sort and sum so many rows with at most ``TASK_ROWS`` each on average, and no fewer than run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def two_level_mean(long: DataFrame, group: list[str], sample: str, value: str, out: str = "y", tasks: int | None = None) -> DataFrame:
    """Sum within each sample (0 if all missing), then the mean over samples. Null keys are dropped.

    With ``tasks`` (see ``tasks_for``) rows are dealt by sample to so many tasks, whatever the session's number of shuffle partitions,
    so what a task holds doesn't grow with the table; rows that already lie so are not dealt again. A group of many samples is first summed up in
    ``SPREAD`` parts.
    """
    keyed = long.dropna(subset=[*group, sample])
    if tasks:
        keyed = keyed.repartition(tasks, sample)
    inner = keyed.groupBy(*group, sample).agg(sum0(missing(F.col(value).cast("double"))).alias("_sum"))
    if not tasks:
        return inner.groupBy(*group).agg(F.avg("_sum").alias(out))
    parts = inner.select(*group, F.pmod(F.xxhash64(sample), F.lit(SPREAD)).alias("_part"), "_sum").repartition(tasks, *group, "_part")
    parts = parts.groupBy(*group, "_part").agg(F.sum("_sum").alias("_sum"), F.count("*").alias("_held"))
    return parts.repartition(tasks, *group).groupBy(*group).agg((F.sum("_sum") / F.sum("_held")).alias(out))


def series_from_wide(wide: DataFrame, samples: DataFrame, gene: str = "ensembl_gene_id", transcript: str = "ensembl_transcript_id") -> DataFrame:
    """(gene, time, y): transcripts summed by sample, samples averaged by time; samples without time drop out."""
    long = melt(wide, [gene, transcript], "sample_id", "tpm").join(samples.select("sample_id", F.col("time_hpf").alias("time")), "sample_id", "left")
    tasks = tasks_for(wide.count() * (len(wide.columns) - 2), wide.sparkSession)
    return two_level_mean(long, ["time", gene], "sample_id", "tpm", tasks=tasks).withColumnRenamed(gene, "gene")


def densify(rows: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Every key at every index that any key has; missing values are null, null keys and indexes have no row.

    The list of distinct indexes is read as a scalar subquery and exploded beside each key, without any join. A list of more than
    ``MOST_INDEXES`` is cut into blocks, which keys meet by block number in an equi-join.
    """
    present = rows.withColumn(index, missing(F.col(index))) if dict(rows.dtypes)[index] in ("double", "float") else rows
    present = present.where(F.col(key).isNotNull() & F.col(index).isNotNull())
    indexes, keys = present.select(index).distinct(), present.select(key).distinct()
    blocks = -(-indexes.count() // MOST_INDEXES) or 1
    if blocks == 1:
        grid = keys.select(key, F.explode(indexes.agg(F.sort_array(F.collect_set(index))).scalar()).alias(index))
    else:
        lists = indexes.groupBy(F.pmod(F.xxhash64(index), F.lit(blocks)).alias("_block")).agg(F.collect_list(index).alias("_all"))
        numbered = keys.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        grid = numbered.join(lists, "_block").select(key, F.explode("_all").alias(index))
    return grid.join(present.select(key, index, value), [key, index], "left").select(key, index, value)
