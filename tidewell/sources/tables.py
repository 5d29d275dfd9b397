"""The driver's tables, and the analogue series that the queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_series(events: DataFrame) -> DataFrame:
    """(gene, time, y): mean value of each event type by day, days counted from the first of all."""
    start = events.agg(F.min(F.to_date("ts"))).first()[0]
    day = F.datediff(F.to_date("ts"), F.lit(start).cast("date")).cast("double")
    return events.where("event_type IS NOT NULL").groupBy(F.col("event_type").alias("gene"), day.alias("time")).agg(F.avg("value").alias("y"))
