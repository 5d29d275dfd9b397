"""Writers that can be run again: results by partition, dead letters beside them, nothing written twice."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stable import stable


def stored(df: DataFrame, path: str) -> DataFrame | None:
    """What is at ``path`` already, if anything."""
    return _stored(df.sparkSession, path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str], partition: list[str] | None = None) -> int:
    """Append the rows whose ``keys`` are not at ``path`` yet; how many of their keys were new.

    The keys that are there are read back by an anti join, so a job that broke off goes on where it was.
    """
    before = stored(df, path)
    new = df if before is None else df.join(before.select(*keys).distinct(), keys, "left_anti")
    held = 0 if before is None else before.select(*keys).distinct().count()
    writer = new.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    after = stored(df, path)
    return (0 if after is None else after.select(*keys).distinct().count()) - held


CHAIN = ["model", "gene", "chain"]


def published(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The ``draws`` or ``errors`` of all runs that the store's manifest names, if any; what a broken run has left is not among them."""
    runs, rows = _stored(spark, f"{path}/manifest"), _stored(spark, f"{path}/{kind}")
    return None if runs is None or rows is None else rows.join(F.broadcast(runs.select("run").distinct()), "run", "left_semi")


def publish_fits(draws: DataFrame, path: str) -> str | None:
    """Write draws and failed chains as a run of their own, and name the run in the manifest; the run, or none if there was nothing.

    The fits are computed once, into the checkpoint folder. Readers follow the manifest, whose one row is written last and in one
    piece, so a run that breaks off before shows nothing, and its chains are pending still.
    """
    spark, run = draws.sparkSession, uuid.uuid4().hex
    rows = stable(draws)
    chains = rows.select(*CHAIN).distinct().count()
    if not chains:
        return None
    parts = {"draws": rows.where("error IS NULL").drop("error"), "errors": rows.where("error IS NOT NULL").select(*CHAIN, "error")}
    for kind, part in parts.items():
        part.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "model").parquet(f"{path}/{kind}")
    spark.createDataFrame([(run, chains)], "run string, chains long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def write_fits(draws: DataFrame, path: str) -> None:
    """Draws under draws/, failed chains under errors/, by run and model; chains that are published already are left alone."""
    for kind in ("draws", "errors"):
        done = published(draws.sparkSession, path, kind)
        if done is not None:
            draws = draws.join(done.select(*CHAIN).distinct(), CHAIN, "left_anti")
    publish_fits(draws, path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics by model; series that are stored already are left alone."""
    append_new(metrics, path, ["model", "gene"], ["model"])


def write_merged(merged: DataFrame, path: str) -> None:
    """The merged table of all models, whole, by model."""
    merged.write.mode("overwrite").partitionBy("model").parquet(path)


def write_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """``rows`` as a table of the warehouse, in ``buckets`` by ``keys`` and sorted in them; the table.

    Joins and groups of such tables on these keys need no shuffle; all tables that are to meet must have as many buckets.
    """
    dealt = rows.repartition(buckets, *keys)  # so that a bucket is one file
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return rows.sparkSession.table(table)


def write_report(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A wide report as csv with one header a file, in the order of the keys."""
    rows.orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def pending_fits(todo: DataFrame, path: str) -> DataFrame:
    """The (gene, model, chain) rows of ``todo`` that no published run has draws or an error of."""
    for kind in ("draws", "errors"):
        done = published(todo.sparkSession, path, kind)
        if done is not None:
            todo = todo.join(done.select(*CHAIN).distinct(), CHAIN, "left_anti").select(*todo.columns)
    return todo


def settings_text(rows: DataFrame) -> DataFrame:
    """(path, text): the settings files of (path, section, key, value) rows, sections and keys in order; ``reports.settings`` reads them back.

    Rows without a section come first.
    """
    lines = rows.groupBy("path", "section").agg(F.sort_array(F.collect_list(F.concat("key", F.lit(" = "), F.coalesce("value", F.lit(""))))).alias("_lines"))
    head = F.when(F.col("section").isNotNull(), F.concat(F.lit("["), "section", F.lit("]\n"))).otherwise("")
    part = F.struct(F.coalesce("section", F.lit("")).alias("s"), F.concat(head, F.array_join("_lines", "\n")).alias("text"))
    return lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "\n\n").alias("text"))


def goodness_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a goodness-of-fit file of each series from (keys, line, metric, y, model) rows; ``reports.goodness_of_fit`` reads it back."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.struct("line", F.concat_ws(",", F.col("metric"), cell("y"), cell("model")).alias("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit(",y,model\n"), body).alias("text"))


def estimates_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a parameter table of each series from (keys, param, packed) rows; ``reports.parameter_estimates`` reads it back."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("param", "packed"))), lambda x: F.concat_ws(",", x["param"], x["packed"])), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit(",mean ± std\n"), body).alias("text"))


def report_text(goodness: DataFrame, estimated: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a report in markdown with both tables of each series; a series without estimates has the first table only."""
    table = lambda head, row, order: F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, row.alias("text")))), lambda x: x["text"]), "\n"))
    cell = lambda c: F.coalesce(F.format_string("%.6g", F.col(c)), F.lit(""))
    first = goodness.groupBy(*keys).agg(table("| metric | y | model |\n|---|---|---|\n", F.concat(F.lit("| "), F.concat_ws(" | ", "metric", cell("y"), cell("model")), F.lit(" |")), "line").alias("_fit"))
    second = estimated.groupBy(*keys).agg(table("| parameter | mean ± std |\n|---|---|\n", F.concat(F.lit("| "), F.concat_ws(" | ", "param", "packed"), F.lit(" |")), "param").alias("_estimates"))
    text = F.concat_ws("\n\n", F.lit("# Report"), F.lit("## Parameter estimates"), F.coalesce("_estimates", F.lit("none")), F.lit("## Goodness of fit"), "_fit")
    return first.join(second, keys, "left").select(*keys, text.alias("text"))


def write_texts(texts: DataFrame, path: str, folder: str) -> None:
    """One text file a series, in a folder ``<folder>=<value>`` of its own below ``path``, from rows of (``folder``, text); an older tree is replaced.

    The readers of ``reports`` find the files by ``name="*.txt"`` and the series in their paths.
    """
    texts.where(F.col(folder).isNotNull()).select(folder, "text").write.mode("overwrite").partitionBy(folder).text(path)


def write_reports(goodness: DataFrame, estimated: DataFrame, path: str, key: str) -> None:
    """goodness_of_fit/, parameter_estimates/ and report/ below ``path`` with a file for each series, of the rows that the text functions take."""
    write_texts(goodness_text(goodness, [key]), f"{path}/goodness_of_fit", key)
    write_texts(estimates_text(estimated, [key]), f"{path}/parameter_estimates", key)
    write_texts(report_text(goodness, estimated, [key]), f"{path}/report", key)
