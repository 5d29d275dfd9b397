"""Per-series report files and settings: text lines with their numbers, tidy rows.

Report, settings and list files are small, so a file is one row that is cut into lines: line numbers are exact
whatever the partitioning, and nothing passes through Python. Missing files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import missing

GENE = r"ENSDARG[0-9]+"
#: Columns of summary files that hold text.
TEXT = ("GeneID", "gene_id", "ensembl_gene_id", "ensembl_transcript_id", "model", "type", "tpm_level", "cluster_name")
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def basename(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def file_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(path, line, value) of every line of the text files at or below ``path``, numbered from 1 in each file."""
    reader = spark.read.option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", name) if name else reader).text(path, wholetext=True)
    cut = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(cut).alias("at", "value"))
    last = F.max("at").over(Window.partitionBy("path"))
    return lines.withColumn("_last", last).where((F.col("value") != "") | (F.col("at") < F.col("_last"))).select("path", (F.col("at") + 1).cast("long").alias("line"), "value")


def numbered_lines(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(line, value) of lines first..last of a text file, from 1; first = last reads one line."""
    return file_lines(spark, path).where(F.col("line").between(first, last)).select("line", "value").orderBy("line")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, path, name) of a file that lists paths; blank lines are left out."""
    lines = file_lines(spark, path).where(F.trim("value") != "")
    return lines.select("line", F.trim("value").alias("path"), basename(F.trim("value")).alias("name")).orderBy("line")


def file_count(spark: SparkSession, path: str, name: str) -> int:
    """How many files of a name are at or below ``path``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).format("binaryFile").load(path).select("path").count()


def without_file(ids: DataFrame, files: DataFrame, key: str = "gene_id") -> DataFrame:
    """The listed ids that no row of ``files`` (what a reader has found) is of: what was skipped, to be told or run again."""
    return ids.select(key).where(F.col(key).isNotNull()).distinct().join(files.select(key).distinct(), key, "left_anti")


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def goodness_of_fit(spark: SparkSession, path: str, name: str = "goodness_of_fit.csv") -> DataFrame:
    """(gene_id, path, line, metric, y, model) of every file ``name`` below ``path``, without its header line."""
    rows = file_lines(spark, path, name).where("line > 1")
    fields = F.split("value", ",")
    return rows.select(
        F.regexp_extract("path", GENE, 0).alias("gene_id"), "path", "line",
        F.get(fields, F.lit(0)).alias("metric"), _number(F.get(fields, F.lit(1))).alias("y"), _number(F.get(fields, F.lit(2))).alias("model"),
    ).orderBy("path", "line")


def parameter_estimates(spark: SparkSession, path: str, name: str = "report_table_parameter_estimates.csv") -> DataFrame:
    """(gene_id, path, line, param, value) of every parameter table below ``path``, split at the first comma; white space in names is dropped."""
    rows = file_lines(spark, path, name).where("line > 1")
    param = F.regexp_replace(F.regexp_extract("value", "^([^,]*)", 1), r"\s", "")
    rows = rows.select(F.regexp_extract("path", GENE, 0).alias("gene_id"), "path", "line", param.alias("param"), F.regexp_extract("value", "^[^,]*,(.*)$", 1).alias("value"))
    return rows.where("param <> ''").orderBy("path", "line")


def wide_matrix(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """A transcript matrix with one column a sample, found by its name in the header, whatever the order; without ``samples`` all columns but the ids.

    A cell that is no number is null, a sample that the header lacks an error. Files of one path must have the same header.
    """
    ids = ["ensembl_gene_id", "ensembl_transcript_id"]
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    absent = [c for c in [*ids, *(samples or [])] if c not in rows.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    named = lambda c: F.col(f"`{c}`")
    return rows.select(*map(named, ids), *(missing(named(c).try_cast("double")).alias(c) for c in samples or [c for c in rows.columns if c not in ids]))


def sample_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, time_hpf) of a sample file, whatever other columns it has."""
    return spark.read.option("header", True).csv(path).select("sample_id", F.col("time_hpf").try_cast("double").alias("time_hpf"))


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """(ensembl_gene_id, cluster, tpm_level, type, cluster_name); a cluster that is no number is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("ensembl_gene_id", _number(F.col("cluster")).alias("cluster"), *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("tpm_level", "type", "cluster_name")))


def summaries(spark: SparkSession, paths: dict[str, str], text: tuple[str, ...] = TEXT) -> DataFrame:
    """One table with a column ``model`` from the summary files (csv with header) of several models; header rows inside are left out.

    The first column of a file and those named in ``text`` stay text, all others are numbers, null where a cell is none. Without paths the table is empty.
    """
    out = None
    for model, path in paths.items():
        part = spark.read.option("header", True).csv(path)
        key, named = part.columns[0], lambda c: F.col(f"`{c}`")
        part = part.where(named(key) != key).select(F.lit(model).alias("model"), *(named(c) if c == key or c in text else _number(named(c)).alias(c) for c in part.columns if c != "model"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], "model string") if out is None else out


def series_dataset(spark: SparkSession, path: str, kind: str = "mean") -> DataFrame:
    """A dataset of series in long form (parquet). ``mean``: one row a gene and time; else every sample."""
    rows = spark.read.parquet(path)
    return rows.groupBy("gene", "time").agg(F.avg("y").alias("y")) if kind == "mean" else rows


def posterior(spark: SparkSession, path: str, model: str | None = None, kind: str | None = None, genes: list[str] | None = None) -> DataFrame:
    """Stored draws or predictions, pruned to partitions by model and kind; genes are pushed to the scan."""
    rows = spark.read.parquet(path)
    for column, wanted in (("model", model), ("kind", kind)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    return rows if genes is None else rows.where(F.col("gene").isin(genes))


def settings(lines: DataFrame) -> DataFrame:
    """(section, key, value) of INI texts given as (line, value) rows; with a column path, of each file by itself."""
    own = ["path"] if "path" in lines.columns else []
    section = F.regexp_extract("value", r"^\[(.+)\]\s*$", 1)
    # a file is short; without a path the rows are those of one file
    order = Window.partitionBy(*own).orderBy("line")
    named = lines.withColumn("section", F.last(F.when(section != "", section), ignorenulls=True).over(order))
    parts = F.regexp_extract("value", r"^\s*([^=\[#;][^=]*?)\s*=\s*(.*?)\s*$", 1), F.regexp_extract("value", r"^\s*([^=\[#;][^=]*?)\s*=\s*(.*?)\s*$", 2)
    return named.select(*own, "section", parts[0].alias("key"), parts[1].alias("value")).where("key <> ''")


def _depths(text: Column) -> Column:
    """The depth of brackets after each character."""
    deeper = lambda c: F.when(F.lit("([{").contains(c), 1).when(F.lit(")]}").contains(c), -1).otherwise(0)
    add = lambda acc, c: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + deeper(c)))
    return F.aggregate(F.split(text, ""), F.array().cast("array<int>"), add)


def inside(text: Column) -> Column:
    """What a call "name(...)" holds between its brackets; null for a text that is no single call."""
    trimmed = F.trim(text)
    closed = F.array_position(F.transform(_depths(trimmed), lambda d, i: (d == 0) & (i >= F.length(F.regexp_extract(trimmed, r"^[A-Za-z_][\w.]*\(", 0)))), True)
    body = F.regexp_extract(trimmed, r"^[A-Za-z_][\w.]*\((?s)(.*)\)$", 1)
    return F.when(trimmed.rlike(r"^[A-Za-z_][\w.]*\((?s).*\)$") & (closed == F.length(trimmed)), body)


def split_outside(text: Column) -> Column:
    """The parts of a text between commas and blanks that stand outside of all brackets; empty parts are left out."""
    depths = _depths(text)
    marked = F.zip_with(F.split(text, ""), depths, lambda c, d: F.when((d == 0) & c.rlike(r"[,\s]"), F.lit("\n")).otherwise(F.regexp_replace(c, "\n", " ")))
    return F.filter(F.split(F.concat_ws("", marked), "\n"), lambda x: x != "")


def terms(value: Column) -> Column:
    """name -> text of the settings' small language: "f(a=1, b=g(x, y))" or "a=1 b=[2, 3]"; the last of repeated names counts.

    Brackets are counted character by character, so a text is split only outside of all of them; the values keep theirs.
    """
    whole = F.regexp_replace(value, r"\s*=\s*", "=")
    pairs = F.filter(split_outside(F.coalesce(inside(whole), whole)), lambda x: x.contains("="))
    pairs = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_extract(x, "^[^=]*=((?s).*)$", 1).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.when(value.isNotNull(), F.map_from_entries(last))


def _flag(text: Column) -> Column:
    return F.lower(text).try_cast("boolean")


def parameters(lines: DataFrame) -> DataFrame:
    """(name, value, dims, median, sd, hyper, free) of the section [model-parameters] of ``settings`` rows; with a column path, by file.

    ``median`` and ``sd`` are those of a log-normal prior, null for a parameter without one. A free parameter without a readable prior raises an error.
    """
    own = ["path"] if "path" in lines.columns else []
    rows = lines.where("section = 'model-parameters'").withColumn("_t", terms(F.col("value")))
    prior = F.try_element_at("_t", F.lit("prior"))
    median, sd = lognormal_terms(prior)
    free = F.coalesce(_flag(F.try_element_at("_t", F.lit("free"))), F.lit(False))
    broken = F.raise_error(F.format_string("parameter %s is free and has the prior %s", F.col("key"), F.coalesce(prior, F.lit("none"))))
    dims = split_outside(F.regexp_replace(F.try_element_at("_t", F.lit("dims")), r"^\[|\]$|['\"]", ""))
    return rows.select(
        *own, F.col("key").alias("name"), F.try_element_at("_t", F.lit("value")).try_cast("double").alias("value"), dims.alias("dims"),
        F.when(free & (median.isNull() | sd.isNull()), broken.cast("double")).otherwise(median).alias("median"), sd.alias("sd"),
        F.coalesce(_flag(F.try_element_at("_t", F.lit("hyper"))), F.lit(False)).alias("hyper"), free.alias("free"),
    )


def variables(lines: DataFrame) -> DataFrame:
    """(name, dimensions, min, max, observed) of the section [data-structure] of ``settings`` rows; bounds that are nan are null."""
    own = ["path"] if "path" in lines.columns else []
    rows = lines.where("section = 'data-structure'").withColumn("_t", terms(F.col("value"))).where(F.map_contains_key("_t", F.lit("dimensions")))
    number = lambda name: missing(F.try_element_at("_t", F.lit(name)).try_cast("double")).alias(name)
    dimensions = split_outside(F.regexp_replace(F.element_at("_t", F.lit("dimensions")), r"^\[|\]$|['\"]", ""))
    return rows.select(*own, F.col("key").alias("name"), dimensions.alias("dimensions"), number("min"), number("max"), F.coalesce(_flag(F.try_element_at("_t", F.lit("observed"))), F.lit(False)).alias("observed"))


def lognormal_terms(value: Column) -> tuple[Column, Column]:
    """(median, sd) of "lognorm(scale=.., s=..)"."""
    take = lambda key: F.try_element_at(terms(value), F.lit(key)).try_cast("double")
    is_prior = F.trim(value).startswith("lognorm(")
    return F.when(is_prior, take("scale")), F.when(is_prior, take("s"))


def lognormal_text(scale: Column, sd: Column) -> Column:
    """The text that ``lognormal_terms`` reads."""
    return F.concat(F.lit("lognorm(scale="), scale.cast("string"), F.lit(", s="), sd.cast("string"), F.lit(")"))


def case_name(model: Column, kernel: Column, t_end: Column) -> Column:
    """The folder of a case: model_kernel_end."""
    return F.concat_ws("_", model, kernel, t_end.cast("string"))
