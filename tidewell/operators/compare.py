"""Comparison of models: merging, acceptance, counts, ratios, set regions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import divide, missing

SPEARMAN, NRMSE, MASE = 0.7, 0.2, 1.0
NRMSE_SHOWN, MASE_SHOWN = 1.0, 2.0
#: Keys of header rows that concatenated files repeat, in lower case.
HEADERS = ("geneid", "gene_id", "ensembl_gene_id")
#: Names of the clusters, fixed values.
CLUSTERS = {0: "SD", 1: "TU pre-ZGA", 2: "TU post-ZGA", 3: "SU ZGA", 4: "SU post-ZGA"}


def clustered(annotation: DataFrame, cluster: str = "cluster", noise: bool = False) -> DataFrame:
    """Rows that have a cluster; without ``noise``, negative ones are left out, too. NaN is no cluster."""
    c = missing(F.col(cluster).cast("double"))
    return annotation.where(c.isNotNull() if noise else c >= 0)


def merge_models(metrics: DataFrame, fits: DataFrame, annotation: DataFrame, key: str = "gene_id", other: str = "ensembl_gene_id") -> DataFrame:
    """All models' metrics with their goodness of fit and the annotation, one row a model and series.

    Both tables hold all models with a column ``model``, so each is read and joined once. Stray header rows are left out.
    """
    metrics = metrics.where(~F.lower(F.col(key).cast("string")).isin(*HEADERS))
    joined = metrics.join(fits, ["model", key])
    return joined.join(clustered(annotation), F.col(key) == F.col(other)).drop(other)


def annotated(params: DataFrame, annotation: DataFrame, key: str = "gene_id", other: str = "ensembl_gene_id") -> DataFrame:
    """All parameters, with the annotation where there is one; clusters are kept as they are, noise included."""
    return params.join(annotation, F.col(key) == F.col(other), "left").drop(other)


def in_plot_range(rows: DataFrame, nrmse: str = "nrmse_range", mase: str = "mase") -> DataFrame:
    """Rows whose errors are shown; undefined errors are not."""
    return rows.where((missing(F.col(nrmse)) < NRMSE_SHOWN) & (missing(F.col(mase)) < MASE_SHOWN))


def labelled(rows: DataFrame, column: str, labels: dict, out: str) -> DataFrame:
    """``out``: the label of each code, null for a code without one."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return rows.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None).cast("string"))


def accepted(spearman: str = "spearman", nrmse: str = "nrmse_range", mase: str = "mase") -> Column:
    """Whether a fit is acceptable; undefined metrics never are."""
    s, r, m = (missing(F.col(c)) for c in (spearman, nrmse, mase))
    return F.coalesce((s > SPEARMAN) & (r < NRMSE) & (m < MASE), F.lit(False))


def accept_share(rows: DataFrame, keys: list[str], gene: str, flag: Column) -> DataFrame:
    """Distinct series, accepted ones and their share."""
    total, good = F.count_distinct(F.col(gene)), F.count_distinct(F.when(flag, F.col(gene)))
    return rows.groupBy(*keys).agg(total.alias("total"), good.alias("accepted"), divide(good, total).alias("share"))


def accept_heatmap(rows: DataFrame, model: str, cluster: str, flag: Column, order: list[str]) -> DataFrame:
    """Percentage of accepted rows: clusters down, models across in a fixed order.

    One conditional count in place of two counts and a join. A group without accepted rows has 0.
    """
    ratio = rows.dropna(subset=[model, cluster]).groupBy(cluster, model).agg((divide(F.count_if(flag), F.count("*")) * 100).alias("ratio"))
    return ratio.groupBy(cluster).pivot(model, order).agg(F.first("ratio")).orderBy(cluster)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values, most frequent first, ties by value."""
    return rows.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def ordered_counts(rows: DataFrame, keys: list[str], column: str, order: list) -> DataFrame:
    """(keys, column, place, n): how often each entry of ``order`` occurs in a group, 0 where it does not, in that order."""
    n = F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(x).alias(column), F.count_if(F.col(column) == x).alias("n")) for i, x in enumerate(order)))
    out = rows.groupBy(*keys).agg(n.alias("_each")).select(*keys, F.inline("_each"))
    return out.select(*keys, column, "place", "n").orderBy(*keys, "place")


def venn_pairs(rows: DataFrame, group: str, member: str, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """only_a, only_b and both for every two groups, from one pass over flags of each member."""
    keys = keys or []
    flags = rows.groupBy(*keys, member).agg(*(F.max(F.when(F.col(group) == x, 1).otherwise(0)).alias(f"f{i}") for i, x in enumerate(names)))
    pairs = list(combinations(range(len(names)), 2))
    sums = []
    for i, j in pairs:
        a, b = F.col(f"f{i}") == 1, F.col(f"f{j}") == 1
        sums += [F.count_if(a & ~b).alias(f"a{i}_{j}"), F.count_if(~a & b).alias(f"b{i}_{j}"), F.count_if(a & b).alias(f"c{i}_{j}")]
    wide = flags.groupBy(*keys).agg(*sums)
    each = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"a{i}_{j}").alias("only_a"), F.col(f"b{i}_{j}").alias("only_b"), F.col(f"c{i}_{j}").alias("both")) for i, j in pairs]
    return wide.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*")
