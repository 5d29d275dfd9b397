"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host. A beta-binomial prior is handed down
from the whole table to the suffix, from there to the registered domain and from there to the
host; at each level its strength comes from the spread of the children by the method of moments.
A host is blocked when the lower bound of its posterior bad rate exceeds a threshold.

DataFrame functions only. Null or unusable urls have an empty host and path; a host without
labels keeps its prior; without any labels nothing is blocked by reputation. Repeated pages each
get a row, and a document with several labels counts once, as bad if any label says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Standard deviations below the posterior mean, and the bad rate that this bound may not exceed.
Z, MOST_BAD = 1.645, 0.5
#: Pages of a host are joined to its statistics in so many slices.
SALTS = 64
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + name) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """One row a labelled document: bad is 1 for low quality or toxic text."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    return labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy("doc_id").agg(F.max(bad).alias("bad"))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad_rate, bad_low) of each host of ``pages(host, doc_id)``."""
    per_doc = pages.groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    hosts = (
        per_doc.join(outcomes(labels), "doc_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n_host"), F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).alias("k_host"))
        .withColumn("domain", F.substring_index("host", ".", -2))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )
    hosts = hosts.checkpoint()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n_host").alias("n_domain"), F.sum("k_host").alias("k_domain"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n_domain").alias("n_suffix"), F.sum("k_domain").alias("k_suffix"))
    n, k = hosts.agg(F.coalesce(F.sum("n_host"), F.lit(0)), F.coalesce(F.sum("k_host"), F.lit(0))).first()
    prior = (k + 0.5) / (n + 1.0)
    known = suffixes.withColumn("above", F.lit(float(prior)))
    for level, below in zip(LEVELS, (domains, hosts, None), strict=True):
        size, bad = F.col(f"n_{level}"), F.col(f"k_{level}")
        spread = F.sum(F.when(size > 0, F.pow(bad - size * F.col("above"), 2) / size / (F.col("above") * (1 - F.col("above")))))
        s, m, total = known.agg(F.coalesce(spread, F.lit(0.0)), F.count(F.when(size > 0, 1)), F.coalesce(F.sum(size), F.lit(0))).first()
        rho = min(max((s - m) / max(total - m, 1), 0.001), 0.5)
        strength = 1.0 / rho - 1.0
        rate = (bad + F.lit(strength) * F.col("above")) / (size + F.lit(strength))
        known = known.withColumn("rate", rate)
        if below is not None:
            known = below.join(known.select(level, F.col("rate").alias("above")), level)
    weight = F.col("n_host") + F.lit(strength)
    low = F.col("rate") - F.lit(Z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return known.select("host", F.col("rate").alias("bad_rate"), low.alias("bad_low"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_bad: float = MOST_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages(page_id, url)``.

    The labelled outcome of a page is that of the document whose number ends its path.
    """
    prepare(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    doc = F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[.]html|/)?$', 1) as bigint)")
    rated = reputations(parts.select("host", doc.alias("doc_id")), labels)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rated = rated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    method = F.when(F.col("bad_low") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(rated, ["host", "salt"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def _level(name: str, source: str, parent: str, key: str) -> str:
    return f"""
{name}_in AS ({source}),
{name}_m AS (SELECT 1.0::DOUBLE / greatest(least((coalesce(sum(CASE WHEN n > 0 THEN pow(k - n * above, 2) / n / (above * (1 - above)) END), 0) - count(*) FILTER (n > 0))
   / greatest(coalesce(sum(n), 0) - count(*) FILTER (n > 0), 1), 0.5), 0.001) - 1.0::DOUBLE AS strength FROM {name}_in),
{name}_r AS (SELECT {key}, n, strength, (k + strength * above) / (n + strength) AS rate FROM {name}_in, {name}_m)"""


ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
told AS (SELECT *, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[.]html|/)?$', 1) AS BIGINT) AS doc_id FROM parts),
seen AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix,
          count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM told LEFT JOIN seen USING (doc_id) GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
{_level("s", "SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM hosts)::DOUBLE AS above FROM suffixes", "", "suffix")},
{_level("d", "SELECT d.*, s_r.rate AS above FROM domains d JOIN s_r USING (suffix)", "", "domain")},
{_level("h", "SELECT h.*, d_r.rate AS above FROM hosts h JOIN d_r USING (domain)", "", "host")},
judged AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (n + strength + 1)) AS low FROM h_r)
SELECT page_id, host, path, r.rule AS rule,
  CASE WHEN r.rule IN ({", ".join(f"'{t}'" for v, t in RULES if v == "block")}) THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow' WHEN low > {MOST_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE {" ".join(f"WHEN ends_with('.' || host, '.{t.partition('/')[0]}') AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'" for v, t in sorted(RULES, key=lambda r: -len(r[1])))} END AS rule FROM parts) r
LEFT JOIN judged USING (host)
"""
