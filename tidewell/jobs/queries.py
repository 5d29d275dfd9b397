"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, normal
from ..operators import collect, compare, diagnostics, dists, etl, metrics, posterior, series, variational, vectors
from ..operators.ranks import percentiles
from ..sources.tables import daily_series, table
from . import infer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


DAILY = "daily AS (SELECT event_type AS gene, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)::DOUBLE AS time, avg(value) AS y FROM events GROUP BY 1, 2)"
INIT = """placed AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY time) AS up, row_number() OVER (PARTITION BY gene ORDER BY time DESC) AS down FROM daily),
init AS (SELECT gene, count(*) AS n, max(CASE WHEN time = 0 THEN y END) AS m0, arg_min(y, time) AS first, avg(CASE WHEN down <= 3 THEN y END) AS z_ss0,
  max(CASE WHEN up > 2 AND down > 2 THEN y END) AS z_max0, min(time) AS t_min, max(time) AS t_max FROM placed GROUP BY 1),
start AS (SELECT *, z_ss0 * 0.1::DOUBLE + 1e-8::DOUBLE AS beta0, z_max0 * 0.1::DOUBLE + 1e-8::DOUBLE AS alpha0 FROM init)"""


# ---- from measurements to series


@query("""SELECT l_partkey, time, round(avg(s), 6) AS y FROM (SELECT month(o_orderdate)::BIGINT AS time, l_partkey, l_orderkey, sum(l_quantity) AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def gene_time_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Two-level mean: sum by (month, part, order), then the mean over orders."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.month("o_orderdate").cast("long").alias("time"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    tasks = etl.tasks_for(lines.count() + orders.count(), spark)
    lines = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey", "left")
    return rounded(etl.two_level_mean(lines, ["time", "l_partkey"], "l_orderkey", "l_quantity", tasks=tasks).select("l_partkey", "time", "y"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, measure, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE value)")
def melt_measures(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(etl.melt(wide, ["l_orderkey", "l_linenumber"], "measure", "value"), 12)


@query("""WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT user_id, day, round(total, 6) AS total FROM (SELECT DISTINCT user_id FROM d) CROSS JOIN (SELECT DISTINCT day FROM d) LEFT JOIN d USING (user_id, day)""")
def densify_grid(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    daily = table(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(F.sum("value").alias("total"))
    return rounded(etl.densify(daily, "user_id", "day", "total"))


@query("""WITH d AS (SELECT event_type AS gene, hour(ts)::DOUBLE + (minute(ts) // 15)::DOUBLE / 4 AS time, avg(value) AS y FROM events GROUP BY 1, 2)
SELECT gene, time, round(y, 6) AS y FROM (SELECT DISTINCT gene FROM d) CROSS JOIN (SELECT DISTINCT time FROM d) LEFT JOIN d USING (gene, time)""")
def densify_fractional(spark: SparkSession, sf: str) -> DataFrame:
    """Series over observed times that are no integers: quarters of an hour of the day."""
    time = F.hour("ts") + F.floor(F.minute("ts") / 15).cast("double") / 4.0
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("gene"), time.alias("time")).agg(F.avg("value").alias("y"))
    return rounded(etl.densify(rows, "gene", "time", "y"))


@query("""WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS day, sum(value) AS total FROM events GROUP BY 1, 2), t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM d))
SELECT user_id, i, t.day, round(total, 6) AS total FROM (SELECT DISTINCT user_id FROM d) CROSS JOIN t LEFT JOIN d USING (user_id, day)""")
def dense_series(spark: SparkSession, sf: str) -> DataFrame:
    """One array a user over all days that any user has, null where the user has none; told place by place."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("double")
    daily = table(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(F.sum("value").alias("total"))
    rows = vectors.dense(daily, "user_id", "day", "total").select("user_id", F.posexplode("series").alias("i", "p"))
    return rounded(rows.select("user_id", F.col("i").cast("long").alias("i"), "p.day", "p.total"))


@query(f"WITH {DAILY} SELECT gene, time, round(y, 6) AS y FROM daily WHERE time BETWEEN 2 AND 12")
def time_slice(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.time_slice(daily_series(table(spark, sf, "events")), 2, 12))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return series.points(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")[0]


@query(f"WITH {DAILY}, {INIT} SELECT gene, n, round(m0, 6) AS m0, round(first, 6) AS first, round(z_ss0, 6) AS z_ss0, round(z_max0, 6) AS z_max0, t_min, t_max, round(beta0, 8) AS beta0, round(alpha0, 8) AS alpha0 FROM start")
def series_init(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.initial_values(daily_series(table(spark, sf, "events"))), beta0=8, alpha0=8)


@query(f"""WITH {DAILY}, grid AS (SELECT gene, unnest(range(0, 4 * (max(time)::BIGINT + 2)))::DOUBLE / 4 AS time FROM daily GROUP BY gene)
SELECT g.gene, g.time, round(a.y + CASE WHEN a.time = b.time THEN 0 ELSE (b.y - a.y) * (g.time - a.time) / (b.time - a.time) END, 6) AS y FROM grid g
LEFT JOIN daily a ON a.gene = g.gene AND a.time = (SELECT max(time) FROM daily x WHERE x.gene = g.gene AND x.time <= g.time)
LEFT JOIN daily b ON b.gene = g.gene AND b.time = (SELECT min(time) FROM daily x WHERE x.gene = g.gene AND x.time >= g.time)""")
def regrid_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Daily series on a grid of six hours, null beyond the last day."""
    daily = daily_series(table(spark, sf, "events"))
    last = daily.groupBy("gene").agg((4 * (F.max("time").cast("long") + 2) - 1).alias("last"))
    grid = last.select("gene", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i")).select("gene", (F.col("i") / 4.0).alias("time"))
    return rounded(series.regrid(daily, grid))


@query(f"WITH {DAILY} SELECT gene, time, least(greatest((time - 3) / 1.0::DOUBLE, 0), 1) AS ramp, round(1 / (1 + exp(-5 * (time - 3))), 9) AS onset FROM daily")
def ramp_forcing(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_series(table(spark, sf, "events"))
    return daily.select("gene", "time", models.ramp(F.col("time")).alias("ramp"), F.round(models.activation(F.col("time"), F.lit(3.0)), 9).alias("onset"))


@query(f"""WITH {DAILY}, r AS (SELECT gene, time, least(greatest(time - 3, 0), 1) AS f FROM daily)
SELECT gene, time, round(sum(coalesce(step, 0)) OVER (PARTITION BY gene ORDER BY time), 9) AS exposure FROM (SELECT *, (time - lag(time) OVER w) * (f + lag(f) OVER w) / 2 AS step FROM r WINDOW w AS (PARTITION BY gene ORDER BY time))""")
def forcing_exposure(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_series(table(spark, sf, "events")).withColumn("f", models.ramp(F.col("time")))
    return rounded(series.exposure(daily, "f").select("gene", "time", "exposure"), 9)


GRIDDED = """ends AS (SELECT gene, max(time) AS t_end FROM daily GROUP BY 1),
grid AS (SELECT gene, i, i * t_end / 1000 AS time, least(greatest(i * t_end / 1000 - 3, 0), 1)::DOUBLE AS f FROM ends, range(0, 1001) AS k(i)),
near AS (SELECT d.gene, d.time, max(g.i) FILTER (g.time <= d.time) AS a, min(g.i) FILTER (g.time >= d.time) AS b FROM daily d JOIN grid g USING (gene) GROUP BY 1, 2),
forced AS (SELECT gene, near.time, x.f + CASE WHEN x.time = y.time THEN 0 ELSE (y.f - x.f) * (near.time - x.time) / (y.time - x.time) END AS forcing
  FROM near JOIN grid x USING (gene) JOIN grid y USING (gene) WHERE x.i = a AND y.i = b)"""


@query(f"WITH {DAILY}, {GRIDDED} SELECT gene, time, round(forcing, 6) AS forcing FROM forced")
def forcing_regrid(spark: SparkSession, sf: str) -> DataFrame:
    """The ramp sampled on 1001 points up to each series' end, read again at its own times."""
    return rounded(forcing_on_grid(spark, sf).withColumnRenamed("f", "forcing"))


def forcing_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, time, f): ``forcing_regrid`` as it is."""
    daily = daily_series(table(spark, sf, "events"))
    ends = daily.groupBy("gene").agg(F.max("time").alias("t_end"))
    grid = models.time_grid(ends, "t_end").withColumn("y", models.ramp(F.col("time")).cast("double"))
    return series.regrid(grid, daily.select("gene", "time")).withColumnRenamed("y", "f")


@query("WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) SELECT p_partkey, rn, (rn - 1) // 500 + 1 AS chunk FROM p")
def chunk_assign(spark: SparkSession, sf: str) -> DataFrame:
    return series.chunks(table(spark, sf, "part").select("p_partkey"), "p_partkey").select("p_partkey", "rn", "chunk")


# ---- models


def _started(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_series(table(spark, sf, "events"))
    return daily.join(series.initial_values(daily).select("gene", "first", "beta0", "alpha0"), "gene")


def _model(name: str, gridded: bool = False):
    """A query that evaluates one model at each series' own times, with priors' medians as parameters.

    ``gridded``: the forcing is sampled on 1001 points up to the series' end, read again at its own times, integrated between them
    and told beside the output; else it is the ramp itself.
    """
    prior = {k: v.median for k, v in models.PRIORS[name].items()}
    z_decay, repressed = name.endswith("_z"), "alpha" in prior

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _started(spark, sf)
        rows = rows.join(forcing_on_grid(spark, sf), ["gene", "time"]) if gridded else rows.withColumn("f", models.ramp(F.col("time")))
        rows = series.exposure(rows, "f")
        t = F.col("time")
        m = models.maternal(F.col("first"), F.lit(prior["delta_m"]), F.col("exposure") if z_decay else t)
        extra = (F.col("alpha0"), F.lit(prior["dt_rep"])) if repressed else ()
        z = models.zygotic(t, F.lit(prior["delta_z"]), lambda u: models.production(u, F.col("beta0"), F.lit(prior["t_zga"]), *extra))
        return rounded(rows.select("gene", "time", (m + z).alias("y"), *(["f"] if gridded else [])))

    on, off = "(1 / (1 + exp(-greatest(least(5 * (u - 3), 700), -700))))", "(1 / (1 + exp(-greatest(least(5 * (u - 9), 700), -700))))"
    g = f"(alpha0 * {on} * (1 - {off}) + beta0 * {off})" if repressed else f"(beta0 * {on})"
    forcing = f"{GRIDDED}, r AS (SELECT gene, time, forcing AS f FROM forced)" if gridded else "r AS (SELECT gene, time, least(greatest(time - 3, 0), 1) AS f FROM daily)"
    sql = f"""WITH {DAILY}, {INIT}, {forcing},
e AS (SELECT gene, time, f, sum(coalesce(step, 0)) OVER (PARTITION BY gene ORDER BY time) AS exposure FROM (SELECT *, (time - lag(time) OVER w) * (f + lag(f) OVER w) / 2 AS step FROM r WINDOW w AS (PARTITION BY gene ORDER BY time))),
z AS (SELECT gene, time, sum(w * exp(-0.1::DOUBLE * (time - u)) * {g}) * time / 1000 / 3 AS z FROM
  (SELECT e.gene, time, beta0, alpha0, i * time / 1000 AS u, CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM e JOIN start USING (gene), range(0, 1001) AS k(i)) GROUP BY 1, 2)
SELECT gene, time, round(first * exp(-{prior["delta_m"]}::DOUBLE * {"exposure" if z_decay else "time"}) + z, 6) AS y{", round(f, 6) AS f" if gridded else ""} FROM e JOIN start USING (gene) JOIN z USING (gene, time)"""
    run.__name__ = f"model_{name}{'_grid' if gridded else ''}"
    query(sql)(run)


for _name in ("zga_m", "zga_z", "rep_m", "rep_z"):
    _model(_name)
for _name in ("zga_z", "rep_z"):
    _model(_name, gridded=True)

PRED = f"{DAILY}, {INIT}, pairs AS (SELECT gene, time, y AS obs, first * exp(-0.1::DOUBLE * time) + beta0 / 0.1::DOUBLE * (1 - exp(-0.1::DOUBLE * time)) AS pred FROM daily JOIN start USING (gene))"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _started(spark, sf)
    return rows.select("gene", "time", F.col("y").alias("obs"), models.basic(F.col("first"), F.col("beta0"), F.lit(0.1), F.col("time")).alias("pred"))


@query(f"WITH {PRED} SELECT gene, time, round(pred, 6) AS y FROM pairs")
def model_basic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_pairs(spark, sf).select("gene", "time", F.col("pred").alias("y")))


@query("""SELECT p_partkey, round(-ln(p_retailprice * 2.5066282746310002::DOUBLE) - pow(ln(p_retailprice / m), 2) / 2, 6) AS log_prior FROM part JOIN (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1) USING (p_brand)""")
def prior_density(spark: SparkSession, sf: str) -> DataFrame:
    """Log-normal density of each part's price around its brand's median."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    middle = percentiles(part, ["p_brand"], "p_retailprice", {"m": 0.5})
    return rounded(part.join(middle, "p_brand").select("p_partkey", models.log_prior(F.col("p_retailprice"), F.col("m"), 1.0).alias("log_prior")))


# ---- metrics

RHO = """ranked AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {a}) + (count(*) OVER (PARTITION BY {k}, {a}) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY {k} ORDER BY {b}) + (count(*) OVER (PARTITION BY {k}, {b}) - 1) / 2.0::DOUBLE AS rb FROM {t}),
rho AS (SELECT {k}, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS spearman FROM ranked GROUP BY {k})"""


def _errors_sql(t: str, k: str) -> str:
    return f"""err AS (SELECT {k}, count(*) AS n, sqrt(avg(pow(obs - pred, 2))) AS rmse, max(obs) - min(obs) AS span, avg(obs) AS mean, stddev_pop(obs) AS sd, sum(abs(obs - pred)) / nullif(sum(abs(obs - own)), 0) AS mase
  FROM (SELECT *, avg(obs) OVER (PARTITION BY {k}) AS own FROM {t}) GROUP BY {k})"""


@query(f"""WITH {PRED}, {_errors_sql("pairs", "gene")}, {RHO.format(k="gene", a="obs", b="pred", t="pairs")}
SELECT gene, n, round(rmse, 6) AS rmse, round(rmse / nullif(span, 0), 6) AS nrmse_range, round(rmse / nullif(mean, 0), 6) AS nrmse_mean, round(rmse / nullif(sd, 0), 6) AS nrmse_std, round(mase, 6) AS mase, round(spearman, 8) AS spearman FROM err JOIN rho USING (gene)""")
def fit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.fit_metrics(_pairs(spark, sf), ["gene"]), spearman=8)


@query(f"""WITH {PRED}, {_errors_sql("pairs", "gene")}, {RHO.format(k="gene", a="obs", b="pred", t="pairs")},
r AS (SELECT *, obs - pred AS r, lag(obs - pred) OVER w AS l, var_pop(obs - pred) OVER (PARTITION BY gene ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v,
  count(*) OVER (PARTITION BY gene ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM pairs WINDOW w AS (PARTITION BY gene ORDER BY time)),
d AS (SELECT gene, avg(CASE WHEN c = 3 THEN v END) / nullif(var_pop(r), 0) AS variance_ratio, covar_pop(r, l) FILTER (l IS NOT NULL) / nullif(stddev_pop(r) FILTER (l IS NOT NULL) * stddev_pop(l), 0) AS autocorrelation,
  sum(-0.5::DOUBLE * ln(2 * pi() * 0.25::DOUBLE) - pow(ln(1 + obs) - ln(1 + pred), 2) / 0.5::DOUBLE) AS log_likelihood FROM r GROUP BY 1)
SELECT gene, n, round(rmse, 6) AS rmse, round(rmse / nullif(span, 0), 6) AS nrmse_range, round(rmse / nullif(mean, 0), 6) AS nrmse_mean, round(rmse / nullif(sd, 0), 6) AS nrmse_std, round(mase, 6) AS mase, round(spearman, 8) AS spearman,
  round(variance_ratio, 6) AS variance_ratio, round(autocorrelation, 6) AS autocorrelation, round(log_likelihood, 6) AS log_likelihood, round(3 * ln(n) - 2 * log_likelihood, 6) AS bic FROM err JOIN rho USING (gene) JOIN d USING (gene)""")
def fit_metrics_dense(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of each series as folds over one array."""
    return rounded(vectors.fold_metrics(vectors.vectors(_pairs(spark, sf), ["gene"], ["time", "obs", "pred"])), spearman=8)


@query(f"""WITH {PRED}, half AS (SELECT * FROM pairs WHERE time::BIGINT % 2 = 0), {_errors_sql("half", "gene")}
SELECT gene, n, round(rmse, 6) AS rmse, round(mase, 6) AS mase FROM err""")
def paired_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Observations against predictions that come as a table of their own and lack every other time."""
    pairs = _pairs(spark, sf)
    observed = daily_series(table(spark, sf, "events")).withColumnRenamed("y", "obs")
    predicted = pairs.where(F.col("time").cast("long") % 2 == 0).select("gene", "time", "pred")
    return rounded(metrics.errors(metrics.paired(observed, predicted, ["gene", "time"]), ["gene"]).select("gene", "n", "rmse", "mase"))


@query(f"""WITH {PRED}, r AS (SELECT *, obs - pred AS r, lag(obs - pred) OVER w AS l, var_pop(obs - pred) OVER (PARTITION BY gene ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v,
  count(*) OVER (PARTITION BY gene ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM pairs WINDOW w AS (PARTITION BY gene ORDER BY time))
SELECT gene, round(avg(CASE WHEN c = 3 THEN v END) / nullif(var_pop(r), 0), 6) AS variance_ratio, round(covar_pop(r, l) FILTER (l IS NOT NULL) / nullif(stddev_pop(r) FILTER (l IS NOT NULL) * stddev_pop(l), 0), 6) AS autocorrelation FROM r GROUP BY 1""")
def residual_diag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.residual_diagnostics(_pairs(spark, sf), ["gene"]))


@query(f"""WITH {PRED}, l AS (SELECT gene, count(*) AS n, sum(-0.5::DOUBLE * ln(2 * pi() * 0.25::DOUBLE) - pow(ln(1 + obs) - ln(1 + pred), 2) / 0.5::DOUBLE) AS ll FROM pairs GROUP BY 1)
SELECT gene, n, round(ll, 6) AS log_likelihood, round(3 * ln(n) - 2 * ll, 6) AS bic FROM l""")
def loglik_bic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.likelihood(_pairs(spark, sf), ["gene"], 0.5, 3))


@query(f"WITH {RHO.format(k='l_suppkey', a='l_quantity', b='l_discount', t='lineitem')} SELECT l_suppkey, round(spearman, 8) AS spearman FROM rho")
def spearman_ties(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    return rounded(metrics.spearman(lines, ["l_suppkey"], "l_quantity", "l_discount"), 8)


# ---- summaries of draws


def _draws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")


@query("SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1, 2")
def sample_mean_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.mean_median(_draws(spark, sf), ["event_type", "day"], "value"))


@query("""WITH v AS (SELECT event_type, ts::DATE AS day, list_sort(list(value)) AS v FROM events GROUP BY 1, 2),
s AS (SELECT event_type, day, v, unnest(range(1, len(v) - least(floor(0.95::DOUBLE * len(v))::BIGINT, len(v) - 1) + 1)) AS i, least(floor(0.95::DOUBLE * len(v))::BIGINT, len(v) - 1) AS k FROM v)
SELECT event_type, day, round(arg_min(v[i], (round(v[i + k] - v[i], 9), i)), 6) AS hdi_lo, round(arg_min(v[i + k], (round(v[i + k] - v[i], 9), i)), 6) AS hdi_hi FROM s GROUP BY 1, 2""")
def hdi_95(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.hdi_by(_draws(spark, sf), ["event_type", "day"], "value"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.05), 6) AS lo, round(quantile_cont(l_extendedprice, 0.95), 6) AS hi FROM lineitem GROUP BY 1")
def point_interval_90(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.point_interval(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def posterior_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.estimates(_draws(spark, sf), ["event_type"]).drop("packed"))


# ---- comparison of models: order priorities stand for models, parts for series

FITS = f"""base AS (SELECT o_orderpriority AS model, l_partkey AS gene, l_quantity AS obs, l_quantity * (1 + (l_discount - 0.05::DOUBLE) * p_size / 2) AS pred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
{_errors_sql("base", "model, gene")}, {RHO.format(k="model, gene", a="obs", b="pred", t="base")},
fits AS (SELECT model, gene, n, rmse / nullif(span, 0) AS nrmse_range, mase, spearman, gene % 5 AS cluster FROM err JOIN rho USING (model, gene)),
flagged AS (SELECT *, coalesce(round(spearman, 10) > 0.7 AND round(nrmse_range, 10) < 0.2 AND round(mase, 10) < 1, false) AS ok FROM fits)"""


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    """(model, gene, n, nrmse_range, mase, spearman, cluster, ok): quantities against a prediction that errs with discount and size.

    A series is a part under a priority, its cluster the part's number modulo 5; about a third of the series is accepted.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = lines.join(orders, "l_orderkey").join(part, "l_partkey")
    pred = F.col("l_quantity") * (1.0 + (F.col("l_discount") - 0.05) * F.col("p_size") / 2.0)
    rows = rows.select(F.col("o_orderpriority").alias("model"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("obs"), pred.alias("pred"))
    out = vectors.fold_metrics(vectors.vectors(rows, ["model", "gene"], ["obs", "pred"])).select("model", "gene", "n", *(F.round(c, 10).alias(c) for c in ("nrmse_range", "mase", "spearman")))
    return out.withColumn("cluster", F.col("gene") % 5).withColumn("ok", compare.accepted())


@query(f"WITH {FITS} SELECT model, gene, n, round(nrmse_range, 10) AS nrmse_range, round(mase, 10) AS mase, round(spearman, 10) AS spearman FROM flagged WHERE ok")
def accept_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fits(spark, sf).where("ok").select("model", "gene", "n", "nrmse_range", "mase", "spearman"), 10)


@query(f"WITH {FITS} SELECT cluster, model, count(*) AS n FROM flagged WHERE ok GROUP BY 1, 2")
def accept_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _fits(spark, sf).where("ok").groupBy("cluster", "model").agg(F.count("*").alias("n"))


@query(f"WITH {FITS} SELECT cluster, count(DISTINCT gene) AS total, count(DISTINCT gene) FILTER (ok) AS accepted, round(count(DISTINCT gene) FILTER (ok) / count(DISTINCT gene)::DOUBLE, 6) AS share FROM flagged GROUP BY 1")
def accept_pct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.accept_share(_fits(spark, sf), ["cluster"], "gene", F.col("ok")))


_PIVOT = ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (ok AND model = '{p}') / nullif(count(*) FILTER (model = '{p}'), 0), 6) AS \"{p}\"" for p in PRIORITIES)


@query(f"WITH {FITS} SELECT cluster, {_PIVOT} FROM flagged GROUP BY 1")
def accept_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.accept_heatmap(_fits(spark, sf), "model", "cluster", F.col("ok"), PRIORITIES))


def _venn_sql(keys: str) -> str:
    on = f"{keys}, " if keys else ""
    flags = ", ".join(f"bool_or(model = '{p}') AS f{i}" for i, p in enumerate(PRIORITIES))
    parts = [
        f"SELECT {on}'{PRIORITIES[i]}' AS a, '{PRIORITIES[j]}' AS b, count(*) FILTER (f{i} AND NOT f{j}) AS only_a, count(*) FILTER (f{j} AND NOT f{i}) AS only_b, count(*) FILTER (f{i} AND f{j}) AS \"both\" FROM g {'GROUP BY ' + keys if keys else ''}"
        for i in range(5)
        for j in range(i + 1, 5)
    ]
    return f"WITH {FITS}, g AS (SELECT {on}gene, {flags} FROM flagged WHERE ok GROUP BY {on}gene) " + " UNION ALL ".join(parts)


@query(_venn_sql(""))
def venn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.venn_pairs(_fits(spark, sf).where("ok"), "model", "gene", PRIORITIES)


@query(_venn_sql("cluster"))
def venn_pairs_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return compare.venn_pairs(_fits(spark, sf).where("ok"), "model", "gene", PRIORITIES, ["cluster"])


@query(f"WITH {FITS} SELECT coalesce(a.gene, b.gene) AS gene, round(a.nrmse_range, 10) AS urgent, round(b.nrmse_range, 10) AS low FROM (SELECT * FROM fits WHERE model = '1-URGENT') a FULL JOIN (SELECT * FROM fits WHERE model = '5-LOW') b ON a.gene = b.gene")
def outer_align(spark: SparkSession, sf: str) -> DataFrame:
    """The same series under two models side by side, missing ones null."""
    fits = _fits(spark, sf).select("model", "gene", "nrmse_range")
    side = lambda m, name: fits.where(F.col("model") == m).select("gene", F.col("nrmse_range").alias(name))
    return rounded(side("1-URGENT", "urgent").join(side("5-LOW", "low"), "gene", "full"), 10)


@query(" UNION ALL ".join(f"SELECT '{p}' AS model, o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean, max(n_regionkey)::BIGINT AS cluster FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '{p}' GROUP BY o_custkey" for p in PRIORITIES))
def model_union_join(spark: SparkSession, sf: str) -> DataFrame:
    """All models in one grouped plan, merged once with the annotation."""
    orders = table(spark, sf, "orders").where(F.col("o_orderpriority").isin(PRIORITIES))
    both = orders.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("gene_id")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("cluster"))
    annotation = table(spark, sf, "customer").select(F.col("c_custkey").alias("ensembl_gene_id"), "c_nationkey").join(nation, "c_nationkey").drop("c_nationkey")
    merged = both.join(compare.clustered(annotation), F.col("gene_id") == F.col("ensembl_gene_id"))
    return rounded(merged.select("model", F.col("gene_id").alias("o_custkey"), "n", "mean", "cluster"))


@query("""WITH m AS (SELECT o_orderpriority AS model, o_custkey AS gene_id, count(*) AS n FROM orders GROUP BY 1, 2),
f AS (SELECT o_orderpriority AS model, o_custkey AS gene_id, round(avg(o_totalprice), 6) AS bic FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT model, gene_id, n, bic, c_nationkey::DOUBLE AS cluster FROM m JOIN f USING (model, gene_id) JOIN customer ON gene_id = c_custkey WHERE c_nationkey % 7 <> 0""")
def merged_models(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and goodness of fit of all models with the annotation; series without a cluster fall out."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("gene_id"), "o_totalprice", "o_orderstatus")
    counts = orders.groupBy("model", "gene_id").agg(F.count("*").alias("n"))
    fits = orders.where("o_orderstatus <> 'P'").groupBy("model", "gene_id").agg(F.round(F.avg("o_totalprice"), 6).alias("bic"))
    none = F.when(F.col("c_nationkey") % 14 == 0, F.lit(float("nan"))).when(F.col("c_nationkey") % 7 == 0, F.lit(-1.0))
    clusters = table(spark, sf, "customer").select(F.col("c_custkey").alias("ensembl_gene_id"), F.coalesce(none, F.col("c_nationkey").cast("double")).alias("cluster"))
    return compare.merge_models(counts, fits, clusters).select("model", "gene_id", "n", "bic", "cluster")


@query("""SELECT s_suppkey AS gene_id, round(s_acctbal, 6) AS beta_mean, n_name AS cluster_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey""")
def annotated_params(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters with the annotation where there is one."""
    params = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gene_id"), F.round("s_acctbal", 6).alias("beta_mean"), "s_nationkey")
    names = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey_"), F.col("n_name").alias("cluster_name"))
    return compare.annotated(params, names, "s_nationkey", "s_nationkey_").select("gene_id", "beta_mean", "cluster_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_accept(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(good, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_pending(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return collect.pending(table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT o_orderpriority IS NOT DISTINCT FROM '5-LOW' GROUP BY 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by model without one model; the comparison is null-safe."""
    return compare.value_counts(table(spark, sf, "orders").where(~F.col("o_orderpriority").eqNullSafe("5-LOW")), "o_orderpriority")


_CHAINS = """base AS (SELECT event_type AS gene, user_id % 4 AS chain, value AS x, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS draw, count(*) OVER (PARTITION BY event_type, user_id % 4) AS held FROM events),
far AS (SELECT *, abs(x - median(x) OVER (PARTITION BY gene)) AS f, min(held) OVER (PARTITION BY gene) AS n_draws FROM base),
ranked AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY gene ORDER BY f) + (count(*) OVER (PARTITION BY gene, f) - 1) / 2.0::DOUBLE AS rf, count(*) OVER (PARTITION BY gene) AS n FROM far),
shares AS (SELECT *, n_draws // 2 AS half, (rx - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS px, (rf - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS pf FROM ranked),
halves AS (SELECT gene, n_draws, half, chain * 2 + (draw > half)::INT AS part, CASE WHEN draw > half THEN draw - (held - half) ELSE draw END AS i, {px} AS z, {pf} AS zf FROM shares WHERE draw <= half OR draw > held - half),
each AS (SELECT gene, n_draws, half, part, avg(z) AS m, var_samp(z) AS v, avg(zf) AS mf, var_samp(zf) AS vf FROM halves GROUP BY ALL),
hats AS (SELECT gene, n_draws, half, count(*) AS parts, sqrt(((half - 1) / half::DOUBLE * avg(v) + var_samp(m)) / avg(v)) AS a, sqrt(((half - 1) / half::DOUBLE * avg(vf) + var_samp(mf)) / avg(vf)) AS b,
  avg(v) AS within, avg(v) * (half - 1) / half::DOUBLE + var_samp(m) AS over_all FROM each GROUP BY gene, n_draws, half),
lags AS (SELECT x.gene, y.i - x.i AS t, sum((x.z - e.m) * (y.z - e.m)) / e.half::DOUBLE / any_value(h.parts) AS c FROM halves x JOIN halves y ON x.gene = y.gene AND x.part = y.part AND y.i >= x.i JOIN each e ON e.gene = x.gene AND e.part = x.part JOIN hats h ON h.gene = x.gene GROUP BY x.gene, y.i - x.i, e.half),
rho AS (SELECT gene, t, CASE WHEN t = 0 THEN 1 ELSE 1 - (within - c) / over_all END AS r FROM lags JOIN hats USING (gene)),
pairs AS (SELECT gene, t // 2 AS j, sum(r) AS p FROM rho GROUP BY 1, 2 HAVING count(*) = 2),
open AS (SELECT *, min(p) OVER (PARTITION BY gene ORDER BY j) AS kept FROM pairs),
taus AS (SELECT gene, sum(kept) FILTER (kept >= 0) AS s FROM open GROUP BY 1)""".format(px=normal.quantile_sql("px"), pf=normal.quantile_sql("pf"))


@query(f"""WITH {_CHAINS} SELECT gene, 4::BIGINT AS chains, n_draws, round(greatest(a, b), 6) AS rhat, round(parts * half / greatest(2 * s - 1, 1 / log10(parts * half)), 3) AS ess FROM hats JOIN taus USING (gene)""")
def chain_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """R-hat and effective sample size of four chains a type of event, a quarter of the users each."""
    draws = table(spark, sf, "events").select(F.col("event_type").alias("gene"), (F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("draw"), "value")
    return rounded(diagnostics.convergence(draws, ["gene"]), ess=3)


# ---- reports

def _hdi_sql(t: str, keys: str, value: str, out: str) -> str:
    """The shortest interval over 95 % of the ranks, the first of equals."""
    k = "least(floor(0.95::DOUBLE * len(v))::BIGINT, len(v) - 1)"
    return f"""{out}_v AS (SELECT {keys}, list_sort(list({value})) AS v FROM {t} GROUP BY ALL),
{out}_s AS (SELECT {keys}, v, unnest(range(1, len(v) - {k} + 1)) AS i, {k} AS k FROM {out}_v),
{out} AS (SELECT {keys}, arg_min(v[i], (round(v[i + k] - v[i], 9), i)) AS lower, arg_min(v[i + k], (round(v[i + k] - v[i], 9), i)) AS upper FROM {out}_s GROUP BY ALL)"""


DRAWN = f"""{DAILY}, {INIT}, told AS (SELECT event_type AS gene, user_id % 40 AS draw, avg(value) AS u FROM events GROUP BY 1, 2),
params AS (SELECT gene, draw, beta0 * u / avg(u) OVER (PARTITION BY gene) AS beta, 0.1::DOUBLE * avg(u) OVER (PARTITION BY gene) / u AS delta, 0.5::DOUBLE AS sigma, first FROM told JOIN start USING (gene)),
predicted AS (SELECT gene, draw, time, y AS obs, sigma, first * exp(-delta * time) + beta / delta * (1 - exp(-delta * time)) AS pred FROM params JOIN daily USING (gene)),
scores AS (SELECT gene, draw, count(*) AS n, sqrt(avg(pow(obs - pred, 2))) / nullif(max(obs) - min(obs), 0) AS nrmse,
  sum(-0.5::DOUBLE * ln(2 * pi() * sigma * sigma) - pow(ln(1 + obs) - ln(1 + pred), 2) / (2 * sigma * sigma)) AS log_likelihood FROM predicted GROUP BY 1, 2),
scored AS (SELECT *, 3 * ln(n) - 2 * log_likelihood AS bic FROM scores),
long AS (UNPIVOT (SELECT gene, draw, nrmse, log_likelihood, bic FROM scored) ON nrmse, log_likelihood, bic INTO NAME metric VALUE value),
{_hdi_sql("long", "gene, metric", "value", "spans")}"""


def _draw_params(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """Draws of the basic model, one for each fortieth of the users, and their curve."""
    events = table(spark, sf, "events")
    told = events.groupBy(F.col("event_type").alias("gene"), (F.col("user_id") % 40).alias("draw")).agg(F.avg("value").alias("u"))
    middle = told.groupBy("gene").agg(F.avg("u").alias("m"))
    started = series.initial_values(daily_series(events)).select("gene", "first", "beta0")
    draws = told.join(middle, "gene").join(started, "gene")
    draws = draws.select("gene", "draw", "first", (F.col("beta0") * F.col("u") / F.col("m")).alias("beta"), (0.1 * F.col("m") / F.col("u")).alias("delta"), F.lit(0.5).alias("sigma"))
    return draws, models.basic(F.col("first"), F.col("beta"), F.col("delta"), F.col("time"))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Draws x times of the basic model beside the observations."""
    draws, curve = _draw_params(spark, sf)
    return posterior.predictive(draws, daily_series(table(spark, sf, "events")).withColumnRenamed("y", "obs"), ["gene"], curve)


@query(f"WITH {DRAWN} SELECT gene, time, round(avg(pred), 6) AS mean, round(median(pred), 6) AS median FROM predicted GROUP BY 1, 2")
def posterior_predictive(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and median curve over the draws."""
    return rounded(posterior.mean_median(_predicted(spark, sf), ["gene", "time"], "pred"))


@query(f"""WITH {DRAWN}, ends AS (SELECT gene, max(time) AS t_end FROM daily GROUP BY 1), grid AS (SELECT gene, i, i * t_end / 999 AS time FROM ends, range(0, 1000) AS k(i))
SELECT gene, i, round(avg(first * exp(-delta * time) + beta / delta * (1 - exp(-delta * time))), 6) AS mean FROM params JOIN grid USING (gene) GROUP BY 1, 2""")
def predictive_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The mean curve over the draws on an even grid of 1000 points."""
    draws, curve = _draw_params(spark, sf)
    ends = daily_series(table(spark, sf, "events")).groupBy("gene").agg(F.max("time").alias("t_end"))
    grid = models.time_grid(ends, "t_end", 1000, "i").select("gene", "i", "time")
    return rounded(posterior.predictive(draws, grid, ["gene"], curve).groupBy("gene", "i").agg(F.avg("pred").alias("mean")))


@query(f"""WITH {DRAWN}, numbered AS (SELECT DISTINCT gene, draw, dense_rank() OVER (PARTITION BY gene ORDER BY draw) AS i, n FROM params JOIN (SELECT gene, count(*) AS n FROM params GROUP BY 1) USING (gene)),
thin AS (SELECT gene, time, pred FROM predicted JOIN numbered USING (gene, draw) WHERE i * 25 // n > (i - 1) * 25 // n), {_hdi_sql("thin", "gene, time", "pred", "band")}
SELECT gene, time, round(avg(pred), 6) AS mean, round(median(pred), 6) AS median, round(max(lower), 6) AS hdi_lo, round(max(upper), 6) AS hdi_hi, count(*) AS n FROM thin JOIN band USING (gene, time) GROUP BY 1, 2""")
def predictive_band(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and shortest 95 % interval over 25 evenly spaced draws at every time of a series."""
    draws, curve = _draw_params(spark, sf)
    times = daily_series(table(spark, sf, "events")).select("gene", "time")
    return rounded(posterior.predictive_band(posterior.predictive(posterior.thinned(draws, ["gene"], 25), times, ["gene"], curve), ["gene", "time"]))


_PRIOR_U = {p: f"((0.5::DOUBLE + draw * {a!r}::DOUBLE) - floor(0.5::DOUBLE + draw * {a!r}::DOUBLE))" for p, a in zip(models.PRIORS["basic"], posterior.STEPS)}


@query(f"""WITH {DAILY}, {INIT}, u AS (SELECT gene, first, beta0, draw::BIGINT AS draw, {", ".join(f"{u} AS u_{p}" for p, u in _PRIOR_U.items())} FROM start, range(0, 64) AS k(draw)),
params AS (SELECT gene, first, draw, beta0 * exp({normal.quantile_sql("u_beta")}) AS beta, 0.1::DOUBLE * exp({normal.quantile_sql("u_delta")}) AS delta FROM u)
SELECT gene, time, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(quantile_cont(p, 0.05), 6) AS lo, round(quantile_cont(p, 0.95), 6) AS hi
FROM (SELECT gene, time, first * exp(-delta * time) + beta / delta * (1 - exp(-delta * time)) AS p FROM params JOIN daily USING (gene)) GROUP BY 1, 2""")
def prior_predictive(spark: SparkSession, sf: str) -> DataFrame:
    """Curves of the basic model under its priors alone: 64 draws a series, their mean, median and 90 % interval at each time."""
    daily = daily_series(table(spark, sf, "events"))
    draws = posterior.prior_draws(series.initial_values(daily), models.PRIORS["basic"], 64)
    curve = models.basic(F.col("first"), F.col("beta"), F.col("delta"), F.col("time"))
    rows = posterior.predictive(draws, daily.select("gene", "time"), ["gene"], curve)
    spans = posterior.point_interval(rows, ["gene", "time"], "pred")
    return rounded(rows.groupBy("gene", "time").agg(F.avg("pred").alias("mean")).join(spans, ["gene", "time"]).select("gene", "time", "mean", "median", "lo", "hi"))


@query(f"WITH {DRAWN} SELECT gene, metric, round(avg(value), 6) AS mean, round(max(lower), 6) AS lower, round(max(upper), 6) AS upper FROM long JOIN spans USING (gene, metric) GROUP BY 1, 2")
def gof_from_draws(spark: SparkSession, sf: str) -> DataFrame:
    """NRMSE, log-likelihood and BIC of every draw, their means and shortest 95 % intervals."""
    return rounded(posterior.goodness_of_draws(posterior.fit_of_draws(_predicted(spark, sf), ["gene"], free=len(models.PRIORS["basic"])), ["gene"]))


_METRICS = (("nrmse", "NRMSE", "y"), ("log_likelihood", "Log-Likelihood", "y"), ("bic", "BIC", "model"))
_WIDE = ", ".join(
    f"round(max({v}) FILTER (metric = '{m}'), 6) AS {name}{end}"
    for m, name in (("nrmse", "nrmse"), ("log_likelihood", "loglik"), ("bic", "bic"))
    for v, end in (("mean", ""), ("lower", "_lower"), ("upper", "_upper"))
)


@query(f"""WITH {DRAWN}, g AS (SELECT gene, metric, avg(value) AS mean, max(lower) AS lower, max(upper) AS upper FROM long JOIN spans USING (gene, metric) GROUP BY 1, 2)
SELECT gene, {_WIDE} FROM g GROUP BY 1""")
def gof_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows as a report has them, every line twice with a wrong second one, back to one row a series of nine columns."""
    found = gof_from_draws(spark, sf)
    ends = (("mean", ""), ("lower", " (95%-hdi[lower])"), ("upper", " (95%-hdi[upper])"))
    lines = [(i, m, c, f"{name}{end}", side) for i, ((m, name, side), (c, end)) in enumerate((x, y) for x in _METRICS for y in ends)]
    of = lambda side, s, c: (F.col(c) if side == s else F.lit(None)).cast("double")
    row = lambda i, m, c, name, side, late: F.when(F.col("metric") == m, F.struct(F.lit(i + late).alias("line"), F.lit(name).alias("metric"), (of(side, "y", c) + late).alias("y"), (of(side, "model", c) + late).alias("model")))
    each = F.array_compact(F.array(*(row(*x, late) for x in lines for late in (0, 100))))
    rows = found.select("gene", F.explode(each).alias("r")).select("gene", "r.*")
    return rounded(collect.goodness_wide(rows, ["gene"], "line"))


def _significant_sql(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x} * pow(10, 2 - floor(log10(abs({x}))))) / pow(10, 2 - floor(log10(abs({x})))) END"


@query(f"""WITH s AS (SELECT l_suppkey, avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qs, avg(l_discount) AS dm, stddev_samp(l_discount) AS ds FROM lineitem GROUP BY 1)
SELECT l_suppkey, {", ".join(f"round({_significant_sql(c)}, 9) AS {name}" for c, name in (("dm", "discount_mean"), ("qm", "quantity_mean"), ("ds", "discount_std"), ("qs", "quantity_std")))} FROM s""")
def param_pack_unpack(spark: SparkSession, sf: str) -> DataFrame:
    """Means and deviations packed as text of three significant figures, read back and pivoted; the last of repeated parameters counts."""
    each = F.array(*(F.struct(F.lit(name).alias("param"), F.col(c).alias("value")) for name, c in ((" quan tity", "l_quantity"), ("discount", "l_discount"))))
    long = table(spark, sf, "lineitem").select("l_suppkey", F.explode(each).alias("r")).select("l_suppkey", "r.*")
    packed = posterior.estimates(long, ["l_suppkey", "param"]).select("l_suppkey", "param", F.col("packed").alias("value"), F.lit(2).alias("line"))
    stale = packed.withColumn("value", F.lit("1e-05 ± 2e-06")).withColumn("line", F.lit(1))
    return rounded(collect.parameters_wide(packed.union(stale), ["l_suppkey"], "line", ["discount", "quantity"]), 9)


# ---- distributions


@query("""WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, least(coalesce(floor((l_extendedprice - lo) / nullif((hi - lo) / 50, 0)), 0)::BIGINT + 1, 50) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY 1, 2""")
def hist50(spark: SparkSession, sf: str) -> DataFrame:
    return dists.histogram(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 8) AS cdf FROM lineitem")
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dists.ecdf(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity"), 8)


@query("""WITH x AS (SELECT o_orderpriority, log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0),
e AS (SELECT o_orderpriority, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h, count(*) AS n FROM x GROUP BY 1),
g AS (SELECT *, unnest(range(0, 50)) AS i FROM e)
SELECT o_orderpriority, i, round(lo + (hi - lo) * i / 49, 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((lo + (hi - lo) * i / 49 - x.x) / h, 2))) / (n * h * 2.5066282746310002::DOUBLE), 6) AS density FROM g JOIN x USING (o_orderpriority) GROUP BY o_orderpriority, i, lo, hi, h, n""")
def kde_log(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dists.kde(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(o_totalprice) FILTER (ok), 6) AS lo, round(max(o_totalprice) FILTER (ok), 6) AS hi, count(*) FILTER (NOT ok) AS fliers
FROM (SELECT *, o_totalprice BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM orders JOIN q USING (o_orderpriority)) GROUP BY 1, 2, 3, 4""")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dists.box(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"))


_LABELS = "CASE cluster " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in compare.CLUSTERS.items()) + " END"
_METRIC_COLUMNS = ["nrmse_range", "mase", "spearman"]


@query(f"""WITH {FITS}, long AS (UNPIVOT (SELECT cluster, model, nrmse_range, mase, spearman FROM fits) ON nrmse_range, mase, spearman INTO NAME metric VALUE value)
SELECT cluster, {_LABELS} AS cluster_name, model, metric, round(median(value), 5) AS median, round(quantile_cont(value, 0.05), 5) AS lo, round(quantile_cont(value, 0.95), 5) AS hi FROM long GROUP BY ALL""")
def model_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 90 % interval of each metric by cluster and model, clusters by name."""
    long = _fits(spark, sf).unpivot(["cluster", "model"], _METRIC_COLUMNS, "metric", "value")
    out = posterior.point_interval(long, ["cluster", "model", "metric"], "value")
    return rounded(compare.labelled(out, "cluster", {k: v for k, v in compare.CLUSTERS.items()}, "cluster_name"), 5)


def _kde_sql(source: str, keys: str) -> str:
    return f"""e AS (SELECT {keys}, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h, count(*) AS n FROM {source} GROUP BY ALL),
g AS (SELECT *, unnest(range(0, 50)) AS i FROM e WHERE h > 0),
density AS (SELECT {keys}, i, lo + (hi - lo) * i / 49 AS x, sum(exp(-0.5::DOUBLE * pow((lo + (hi - lo) * i / 49 - s.x) / h, 2))) / (n * h * 2.5066282746310002::DOUBLE) AS density
  FROM g JOIN {source} s USING ({keys}) GROUP BY {keys}, i, lo, hi, n, h)"""


@query(f"""WITH {FITS}, shown AS (SELECT model, cluster, round(nrmse_range, 10) AS x FROM fits WHERE round(nrmse_range, 10) < 1 AND round(mase, 10) < 2), {_kde_sql("shown", "model, cluster")},
q AS (SELECT model, cluster, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM shown GROUP BY ALL)
SELECT model, cluster, i, round(x, 6) AS x, round(density, 6) AS density, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM density JOIN q USING (model, cluster)""")
def violin_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Density and quartiles of the errors in plot range, by model and cluster."""
    return rounded(dists.violin(compare.in_plot_range(_fits(spark, sf)), ["model", "cluster"], "nrmse_range"))


@query(f"""WITH {FITS}, s AS (SELECT model, cluster, round(nrmse_range, 10) AS v FROM fits WHERE nrmse_range IS NOT NULL), e AS (SELECT model, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1)
SELECT model, cluster, least(coalesce(floor((v - lo) / nullif((hi - lo) / 50, 0)), 0)::BIGINT + 1, 50) AS bin, count(*) AS n FROM s JOIN e USING (model) GROUP BY ALL""")
def hist50_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms by model and cluster; the clusters of a model share their bins."""
    return dists.histogram(_fits(spark, sf), ["model", "cluster"], "nrmse_range", edges=["model"])


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), g AS (SELECT i, lo + i * ((hi - lo) / 49) AS x FROM e, range(0, 50) AS k(i)),
f AS (SELECT DISTINCT l_returnflag FROM lineitem)
SELECT l_returnflag, i, round(x, 6) AS x, round((count(l_extendedprice) FILTER (l_extendedprice <= x OR i = 49))::DOUBLE / count(*), 8) AS cdf FROM g, f JOIN lineitem USING (l_returnflag) GROUP BY 1, 2, 3""")
def cumulative_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative shares of several groups on one grid."""
    return rounded(dists.cumulative(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice"), cdf=8)


@query(f"""WITH p AS (SELECT n_regionkey::BIGINT AS cluster, log10(s_acctbal) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0), {_kde_sql("p", "cluster")}
SELECT {_LABELS} AS cluster_name, i, round(x, 6) AS x, round(density, 6) AS density FROM density""")
def param_kde_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Densities of the logarithm of a positive parameter, each cluster on its own, by name."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("int").alias("cluster"))
    params = table(spark, sf, "supplier").select("s_nationkey", F.col("s_acctbal").alias("beta_mean")).join(nation, "s_nationkey").where("beta_mean > 0")
    return rounded(compare.labelled(dists.kde(params, "cluster", "beta_mean"), "cluster", compare.CLUSTERS, "cluster_name").drop("cluster"))


@query(f"""WITH x AS (SELECT o_orderpriority, o_totalprice AS x FROM orders),
e AS (SELECT o_orderpriority, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT o_orderpriority, (x - lo) / (hi - lo) * 65535 AS pos FROM x JOIN e USING (o_orderpriority)),
c AS (SELECT o_orderpriority, cell, sum(w) AS w FROM (SELECT o_orderpriority, floor(pos) AS cell, 1 - (pos - floor(pos)) AS w FROM p UNION ALL SELECT o_orderpriority, floor(pos) + 1, pos - floor(pos) FROM p) GROUP BY 1, 2),
g AS (SELECT *, unnest(range(0, 50)) AS i FROM e),
z AS (SELECT o_orderpriority, i, n, w, lo + (hi - lo) * i / 49 AS x, (lo + (hi - lo) * i / 49 - (lo + (hi - lo) * cell / 65535)) / h AS z FROM g JOIN c USING (o_orderpriority))
SELECT o_orderpriority, i, round(x, 6) AS x, round(sum(w * {normal.cdf_sql("z")}) / n, 6) AS cdf FROM z GROUP BY o_orderpriority, i, n, x""")
def smooth_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative densities: each value counts by a normal distribution around it, values in cells of a fine grid first."""
    return rounded(dists.smooth_cumulative(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice"))


_ORDER = ", ".join(f"({i}, '{p}')" for i, p in enumerate([*PRIORITIES, "6-NONE"], 1))


@query(f"""WITH {FITS}, o(place, model) AS (VALUES {_ORDER}), good AS (SELECT * FROM flagged WHERE ok)
SELECT c.cluster, o.model, place::BIGINT AS place, count(good.gene) AS n FROM (SELECT DISTINCT cluster FROM good) c CROSS JOIN o LEFT JOIN good ON good.cluster = c.cluster AND good.model = o.model GROUP BY ALL""")
def accept_count_order(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted series by cluster for every model of a fixed order, with 0 where there is none."""
    return rounded(compare.ordered_counts(_fits(spark, sf).where("ok"), ["cluster"], "model", [*PRIORITIES, "6-NONE"]))


@query("SELECT * FROM (SELECT 'l_quantity' AS variable, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem)")
def variable_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return dists.extremes(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


# ---- inference


@query(f"WITH RECURSIVE {DAILY}, {INIT}, {variational.fit_sql('daily', 'start', 400, 0.02)}\nSELECT gene, " + ", ".join(f"round(mean_[{j}], 5) AS {p}_mean, round(exp(mean_[{j + 3}]), 5) AS {p}_sd" for j, p in enumerate(variational.NAMES, 1)) + " FROM variational WHERE i = 400")
def variational_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Means and deviations of the basic model's log-parameters for each series, after 400 steps."""
    daily = daily_series(table(spark, sf, "events"))
    return rounded(variational.fit(daily, series.initial_values(daily), 400, 0.02), 5)


@query()
def mcmc_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior mean and deviation of all models' parameters for each series; a failed chain is a row with its error."""
    return infer.summary(infer.fit(daily_series(table(spark, sf, "events")), list(models.PRIORS)))
