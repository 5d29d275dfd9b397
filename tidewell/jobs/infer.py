"""Bayesian fits of the kinetic models, one task group a series, model and chain.

An adaptive Metropolis sampler walks in log parameters. Seeds derive from series, model and chain, so
repeats and retried tasks give the same draws. A fit that fails returns a row with its error instead.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import N, PRIORS, STEEPNESS
from ..functions.stable import stable
from ..operators.posterior import estimates
from ..sources.sinks import pending_fits, publish_fits

PARTITIONS = 10_000
DRAWS = "gene string, model string, chain int, draw int, param string, value double, error string"


def predict(model: str, p: dict[str, float], m0: float, t: np.ndarray, forcing: np.ndarray | None = None, n: int = N) -> np.ndarray:
    """The model's curve at times t, by the same quadrature as the column expressions."""
    if model == "basic":
        return m0 * np.exp(-p["delta"] * t) + p["beta"] / p["delta"] * (1 - np.exp(-p["delta"] * t))
    exposure = t
    if model.endswith("_z"):
        r = np.clip(t - 3.0, 0, 1) if forcing is None else forcing
        exposure = np.concatenate([[0], np.cumsum(np.diff(t) * (r[1:] + r[:-1]) / 2)])
    u = t[:, None] * np.linspace(0, 1, n + 1)
    w = np.where(np.arange(n + 1) % 2, 4.0, 2.0)
    w[[0, -1]] = 1.0
    on = 1 / (1 + np.exp(np.clip(-STEEPNESS * (u - p["t_zga"]), -700, 700)))
    g = p["beta"] * on
    if "alpha" in p:
        off = 1 / (1 + np.exp(np.clip(-STEEPNESS * (u - p["t_zga"] - p["dt_rep"]), -700, 700)))
        g = p["alpha"] * on * (1 - off) + p["beta"] * off
    z = (np.exp(-p["delta_z"] * (t[:, None] - u)) * g * w).sum(1) * t / n / 3
    return m0 * np.exp(-p["delta_m"] * exposure) + z


def sample(model: str, t: np.ndarray, y: np.ndarray, seed: int, warmup: int = 1000, draws: int = 2000) -> dict[str, np.ndarray]:
    """Posterior draws of the free parameters; values that the error model has no logarithm for are an error."""
    if not (np.isfinite(y).all() and (y > -1).all()):
        raise ValueError("values must be above -1")
    known = {"beta0": y[-3:].mean() * 0.1 + 1e-8, "alpha0": (y[2:-2].max() if len(y) > 4 else y.max()) * 0.1 + 1e-8}
    names = list(PRIORS[model])
    median = np.log([known.get(p.median, p.median) for p in PRIORS[model].values()])
    sd = np.array([p.sd for p in PRIORS[model].values()])
    seen = np.log1p(y)

    def log_density(x: np.ndarray) -> float:
        p = dict(zip(names, np.exp(x), strict=True))
        r = seen - np.log1p(np.maximum(predict(model, p, y[0], t), 0))
        return float(-0.5 * (((x - median) / sd) ** 2).sum() - len(y) * np.log(p["sigma"]) - (r * r).sum() / (2 * p["sigma"] ** 2))

    rng = np.random.default_rng(seed)
    x, scale = median.copy(), np.eye(len(names)) * 0.05
    here, size, walked, kept = log_density(x), 1.0, [], []
    if not np.isfinite(here):
        raise ValueError("the start of the chain has no finite density")
    for step in range(warmup + draws):
        to = x + size * scale @ rng.normal(size=len(x))
        there = log_density(to)
        moved = np.log(rng.random()) < there - here
        if moved:
            x, here = to, there
        if step < warmup:
            walked.append(x)
            size *= np.exp((moved - 0.3) / np.sqrt(step + 1))
            if step % 100 == 99 and step >= 199:
                scale = np.linalg.cholesky(np.cov(np.array(walked[step // 2 :]).T) + 1e-8 * np.eye(len(x)))
        else:
            kept.append(x)
    return dict(zip(names, np.exp(np.array(kept)).T, strict=True))


def _fit(warmup: int, draws: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gene, model, chain = rows["gene"].iloc[0], rows["model"].iloc[0], int(rows["chain"].iloc[0])
        try:
            rows = rows.dropna(subset=["y"]).sort_values("time")
            if len(rows) < 3:
                raise ValueError("fewer than three observations")
            got = sample(model, rows["time"].to_numpy(), rows["y"].to_numpy(), zlib.crc32(f"{gene}/{model}/{chain}".encode()), warmup, draws)
            parts = [pd.DataFrame({"gene": gene, "model": model, "chain": chain, "draw": np.arange(len(v), dtype=np.int32), "param": k, "value": v, "error": None}) for k, v in got.items()]
            return pd.concat(parts, ignore_index=True)
        except Exception as problem:
            return pd.DataFrame({"gene": [gene], "model": [model], "chain": [chain], "draw": [None], "param": [None], "value": [None], "error": [str(problem)]})

    return run


def fit(series: DataFrame, models: list[str], chains: int = 4, warmup: int = 1000, draws: int = 2000) -> DataFrame:
    """Draws of every series, model and chain; failed fits are rows with an error.

    The partitions are counted, since Spark would merge such small ones and fit all in one task.
    """
    parts = min(PARTITIONS, max(1, series.select("gene").distinct().count() * len(models) * chains))
    runs = series.select("gene", "time", "y", F.explode(F.array(*map(F.lit, models))).alias("model")).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return runs.repartition(parts, "gene", "model", "chain").groupBy("gene", "model", "chain").applyInPandas(_fit(warmup, draws), DRAWS)


def fit_pending(series: DataFrame, models: list[str], path: str, chains: int = 4, warmup: int = 1000, draws: int = 2000) -> int:
    """Fit the chains that the store at ``path`` doesn't hold, and publish them; how many that were.

    Only series with a pending chain are fitted, each chain once; a second call after a complete one fits nothing.
    """
    todo = series.select("gene").where("gene IS NOT NULL").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    todo = stable(pending_fits(todo.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))), path))
    count = todo.count()
    if count:
        runs = series.select("gene", "time", "y").join(todo, "gene").repartition(min(PARTITIONS, count), "gene", "model", "chain")
        publish_fits(runs.groupBy("gene", "model", "chain").applyInPandas(_fit(warmup, draws), DRAWS), path)
    return count


def wide_draws(draws: DataFrame, model: str) -> DataFrame:
    """(gene, draw, one column a parameter): the draws of one model, numbered over its chains."""
    params = list(PRIORS[model])
    rows = draws.where((F.col("model") == model) & F.col("error").isNull())
    wide = rows.groupBy("gene", "chain", "draw").agg(*(F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in params))
    return wide.withColumn("draw", F.col("draw") + F.lit(1_000_000) * F.col("chain"))


def summary(draws: DataFrame) -> DataFrame:
    """A row for each series, model and parameter, and one with the error for each chain that failed."""
    return estimates(draws.withColumn("chain", F.when(F.col("error").isNotNull(), F.col("chain"))), ["gene", "model", "param", "chain", "error"])
