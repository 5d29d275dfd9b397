"""Exact top-k inner-product search: a ball tree for each shard, searched by branch and bound.

The inner product of a query q with any vector of a node is at most q.c + |q| r (centre c,
radius r). Of two children the one with the higher bound is opened first, and a node is left out when it is strictly below the
query's current k-th score, so that ties go to the least vec_id. Each query first searches one shard; the k-th score found there is
the floor with which it enters all other shards, so most of their nodes are never opened.

Shards are clusters: rows go to the nearest of a few centres, fitted to a bounded sample, and large clusters are dealt out over several
shards. A query goes on to another shard only if the bound of that shard's root, a ball around all its vectors, reaches its floor.
Queries travel in blocks; a task holds one shard and one block, whatever the table's size, and a shard is copied only for blocks
that have a query for it. Null vectors, and vectors with null or non-finite components, take no part. Vectors of
different lengths never meet; an empty vector scores 0 with other empty ones. A repeated vec_id
is a row of its own: each of its queries has its own answer, but no row is a candidate for its own vec_id. Scores are exact
integers; components and scores beyond a long count as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LONG, inner_products, partitions_for, prepare

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 64
#: Centres of shards, the sample that they are fitted to, and rounds of fitting; answers don't depend on them.
CENTRES, SAMPLE, FIT_ROUNDS = 256, 4096, 5
SCALE = 256.0


class BallTree:
    """Nodes in arrays; the vectors are reordered so that each node is a slice of them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left, right
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            at = len(self.nodes)
            self.nodes.append((start, stop, -1, -1))
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, at, right) if side == 0 else (a, b, left, at)
            if stop - start > leaf_rows:
                own = vectors[order[start:stop]]
                axis = own[np.argmax(((own - own[0]) ** 2).sum(1))]
                axis = axis - own[np.argmax(((own - axis) ** 2).sum(1))]
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(own @ axis, middle)]
                todo += [(start, start + middle, at, 0), (start + middle, stop, at, 1)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.centres = np.array([self.vectors[a:b].mean(0) for a, b, _, _ in self.nodes])
        self.radii = np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(1).max()) for (a, b, _, _), c in zip(self.nodes, self.centres, strict=True)])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (score, id) of each query with at least its floor, and which of them there are."""
        best = np.full((len(queries), k), -LONG, dtype=np.int64)
        held = np.zeros((len(queries), k), dtype=bool)
        which = np.full((len(queries), k), np.iinfo(np.int64).max)
        norms = np.sqrt((queries**2).sum(1))
        # what rounding may take from a bound, whatever its sign: equal scores must not be left out
        slack = norms[:, None] * (np.sqrt((self.centres**2).sum(1)) + self.radii) * 1e-9 + 1e-6
        bounds = queries @ self.centres.T + norms[:, None] * self.radii + slack
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            who = who[bounds[who, node] >= np.maximum(best[who, -1], floors[who]).astype(np.float64)]
            if not len(who):
                continue
            start, stop, left, right = self.nodes[node]
            if left >= 0:  # the child with the higher bound is opened first
                first = bounds[who, left] >= bounds[who, right]
                for near, far, part in ((left, right, who[first]), (right, left, who[~first])):
                    if len(part):
                        todo += [(far, part), (near, part)]
                continue
            scores = inner_products(queries[who], self.vectors[start:stop])
            ids = np.broadcast_to(self.ids[start:stop], scores.shape)
            fits = (ids != own[who][:, None]) & (scores >= floors[who][:, None])
            scores, ids, fits = np.concatenate([best[who], scores], 1), np.concatenate([which[who], ids], 1), np.concatenate([held[who], fits], 1)
            top = np.lexsort((ids, ~scores, ~fits), axis=1)[:, :k]
            found = np.take_along_axis(fits, top, 1)
            best[who], which[who], held[who] = np.where(found, np.take_along_axis(scores, top, 1), -LONG), np.take_along_axis(ids, top, 1), found
        return best, which, held


def _search(k: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        if shard.empty or queries.empty:
            return none
        tree = BallTree(_stacked(shard["v"]), shard["vec_id"].to_numpy(np.int64))
        asked = queries["asked"].to_numpy(np.int64)
        best, ids, held = tree.search(_stacked(queries["q"]), asked, k, queries["q_floor"].to_numpy(np.int64))
        row, col = np.nonzero(held)
        return pd.DataFrame({"query": queries["query"].to_numpy(np.int64)[row], "query_id": asked[row], "vec_id": ids[row, col], "score": best[row, col]})

    return run


FOUND = "query long, query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of usable vectors: floor(256 x) of each component."""
    kept = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return kept.where(fine).select("vec_id", v.alias("v"), F.size("embedding").alias("dim"))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (vectors @ centres.T)).argmin(1)


def _fitted(vectors: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """Centres by length of vector: k-means on a bounded sample."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("v").toPandas()["v"]
    out = {}
    for dim in {len(x) for x in sample if len(x)}:
        own = np.array([x for x in sample if len(x) == dim], dtype=np.float64)
        centres = own[: min(wanted, 1 + len(own) // 8)]
        for _ in range(FIT_ROUNDS):
            near = _nearest(own, centres)
            centres = np.array([own[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        out[dim] = centres
    return out


def _shards(vectors: DataFrame, shard_rows: int):
    """A function that gives rows their shard (by a column that tells rows apart), and the number of shards."""
    rows = vectors.count()
    wanted = min(CENTRES, partitions_for(rows, shard_rows))
    if wanted == 1:
        return lambda df, by: df.withColumn("shard", F.lit(0)), 1
    centres = _fitted(vectors, wanted)

    def clustered(df: DataFrame) -> DataFrame:
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, cluster int"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                cluster = np.zeros(len(part), dtype=np.int32)
                dims = part["v"].map(len).to_numpy()
                for dim, own in centres.items():
                    at = np.flatnonzero(dims == dim)
                    if len(at):
                        cluster[at] = _nearest(_stacked(part["v"].iloc[at]), own)
                yield part.assign(cluster=cluster)

        return df.mapInPandas(run, schema)

    sizes = {r["cluster"]: r["count"] for r in clustered(vectors).groupBy("cluster").count().collect()}  # at most CENTRES rows
    first, parts, shards = {}, {}, 0
    for cluster in range(max(len(c) for c in centres.values()) if centres else 1):
        first[cluster], parts[cluster] = shards, partitions_for(sizes.get(cluster, 1), shard_rows)
        shards += parts[cluster]
    table = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))[F.col("cluster")]
    return lambda df, by: clustered(df).withColumn("shard", (table(first) + F.pmod(F.xxhash64(by), table(parts))).cast("int")).drop("cluster"), shards


def _ball(rows: pd.DataFrame) -> pd.DataFrame:
    """The ball around a shard's vectors."""
    vectors = _stacked(rows["v"])
    centre = vectors.mean(0)
    radius = float(np.sqrt(((vectors - centre) ** 2).sum(1).max()))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "dim": rows["dim"].iloc[:1], "centre": [centre.tolist()], "centre_norm": [float(np.sqrt((centre**2).sum()))], "radius": [radius]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors(vec_id, v, dim)`` for each query."""
    prepare(vectors.sparkSession)
    vectors = vectors.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    queries = queries.withColumn("query", F.monotonically_increasing_id()).checkpoint()
    blocks = partitions_for(queries.count(), block_rows)
    place, shards = _shards(vectors, shard_rows)
    vectors = place(vectors, "row").checkpoint()
    asked = place(queries, "query").withColumnRenamed("shard", "home").withColumn("block", F.pmod(F.xxhash64("query", F.lit(2)), F.lit(blocks)).cast("int")).checkpoint()
    keys = ["shard", "block", "dim"]
    stored = vectors.select("shard", "dim", "vec_id", "v")

    def meet(q: DataFrame) -> DataFrame:
        named = q.select(*(F.col(c).alias(f"q_{c}") for c in keys), "query", F.col("vec_id").alias("asked"), F.col("v").alias("q"), F.col("floor").alias("q_floor"))
        wanted = q.select(*keys).distinct().groupBy("shard", "dim").agg(F.collect_list("block").alias("_blocks"))  # no more than there are blocks
        copies = stored.join(wanted, ["shard", "dim"]).select("shard", F.explode("_blocks").alias("block"), "dim", "vec_id", "v")
        return copies.groupBy(*keys).cogroup(named.groupBy(*(f"q_{c}" for c in keys))).applyInPandas(_search(k), FOUND)

    home = meet(asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(-LONG))).checkpoint()
    if shards == 1:
        found = home
    else:
        floors = home.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        others = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("kth", F.lit(-LONG)))
        others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        balls = vectors.groupBy("shard", "dim").applyInPandas(_ball, "shard int, dim int, centre array<double>, centre_norm double, radius double")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
        product = F.aggregate(F.zip_with("v", "centre", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        # the slack is what rounding may take from a bound
        bound = product + F.col("_norm") * F.col("radius") + F.col("_norm") * (F.col("centre_norm") + F.col("radius")) * 1e-9 + 1e-6
        others = others.withColumn("_norm", norm).join(balls, ["shard", "dim"]).where(bound >= F.col("floor").cast("double")).select(*asked.columns, "floor", "shard")
        found = home.union(meet(others))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
