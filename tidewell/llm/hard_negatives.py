"""Hard negatives by inner product: clusters of anchors share one sorted list of candidates, which every anchor walks.

Anchors are put with the nearest of a few directions, in blocks. A task holds one block and one shard of the candidates. For the
block's mean direction c it sorts the candidates once by |x| cos(max(0, angle(x, c) - reach)), where reach is the largest
angle of a member to c: times the member's length this is at least the member's score with any candidate. A member walks
down the list, in steps that grow, and stops where its bound is below what could still enter its answer. Rounding is covered by a
slack, scores themselves are exact integers, so answers are exact.

Two walks: positives are the best rows of the anchor's label; then, for each positive, the best rows of other labels between a
share of its score and that score, whose lower end bounds the walk from the start. Shards' answers meet by anchor, a
few rows each.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths
never meet; an empty vector scores 0 with other empty ones. A repeated vec_id is a row of its own: two anchors of one vec_id
both have answers, and are each other's candidates. Components and scores beyond a long count as the nearest long. Ties go to
the lesser vec_id, between rows that repeat both to either. Columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LONG, inner_products, partitions_for, prepare

SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Directions to put anchors with, fitted to a bounded sample of anchors; answers don't depend on them.
DIRECTIONS, SAMPLE, FIT_ROUNDS, MEMBERS = 64, 4096, 5, 512
POSITIVES, NEGATIVES, LOW_PERCENT = 5, 5, 80
SCALE = 256.0


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (0 of a null vector) and lengths."""
    top = np.abs(v).max(1, initial=0.0)
    scaled = v / np.where(top > 0, top, 1.0)[:, None]
    lengths = np.sqrt((scaled**2).sum(1))
    return scaled / np.where(lengths > 0, lengths, 1.0)[:, None], lengths * top


class SharedList:
    """Candidates in the order of a bound that holds for every member of a cluster."""

    def __init__(self, members: np.ndarray, vectors: np.ndarray):
        units, self.lengths = _directions(members)
        mean = units.sum(0)
        centre = mean / max(np.sqrt(mean @ mean), 1e-300)
        reach = np.arccos(np.clip(units[self.lengths > 0] @ centre, -1, 1)).max(initial=0.0)
        own, size = _directions(vectors)
        away = np.where(size > 0, np.arccos(np.clip(own @ centre, -1, 1)), 0.0)
        # the slack covers the rounding of angles; a bound may be negative only if the whole cluster is far away
        bounds = size * (np.cos(np.maximum(away - reach, 0.0)) + 1e-7)
        self.order = np.argsort(-bounds, kind="stable")
        self.bounds = bounds[self.order]

    def open(self, at: int, low: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Whether each walker (of member ``who``) may still meet a score of ``low`` from place ``at`` on."""
        ahead = self.lengths[who] * self.bounds[at]
        return ahead + np.abs(ahead) * 1e-9 + 1e-6 >= low.astype(np.float64)


def walk(members: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, vectors: np.ndarray, ids: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(walker, id, score) of the k best candidates of each walker with low <= score <= high.

    ``who``: the member that each walker is of. ``fits(walkers, candidates)``: which pairs may meet, as a matrix.
    """
    shared = SharedList(members, vectors)
    none = np.empty(0, np.int64)
    best = (none, none, none)
    floor, last = low.copy(), np.full(len(who), np.iinfo(np.int64).max)
    active, at, step = np.arange(len(who)), 0, 64
    while at < len(ids):
        active = active[shared.open(at, floor[active], who[active])]
        if not len(active):
            break
        some = shared.order[at : at + step]
        asked, place = np.unique(who[active], return_inverse=True)
        scores = inner_products(members[asked], vectors[some])[place]
        f = floor[active][:, None]
        good = (scores > f) | (scores == f) & (ids[some] <= last[active][:, None])
        good &= (scores <= high[active][:, None]) & fits(active, some)
        row, col = np.nonzero(good)
        if len(row):
            best = _top(tuple(np.concatenate(x) for x in zip(best, (active[row], ids[some[col]], scores[row, col]), strict=True)), k)
            ends = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True))
            starts = np.append(0, ends[:-1] + 1)
            full = ends[ends - starts + 1 == k]
            floor[best[0][full]], last[best[0][full]] = best[2][full], best[1][full]
        at, step = at + step, min(2 * step, 1024)
    return best


def _top(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (walker, id, score) of each walker, in order; ties go to the lesser id."""
    walker, vec, score = found
    order = np.lexsort((vec, ~score, walker))
    walker = walker[order]
    first = np.append(True, walker[1:] != walker[:-1])
    rank = np.arange(len(walker)) - np.maximum.accumulate(np.where(first, np.arange(len(walker)), 0))
    kept = order[rank < k]
    return found[0][kept], found[1][kept], found[2][kept]


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def _positives(k: int):
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"anchor": [], "vec_id": [], "score": []}).astype("int64")
        if shard.empty or block.empty:
            return out
        own, label = shard["row"].to_numpy(), shard["label"].to_numpy()
        anchors, labels = block["a_row"].to_numpy(), block["a_label"].to_numpy()
        fits = lambda w, c: (label[c] == labels[w][:, None]) & (own[c] != anchors[w][:, None])
        lowest, highest = (np.full(len(block), x, dtype=np.int64) for x in (-LONG, LONG - 1))
        who, ids, scores = walk(_stack(block["a_v"]), np.arange(len(block)), lowest, highest, k, _stack(shard["v"]), shard["vec_id"].to_numpy(np.int64), fits)
        return pd.DataFrame({"anchor": anchors[who], "vec_id": ids, "score": scores})

    return run


def _negatives(k: int, percent: int):
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"anchor": [], "place": [], "vec_id": [], "score": []}).astype({"anchor": "int64", "place": "int32", "vec_id": "int64", "score": "int64"})
        if shard.empty or block.empty:
            return out
        label, labels, anchors = shard["label"].to_numpy(), block["a_label"].to_numpy(), block["a_row"].to_numpy()
        scores = block["scores"].tolist()
        who = np.repeat(np.arange(len(block)), [len(x) for x in scores])
        place = np.concatenate([np.arange(len(x)) for x in scores])
        high = np.concatenate([np.asarray(x, dtype=np.int64) for x in scores])
        low = np.array([-((-percent * int(x)) // 100) for x in high], dtype=np.int64)
        fits = lambda w, c: label[c] != labels[who[w]][:, None]
        walker, ids, found = walk(_stack(block["a_v"]), who, low, high, k, _stack(shard["v"]), shard["vec_id"].to_numpy(np.int64), fits)
        return pd.DataFrame({"anchor": anchors[who[walker]], "place": place[walker].astype(np.int32), "vec_id": ids, "score": found})

    return run


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of usable rows: floor(256 x) of each component; every seventh vec_id has its label moved by one of ten."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return kept.select("vec_id", label.cast("long").alias("label"), v.alias("v"))


def _fitted(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Directions by length of vector, spherical k-means on a bounded sample of anchors, one for about ``MEMBERS`` of all.

    Every cluster costs a copy of the candidates, so few anchors get few of them.
    """
    wanted = min(DIRECTIONS, 1 + anchors.count() // MEMBERS)
    sample = anchors.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("v").toPandas()["v"]
    out = {}
    for dim in {len(x) for x in sample if len(x)}:
        units, _ = _directions(np.array([x for x in sample if len(x) == dim], dtype=np.float64))
        centres = units[:wanted]
        for _ in range(FIT_ROUNDS):
            near = (units @ centres.T).argmax(1)
            sums = np.array([units[near == c].sum(0) for c in range(len(centres))])
            centres = np.where((near[:, None] == np.arange(len(centres))).any(0)[:, None], _directions(sums)[0], centres)
        out[dim] = centres
    return out


def _clustered(anchors: DataFrame) -> DataFrame:
    """``anchors`` with a cluster: the direction that is nearest."""
    centres = _fitted(anchors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            clusters = [int((centres[len(v)] @ np.asarray(v)).argmax()) if len(v) in centres else 0 for v in rows["v"]]
            yield rows.assign(cluster=np.array(clusters, dtype=np.int32))

    return anchors.mapInPandas(run, "vec_id long, label long, v array<double>, row long, cluster int")


def mine(
    vectors: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: (vec_id, label, v). ``anchors``: the condition on vec_id that picks the anchors. Of each anchor the best
    ``positives`` rows of its label, and for each of them the best ``negatives`` rows of other labels that score from
    ``low_percent`` per cent of the positive's score up to that score.
    """
    prepare(vectors.sparkSession)
    rows = vectors.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    shards = partitions_for(rows.count(), shard_rows)
    asked = _clustered(rows.where(anchors).select("vec_id", "label", "v", "row")).checkpoint()
    sizes = {r["cluster"]: r["count"] for r in asked.groupBy("cluster").count().collect()}  # at most DIRECTIONS rows
    first, blocks = {}, 0
    for cluster in sorted(sizes):
        first[cluster], blocks = blocks, blocks + partitions_for(sizes[cluster], block_rows)
    if not blocks:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    start = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    parts = F.create_map(*(F.lit(x) for c in first for x in (c, partitions_for(sizes[c], block_rows))))
    block = start[F.col("cluster")] + F.pmod(F.xxhash64("row"), parts[F.col("cluster")]).cast("int")
    asked = asked.select(block.alias("block"), F.size("v").alias("dim"), F.col("row").alias("a_row"), F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"))
    everywhere = lambda df, column, n: df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    stored = everywhere(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "block", blocks)
    stored = stored.select("shard", "block", F.size("v").alias("dim"), "vec_id", "label", "v", "row").groupBy("shard", "block", "dim")

    def meet(members: DataFrame, fn, schema: str) -> DataFrame:
        members = everywhere(members, "shard", shards).groupBy("shard", "block", "dim")
        return stored.cogroup(members).applyInPandas(fn, schema)

    def first_of(found: DataFrame, keys: list[str], n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= n)

    near = first_of(meet(asked, _positives(positives), "anchor long, vec_id long, score long"), ["anchor"], positives)
    chosen = near.groupBy(F.col("anchor").alias("a_row")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("chosen"))
    chosen = asked.join(chosen, "a_row").withColumn("scores", F.col("chosen.score")).checkpoint()
    found = meet(chosen.select("block", "dim", "a_row", "a_label", "a_v", "scores"), _negatives(negatives, low_percent), "anchor long, place int, vec_id long, score long")
    found = first_of(found, ["anchor", "place"], negatives)
    of = F.col("chosen")[F.col("place")]
    both = found.join(chosen.select(F.col("a_row").alias("anchor"), "a_id", "chosen"), "anchor")
    return both.select(
        F.col("a_id").alias("anchor_id"), of["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        of["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE alike) WHERE place <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
