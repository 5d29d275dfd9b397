"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the least node of its local component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    tops = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    keep = tops != np.arange(len(nodes))
    return nodes[tops[keep]], nodes[keep]


def _thin(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, rows: int, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``, at most about ``rows`` of them; component is its least node.

    Links are thinned to forests inside each batch first, so no round handles more rows than
    there are nodes in a batch. Every round is written with checkpoint(); a node with very many links
    is only ever aggregated (partial minimum) and joined to one row.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stored(links.mapInArrow(_thin, "a long, b long").distinct(), rows)
    rows, before = links.count(), None
    for _ in range(max_rounds):
        # large star: what is above u points at the least neighbour of u
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        links = both.join(least, both.a == least.u).where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: what is below u, and u, point at the least of them
        least = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        joined = links.join(least, links.b == least.u)
        links = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        links = stored(links, rows)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    tops = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(tops)
