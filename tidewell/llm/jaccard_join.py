"""Exact Jaccard join of shingle sets in the metric 1 - J: pivot regions, triangle-inequality windows, recursion.

Unrelated texts all lie at distance 1 from one another, so whole documents can't serve as the first
pivots: every window would hold everything. The space is therefore divided in two ways.

Neighbourhoods. Two sets within the threshold share some of the first shingles of each in any common
order (prefixes), and the more the longer the prefixes are. The sets that hold such a shingle are a neighbourhood; windows by
size (distance to the empty set) and by the counts of shingles in ``SLICES`` slices of the hash range (distances to
the slices), and the number of neighbourhoods in which a pair meets leave out pairs. The order puts shingles that many documents hold last, the more the later; how many
do is estimated over all documents in a sketch of fixed size. Any order gives the same links. Wide
neighbourhoods don't list their pairs, they only tie their sets together.

Regions. What is tied together lies close, and there the metric works. A group is a region; one that is too large for a task
gets pivots from its own members. Each set goes to its nearest pivot (its Voronoi region); a set is
replicated to a region before its own if d(set, pivot) <= d(set, own pivot) + 2r and <= radius of the
region + r. Sets farther than 1 - 2r from every pivot are a region of their own, joined again
with other pivots, so regions are divided recursively. A region that no longer shrinks is
joined in pairs of blocks, so there is an exact way for every input. Inside a region pivots work once more: a set whose
window around its pivot holds only sets already in one component needs no comparison. Regions
report spanning forests of their links.

Equal sets are one node throughout. Null and empty texts have empty sets and are linked with
nothing, though equal to each other. Rows that repeat a doc_id form one row's worth of links.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import STORED_ROWS, map_batches, partitions_for, prepare, sealed, stored, text_bytes
from .components import components, forest

REGION, WIDEST, DENSE = 128, 1024, 16
#: A region is joined in one task up to so many sets and shingles; a task holds about ``TASK_SHINGLES``.
CELL_SETS, CELL_SHINGLES, TASK_SHINGLES = 8192, 1 << 20, 1 << 18
#: Shingles that are compared with a pivot at once.
AT_ONCE = 1 << 18
#: Pivots of a region that is divided, rounds of dividing, and how many neighbours make a pivot's wider ball worth its cost.
PIVOTS, ROUNDS, MANY = 16, 8, 8
#: A prefix is longer by one shingle for so many of its set, and linked sets have as many more in common.
PREFIX_STEP = 50
SLICES = 64
SKETCH_BITS, SKETCH_CHUNK, BIT_SKETCH = 22, 1 << 14, 23


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence where it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(hashing.windows(hashing.word_hashes(words), min(k, len(words))))


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 63-bit name of each set."""
    sums = [np.add.reduce(hashing.mix(s ^ np.uint64(0x5BD1E995))) + np.uint64(len(s)) for s in sets]
    return (hashing.mix(np.array(sums, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)


def needed_overlap(a, b, num: int, den: int):
    """Least overlap of sets of these sizes with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def slice_counts(s: np.ndarray) -> bytes:
    """How many shingles fall in each slice of the hash range, 255 at most."""
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=SLICES), 255).astype(np.uint8).tobytes()


NAMED = "doc_id long, uid long, node long, n_shingles long, slices binary"


def _scan(k: int):
    """The set name, size and slices of each row; at the end of a task, chunks of its sketch of shingle counts."""

    def run(batches):
        held = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t, k) for t in text_bytes(batch.column(2))]
            np.add.at(held, _bucket(np.concatenate(sets), SKETCH_BITS), 1)
            sizes, none = pa.array([len(s) for s in sets], pa.int64()), len(sets)
            slices = pa.array([slice_counts(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(set_keys(sets)), sizes, slices, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
                ["doc_id", "uid", "node", "n_shingles", "slices", "chunk", "counts"],
            )
        held = np.minimum(held, 255).astype(np.uint8)
        parts = [(at // SKETCH_CHUNK, held[at : at + SKETCH_CHUNK]) for at in range(0, len(held), SKETCH_CHUNK)]
        parts = [(n, zlib.compress(p.tobytes(), 1)) for n, p in parts if p.any()]
        if parts:
            none = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array([n for n, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
                ["doc_id", "uid", "node", "n_shingles", "slices", "chunk", "counts"],
            )

    return run


def _add_chunks(least: float):
    """Sums of equal chunks that follow each other, as levels: 0 up to ``least``, then one more for each half power of two."""

    def levels(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        level = np.where(total > least, np.minimum(1 + np.floor(2 * np.log2(np.maximum(total, 1) / least)), 255), 0)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(level.astype(np.uint8).tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def run(batches):
        chunk, total = None, np.zeros(SKETCH_CHUNK, dtype=np.int64)
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != chunk:
                    if chunk is not None:
                        yield levels(chunk, total)
                    chunk, total = at, np.zeros(SKETCH_CHUNK, dtype=np.int64)
                total += np.frombuffer(zlib.decompress(part), dtype=np.uint8)
        if chunk is not None:
            yield levels(chunk, total)

    return run


def frequency_levels(scanned: DataFrame) -> np.ndarray:
    """How common the shingles of each sketch bucket are: 0 unless far above the mean (6 deviations).

    The sketch has a fixed size, whatever the number of documents: only the levels, one byte a bucket, reach the driver.
    """
    mean = (scanned.agg(F.sum("n_shingles")).first()[0] or 0) / (1 << SKETCH_BITS)
    parts = scanned.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in parts.mapInArrow(_add_chunks(mean + 6 * math.sqrt(mean + 1) + 8), "chunk int, counts binary").collect():
        out[row["chunk"] * SKETCH_CHUNK : (row["chunk"] + 1) * SKETCH_CHUNK] = np.frombuffer(zlib.decompress(bytes(row["counts"])), dtype=np.uint8)
    return out


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _bits(batches):
    """Which buckets of a bit sketch the keys of a task fall in, in chunks."""
    held = np.zeros(1 << BIT_SKETCH, dtype=bool)
    for batch in batches:
        held[_bucket(batch.column(0).to_numpy().view(np.uint64), BIT_SKETCH)] = True
    for at in range(0, len(held), SKETCH_CHUNK * 8):
        if (part := held[at : at + SKETCH_CHUNK * 8]).any():
            yield pa.RecordBatch.from_arrays([pa.array([at // (SKETCH_CHUNK * 8)], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["chunk", "bits"])


def maybe_among(rows: DataFrame, chosen: DataFrame, key) -> DataFrame:
    """``rows`` without most of those whose ``key``, a 64-bit hash, is not among that of ``chosen``.

    A bit sketch of fixed size is broadcast; a row that it lets through in error falls in the join that follows.
    """

    def unite(batches):
        chunk, total = None, None
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(part, dtype=np.uint8)
                if at == chunk:
                    total = total | new
                    continue
                if chunk is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "bits"])
                chunk, total = at, new
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "bits"])

    parts = chosen.select(key).mapInArrow(_bits, "chunk int, bits binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(unite, "chunk int, bits binary")
    packed = np.zeros((1 << BIT_SKETCH) // 8, dtype=np.uint8)
    for row in parts.collect():
        packed[row["chunk"] * SKETCH_CHUNK : (row["chunk"] + 1) * SKETCH_CHUNK] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    there = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for batch in batches:
            at = _bucket(batch.column(0).to_numpy().view(np.uint64), BIT_SKETCH)
            yield batch.select(batch.schema.names[1:]).filter(pa.array((there.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))

    return rows.select(key.alias("sketch_key"), *rows.columns).mapInArrow(run, rows.schema)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the common order: by level, then by hash."""
    return s[np.argsort(levels[_bucket(s, SKETCH_BITS)], kind="stable")]


def common_prefix(n: int, num: int, den: int) -> int:
    """How much longer a set's prefix is. Linked sets have as many shingles in common in their prefixes, by the smaller of the two figures."""
    return min(1 + n // PREFIX_STEP, -(-num * n // den))


def _posts(k: int, num: int, den: int, levels):
    """The first shingles of each set; a set that a task has sent already is not sent again."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            sets = [shingles(t, k) for t in text_bytes(batch.column(0))]
            for s, node in zip(sets, set_keys(sets).tolist(), strict=True):
                n = len(s)
                if not n or node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                probe = min(n, n - (-(-num * n // den)) + common_prefix(n, num, den))
                tokens.append(ordered(s, levels.value)[:probe].view(np.int64))
                nodes.append(np.full(probe, node))
                sizes.append(np.full(probe, n, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, sizes)], ["token", "node", "n"])

    return run


def _run_pairs(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (smaller, larger) of the pairs of one neighbourhood inside the size window; rows sorted by size."""
    last = np.searchsorted(n, den * n // num, side="right")  # larger sets beyond are out of the window
    counts = np.maximum(last - np.arange(1, len(n) + 1), 0)
    i = np.repeat(np.arange(len(n)), counts)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def _regions(num: int, den: int):
    """Runs of equal shingles in sorted posts: the pairs in a region's windows, or a forest of them if it is dense.

    A region with more than ``WIDEST`` sets is not held: its sets are tied to its first one.
    """

    def emit(nodes, n):
        order = np.lexsort((nodes, n))
        nodes, n = nodes[order], n[order].astype(np.int64)
        i, j = _run_pairs(n, num, den)
        a, b, dense = nodes[i], nodes[j], len(nodes) > REGION and len(i) > DENSE * len(nodes)
        if dense:
            a, b = forest(a, b)
        return a, b, np.full(len(a), dense)

    def two(i, nodes, n):
        """All regions of two sets at once."""
        fits = (nodes[i] != nodes[i + 1]) & (den * np.minimum(n[i], n[i + 1]) >= num * np.maximum(n[i], n[i + 1]))
        return nodes[i[fits]], nodes[i[fits] + 1], np.full(fits.sum(), False)

    def run(batches):
        held = None  # the open run: token, nodes, sizes; pivot once it is too wide
        pivot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, node, n = (batch.column(c).to_numpy() for c in range(3))
            out = []
            cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            ends = np.append(cuts[1:], len(token))
            keep = ends - cuts > 2
            keep[0] = keep[-1] = True
            twos = cuts[(ends - cuts == 2) & ~keep]
            if len(twos):
                out.append(two(twos, node, n.astype(np.int64)))
            for a, b in zip(cuts[keep].tolist(), ends[keep].tolist(), strict=True):
                if held is not None and held[0] == token[a]:
                    rows = [np.concatenate([x, y[a:b]]) for x, y in zip(held[1:], (node, n), strict=True)]
                else:
                    if held is not None and pivot is None and len(held[1]) > 1:
                        out.append(emit(*held[1:]))
                    rows, pivot = [node[a:b], n[a:b]], None
                _, first = np.unique(rows[0], return_index=True)
                rows = [x[first] for x in rows]
                if len(rows[0]) > WIDEST or pivot is not None:
                    pivot = int(rows[0][0]) if pivot is None else pivot
                    own = rows[0][rows[0] != pivot]
                    out.append((np.full(len(own), pivot), own, np.full(len(own), True)))
                    rows = [x[:0] for x in rows]
                held = (token[a], *rows)
            if out:
                yield _pairs_batch(out)
        if held is not None and pivot is None and len(held[1]) > 1:
            yield _pairs_batch([emit(*held[1:])])

    return run


def _pairs_batch(parts) -> pa.RecordBatch:
    """Distinct pairs of a batch: in how many neighbourhoods they meet, and whether a dense one ties them."""
    a, b, large = (np.concatenate(x) for x in zip(*parts, strict=True))
    frame = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "met": 1, "large": large})
    frame = frame.groupby(["a", "b"], as_index=False).agg({"met": "sum", "large": "max"})
    return pa.RecordBatch.from_pandas(frame.astype({"met": "int64", "large": bool}), preserve_index=False)


def _windows(num: int, den: int):
    """Pairs whose slice counts allow the overlap: they differ in at least the sum of the slices' differences."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SLICES).astype(np.int64) for i in (4, 5)]
        sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        most = sizes - 2 * -(-num * sizes // (num + den))
        return batch.select(["a", "b"]).filter(pa.array(np.abs(counts[0] - counts[1]).sum(1) <= most))

    return run

class Region:
    """Sets joined in one task: an index of their first shingles, rarest first, and overlaps with a pivot."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        _, ids, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ids, held = ids.astype(np.int32), held.astype(np.int32)
        rows = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        self.ids = ids[np.lexsort((ids, held[ids], rows))]
        self.marked = np.zeros(len(held), dtype=bool)
        # the index goes as far as the wider of both balls needs
        at = (np.arange(len(ids)) - np.repeat(self.starts[:-1], self.n)).astype(np.int32)
        first = at < np.repeat(self.prefix(2), self.n)
        token, order = self.ids[first], np.argsort(self.ids[first], kind="stable")
        self.holders, self.places = rows[first][order], at[first][order]
        self.begin = np.searchsorted(token[order], np.arange(len(held) + 1))

    def bound(self, reach: int) -> tuple[int, int]:
        """The similarity of sets ``reach`` times the threshold's distance apart, as a fraction (0 at least)."""
        return max(self.den - reach * (self.den - self.num), 0), self.den

    def prefix(self, reach: int) -> np.ndarray:
        num, den = self.bound(reach)
        return np.minimum(self.n - (-(-num * self.n // den)) + 1, self.n)

    def near(self, p: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """All sets other than p within ``reach`` times the threshold's distance, and their overlaps with p."""
        num, den = self.bound(reach)
        own = self.ids[self.starts[p] : self.starts[p] + min(self.n[p], self.n[p] - (-(-num * self.n[p] // den)) + 1)]
        low, size = self.begin[own], self.begin[own + 1] - self.begin[own]
        which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        rows = self.holders[which]
        rows = rows[self.places[which] < (self.n[rows] - (-(-num * self.n[rows] // den)) + 1)]
        rows = np.unique(rows)
        rows = rows[(rows != p) & (den * np.minimum(self.n[rows], self.n[p]) >= num * np.maximum(self.n[rows], self.n[p]))]
        both = self.overlaps(p, rows)
        close = den * both >= num * (self.n[rows] + self.n[p] - both)
        return rows[close], both[close]

    def overlaps(self, p: int, rows: np.ndarray) -> np.ndarray:
        """How many shingles each of ``rows`` shares with p."""
        if not len(rows):
            return np.empty(0, dtype=np.int64)
        own = self.ids[self.starts[p] : self.starts[p + 1]]
        self.marked[own] = True
        out = np.empty(len(rows), dtype=np.int64)
        ends, low = np.cumsum(self.n[rows]), 0
        while low < len(rows):
            done = ends[low] - self.n[rows[low]]
            high = max(low + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
            some, size = rows[low:high], self.n[rows[low:high]]
            begin = ends[low:high] - size - done
            flat = self.marked[self.ids[np.repeat(self.starts[some] - begin, size) + np.arange(ends[high - 1] - done)]]
            out[low:high] = np.add.reduceat(flat, begin, dtype=np.int64)
            low = high
        self.marked[own] = False
        return out

    def linked(self, p: int, rows: np.ndarray, both: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (self.n[rows] + self.n[p] - both)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links.

        Every set is a pivot p in turn. Where p has many neighbours, all sets within twice the
        radius are fetched, and any neighbour x is settled at once: its links lie among the sets y with
        |d(y, p) - d(x, p)| <= r, of which only those not yet in p's component are compared.
        """
        root = list(range(len(self.n)))
        radius = 1 - self.num / self.den + 1e-9

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def unite(x: int, others: np.ndarray) -> None:
            for y in others.tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)

        settled = np.zeros(len(self.n), dtype=bool)
        for p in range(len(self.n)):
            if settled[p]:
                continue
            settled[p] = True
            ball, _ = self.near(p, 1)
            unite(p, ball)
            if len(ball) < MANY or not self.bound(2)[0] or settled[ball].all():
                continue
            wide, both = self.near(p, 2)
            distance = 1 - both / (self.n[wide] + self.n[p] - both)
            inside = np.isin(wide, ball)
            for x in np.flatnonzero(inside & ~settled[wide]).tolist():
                top = find(p)
                outside = np.flatnonzero(~inside & (np.abs(distance - distance[x]) <= radius))
                some = wide[outside]
                some = some[[find(y) != top for y in some.tolist()]]
                if len(some):
                    unite(int(wide[x]), some[self.linked(wide[x], some, self.overlaps(wide[x], some))])
                settled[wide[x]] = True
        tops = np.array([find(x) for x in range(len(self.n))], dtype=np.int64)
        own = np.flatnonzero(tops != np.arange(len(self.n)))
        return tops[own], own


def _unpack(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column]


def _region_links(num: int, den: int):
    """Links inside the regions that a task holds."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        nodes = rows["node"].to_numpy(np.int64)
        a, b = Region(_unpack(rows["tokens"]), num, den).links()
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return run


def _distances(num: int, den: int):
    """Distance of each set to each pivot of its region, and the region that it goes to: the nearest, or -1 if all are far."""
    far = 1 - 2 * (1 - num / den)

    def run(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("pivot", ignore_index=True)
        centres, sets = _unpack(pivots["pivot_tokens"]), _unpack(members["tokens"])
        out = np.ones((len(sets), len(centres)))
        for i, s in enumerate(sets):
            for j, c in enumerate(centres):
                both = np.intersect1d(s, c, assume_unique=True).size
                out[i, j] = 1 - both / (len(s) + len(c) - both)
        home = np.where(out.min(1) > far, -1, out.argmin(1)) if len(centres) and len(sets) else np.full(len(sets), -1)
        members = members.reset_index(drop=True)
        return pd.DataFrame({"cell": members["cell"], "node": members["node"], "home": home, "distances": pd.Series(list(out), dtype=object)})

    return run


def _divided(cells: DataFrame, sizes: DataFrame, sets: DataFrame, round_no: int, num: int, den: int) -> DataFrame:
    """(cell, node, held): the members of the regions into which ``cells(cell, node)`` divide, held being the size before.

    Pivots are members with small hashes, about ``PIVOTS`` a region. Sets meet them in salted parts of a region.
    """
    radius = 1 - num / den + 1e-9
    members = cells.join(sizes, "cell").join(sets, "node")
    lot = F.pmod(F.xxhash64("node", F.lit(round_no)), F.lit(1 << 30)) * F.col("held") < F.lit(PIVOTS * (1 << 30))
    pivots = members.where(lot).select("cell", "held", F.col("node").alias("pivot"), F.col("tokens").alias("pivot_tokens"))
    salts = F.ceil(F.greatest(F.col("held") / (CELL_SETS // 8 or 1), F.col("words") / (CELL_SHINGLES // 8 or 1))).cast("int")
    parts = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(-1)), salts).cast("int"))
    spread = pivots.join(sizes.select("cell", "words"), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    spread = spread.select(F.col("cell").alias("pivot_cell"), F.col("salt").alias("pivot_salt"), "pivot", "pivot_tokens")
    keyed = parts.select("cell", "salt", "node", "tokens").groupBy("cell", "salt").cogroup(spread.groupBy("pivot_cell", "pivot_salt"))
    found = keyed.applyInPandas(_distances(num, den), "cell long, node long, home int, distances array<double>").checkpoint()
    reach = found.where("home >= 0").groupBy("cell", "home").agg(F.max(F.get("distances", F.col("home"))).alias("radius"))
    reach = reach.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("home", "radius"))).alias("radii"))
    placed = found.join(reach, "cell", "left").join(sizes.select("cell", "held"), "cell")
    own = F.when(F.col("home") >= 0, F.get("distances", F.col("home"))).otherwise(F.lit(1.0))
    last = F.when(F.col("home") >= 0, F.col("home")).otherwise(F.size("distances"))

    def window(i):
        d = F.get("distances", i)
        return (i < last) & (d <= own + F.lit(2 * radius)) & (d <= F.coalesce(F.element_at("radii", i), F.lit(-1.0)) + F.lit(radius))

    places = F.when(F.size("distances") > 0, F.filter(F.sequence(F.lit(0), F.size("distances") - 1), window)).otherwise(F.array().cast("array<int>"))
    spots = placed.select("cell", "node", "held", F.explode(F.array_union(F.array("home"), places)).alias("spot"))
    return spots.select(F.xxhash64("cell", "spot", F.lit(round_no)).alias("cell"), "node", "held")


def _joined(cells: DataFrame, sets: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    return cells.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks))).join(sets, "node").groupBy("task").applyInPandas(_region_links(num, den), "a long, b long").coalesce(tasks)


def region_links(cells: DataFrame, sets: DataFrame, rows: int, num: int, den: int) -> DataFrame:
    """Links (a, b) inside the groups ``cells(cell, node)`` of ``sets(node, n, tokens)``, as spanning forests; ``rows`` sets in all."""
    cells = cells.withColumn("held", F.lit(None).cast("long"))
    out = None
    for round_no in range(ROUNDS + 1):
        counted = cells.join(sets.select("node", "n"), "node").groupBy("cell").agg(F.count("*").alias("now"), F.sum("n").alias("words"), F.max("held").alias("before")).where("now > 1")
        counted = stored(counted, rows)
        fits = (F.col("now") <= CELL_SETS) & (F.col("words") <= CELL_SHINGLES)
        stuck = F.lit(round_no == ROUNDS) | (F.col("now") > 0.9 * F.coalesce("before", F.lit(1 << 60)))
        total, large, over = counted.agg(F.sum(F.when(fits, F.col("words"))), F.count(F.when(~fits, 1)), F.count(F.when(~fits & stuck, 1))).first()
        parts = []
        if total:
            parts.append(_joined(cells.join(counted.where(fits).select("cell"), "cell").select("cell", "node"), sets, partitions_for(total, TASK_SHINGLES), num, den))
        if over:
            parts.append(_in_blocks(cells, counted.where(~fits & stuck), sets, num, den))
        for links in parts:
            links = links.checkpoint()
            out = links if out is None else out.union(links)
        if large == over:
            break
        left = counted.where(~fits & ~stuck).select("cell", F.col("now").alias("held"), "words")
        cells = _divided(cells.select("cell", "node"), left, sets, round_no, num, den).checkpoint()
        rows = cells.count()
    return out if out is not None else cells.sparkSession.createDataFrame([], "a long, b long")


def _in_blocks(cells: DataFrame, counted: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The join of regions that no longer shrink: every pair of blocks of half a region's size is one."""
    blocks = F.ceil(2 * F.greatest(F.col("now") / CELL_SETS, F.col("words") / CELL_SHINGLES)).cast("int")
    member = cells.select("cell", "node").join(counted.select("cell", blocks.alias("blocks")), "cell")
    member = member.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = member.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node")
    total = counted.agg(F.sum(F.col("words") * blocks)).first()[0]
    return _joined(pairs, sets, partitions_for(total, TASK_SHINGLES), num, den)


def _token_sets(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "tokens"])

    return run


def jaccard_components(documents: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents(doc_id, text)``.

    Two documents link when den * overlap >= num * union of their k-word shingle sets;
    component_id is the least doc_id that links reach, itself included.
    """
    return _grouped(documents, k, num, den).select("doc_id", "n_shingles", "component_id")


def _ties(documents: DataFrame, scanned: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, component) of the sets that neighbourhoods tie together."""
    levels = documents.sparkSession.sparkContext.broadcast(frequency_levels(scanned))
    posts = documents.select("text").mapInArrow(_posts(k, num, den, levels), "token long, node long, n int")
    found = posts.repartition("token").sortWithinPartitions("token").mapInArrow(_regions(num, den), "a long, b long, met long, large boolean")
    found = found.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("large").alias("large")).checkpoint()
    pairs = found.where("not large").select("a", "b", "met")
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("slices").alias(f"s_{side}")), side)
    pairs = pairs.where(F.col("met") >= F.least(*(x for c in ("n_a", "n_b") for x in (F.floor(F.col(c) / PREFIX_STEP) + 1, -F.floor(-num * F.col(c) / den)))))
    pairs = map_batches(pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b"), _windows(num, den), "a long, b long")
    return components(pairs.union(found.where("large").select("a", "b")), found.count())


def _grouped(documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, uid (hash of the text), n_shingles, component_id and component_uid: the least (doc_id, uid) that links reach."""
    prepare(documents.sparkSession)
    documents = documents.select("doc_id", F.xxhash64("text").alias("uid"), "text")
    scanned = documents.mapInArrow(_scan(k), f"{NAMED}, chunk int, counts binary").checkpoint()
    named = scanned.where("chunk IS NULL").drop("chunk", "counts")
    # a node's least document, whose text stands for it
    nodes = named.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "uid", "n_shingles", "slices")).alias("least"))
    nodes = nodes.select("node", F.col("least.doc_id").alias("least"), F.col("least.uid").alias("uid"), F.col("least.n_shingles").alias("n"), F.col("least.slices").alias("slices"))
    nodes = stored(nodes, named.count())
    placed = _ties(documents, scanned, nodes, k, num, den).join(nodes, "node").select("node", F.col("component").alias("cell"), F.col("least").alias("doc"), F.col("uid").alias("of"))
    placed = stored(placed, nodes.count())
    tied = placed.count()
    # the set of each node's least document, made once more from its text and stored once
    wanted = maybe_among(documents, placed.select(F.col("doc").alias("doc_id"), F.col("of").alias("uid")), F.xxhash64("doc_id", "uid"))
    texts = wanted.join(placed, (wanted.doc_id == F.col("doc")) & (wanted.uid == F.col("of"))).dropDuplicates(["doc_id", "uid"]).select("node", "text")
    sets = map_batches(texts, _token_sets(k), "node long, n long, tokens binary").coalesce(partitions_for(tied, STORED_ROWS // 20)).checkpoint()
    groups = components(region_links(placed.select("cell", "node"), sets, tied, num, den), tied)
    merged = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = merged.groupBy("component").agg(F.min(F.struct("least", "uid")).alias("top"))
    by_node = merged.join(tops, "component").select(F.col("node").alias("of_node"), F.col("top.least").alias("top"), F.col("top.uid").alias("top_uid"))
    by_node = stored(by_node, nodes.count())
    out = named.join(by_node, named.node == by_node.of_node, "left")
    own = lambda top: F.when(F.col("n_shingles") > 0, F.col(top))
    return out.select("doc_id", "uid", "n_shingles", F.coalesce(own("top"), "doc_id").alias("component_id"), F.coalesce(own("top_uid"), "uid").alias("component_uid"))


def keep_first(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each group of linked documents, the one with the least doc_id (of these, the least hash of the text).

    Rows without doc_id stay. A doc_id on several unlinked texts keeps each of them; only rows that repeat both are one.
    """
    found = _grouped(documents, k, num, den).where("doc_id = component_id AND uid = component_uid")
    first = found.select(F.col("doc_id").alias("first_doc"), F.col("uid").alias("first_uid")).distinct()
    own, restore = sealed(documents, "doc_id", "text")
    own = own.withColumn("uid", F.xxhash64("text"))
    kept = own.join(first, (own["doc_id"] == F.col("first_doc")) & (own["uid"] == F.col("first_uid")), "left_semi").dropDuplicates(["doc_id", "uid"])
    return restore(kept.union(own.where("doc_id IS NULL")))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM sets GROUP BY 1),
named AS (SELECT *, min(doc_id) OVER (PARTITION BY name) AS head FROM sizes),
heads AS (SELECT doc_id, n, g FROM sets JOIN named USING (doc_id) WHERE doc_id = head),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS c FROM heads a JOIN heads b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n_a + n_b - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, x) AS (SELECT DISTINCT a, a FROM edges UNION SELECT d, b FROM reach JOIN edges ON a = x),
tops AS (SELECT d, min(x) AS top FROM reach GROUP BY 1)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, coalesce(top, head, docs.doc_id) AS component_id FROM docs LEFT JOIN named USING (doc_id) LEFT JOIN tops ON d = head
"""
