"""Fingerprints by winnowing: the least k-gram hash of every window, the rightmost of equals, with its position.

``k`` code points are hashed together (a polynomial hash, built up by doubling), and of every ``window`` consecutive hashes
the least is kept. Two texts that share ``window + k - 1`` code points anywhere therefore share a kept hash, and matches of fewer than
``k`` code points are never found. A text with fewer hashes than a window is one window, one with fewer than ``k`` code points is hashed
as a whole. Long texts are hashed in overlapping pieces, which keep the same hashes.

``compared`` sets each document beside the next one, in descending doc_id (null last, equal ids by the hash of the text). A first job finds
ranges of doc_id that hold about ``BLOCK_CHARS`` of text; then each text is shuffled once, to the block of its range, and the
first one of each block also to the block before, so that blocks are read on their own, in order, without a window over all
rows. Rows that repeat both doc_id and text lie in one block, which streams them.

A null text is empty; an empty text has the fingerprint '' and is 1 alike with other empty ones, 0 with others. A sole document
is next to itself. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_array, map_batches, prepare

GRAM, WINDOW = 16, 32
BLOCK_CHARS = 4_000_000
#: Ranges of doc_id that one job may have; beyond it the ranges are larger, not fewer rows.
MOST_BLOCKS = 20_000
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no order of the polynomial hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive code points; of fewer, one of all."""
    k = min(k, len(points))
    if not k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        done, out = 0, np.zeros(len(points) + 1, np.uint64)
        power, span, scale = points.astype(np.uint64) + np.uint64(1), 1, _BASE
        while True:  # ``power`` has the hashes of ``span`` points, ``out`` those of the points done so far
            if k & span:
                n = len(points) - done - span + 1
                out = out[:n] * scale + power[done : done + n]
                done += span
            if 2 * span > k:
                return _mixed(out)
            power = power[:-span] * scale + power[span:]
            span, scale = 2 * span, scale * scale


def kept_positions(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window, of equals the rightmost."""
    window = min(window, len(hashes))
    if not window:
        return np.empty(0, np.int64)
    at, span = np.arange(len(hashes)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[right] <= hashes[left], right, left)

    while 2 * span <= window:
        at = better(at[:-span], at[span:])
        span *= 2
    rest = window - span
    at = better(at[: len(at) - rest], at[rest:]) if rest else at
    return at[np.append(True, at[1:] != at[:-1])]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def winnow(text: str | None, k: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points from the start, ascending) and hashes of a text's fingerprint."""
    points = code_points(text or "")
    overlap = window + k - 2
    positions, hashes = [], []
    for low in range(0, max(1, len(points) - overlap), piece):
        found = gram_hashes(points[low : low + piece + overlap], k)
        at = kept_positions(found, window)
        if positions and len(at) and positions[-1][-1] == low + at[0]:
            at = at[1:]  # the last window's least hash is that of this piece's first one, too
        if len(at):
            positions.append(at + low)
            hashes.append(found[at])
    none = np.empty(0, np.int64)
    return (np.concatenate(positions), np.concatenate(hashes)) if positions else (none, none.astype(np.uint64))


def as_text(positions: np.ndarray, hashes: np.ndarray) -> str:
    """"hash@position" in order, hashes in hexadecimal."""
    return " ".join([f"{h:016x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes, both as sets; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(documents: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, positions, hashes (signed 64 bits) of every document."""
    prepare(documents.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [winnow(t, k, window) for t in texts]
        lengths = pa.array([len(t or "") for t in texts], pa.int64())
        lists = [list_array([f[0] for f in found], pa.int64()), list_array([f[1].view(np.int64) for f in found], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), lengths, *lists], ["doc_id", "n_chars", "positions", "hashes"])

    return map_batches(documents.select("doc_id", "text"), run, "doc_id long, n_chars long, positions array<long>, hashes array<long>")


def _ranges(documents: DataFrame, block_chars: int) -> list[tuple[int, int]]:
    """(greatest doc_id, least hash of its texts) of each range of doc_id, ascending; nulls are no part of it."""
    ids = documents.select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    held = ids.where("doc_id IS NOT NULL")
    blocks = min(MOST_BLOCKS, max(1, (held.agg(F.sum("n")).first()[0] or 0) // block_chars))
    ranged = held.repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("part"))
    tops = ranged.agg(F.max(F.struct("doc_id", (-1 - F.col("hash")).alias("turned"))).alias("top")).select("top.*")
    return sorted((r["doc_id"], -1 - r["turned"]) for r in tops.collect())  # a row a block, at most MOST_BLOCKS


def _block(doc_id: Column, tops: Column, count: int) -> Column:
    """The place of the first range whose greatest doc_id is not below ``doc_id``, by halving."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, count.bit_length())))))
    below = lambda place: F.get(tops, F.least(place, F.lit(count)) - 1) < doc_id
    return F.aggregate(steps, F.lit(0), lambda place, step: F.when((place + step <= count) & below(place + step), place + step).otherwise(place))


BESIDE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _beside(k: int, window: int):
    """Rows in order, each with the one after it in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            out = []
            for block, visitor, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                positions, hashes = winnow(text, k, window)
                if before is not None and before[0] == block and not before[1]:
                    _, _, own_id, own, own_positions, own_hashes = before
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    new_positions, new_hashes = winnow(edited, k, window)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), digest, as_text(own_positions, own_hashes), as_text(new_positions, new_hashes), likeness(own_hashes, new_hashes), likeness(own_hashes, hashes)))
                before = (block, visitor, doc_id, text, positions, hashes)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in BESIDE.split(", ")])

    return run


def compared(documents: DataFrame, k: int = GRAM, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    A document's edited text has the last half of its code points replaced by as many of the next document's first ones, or all of them.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    tops = _ranges(documents, block_chars)
    nulls = rows.where("doc_id IS NULL").agg(F.min("hash")).first()[0]
    # heads in the order of documents: ranges from the greatest on, then the nulls
    heads = [(len(tops) - 1 - i, top, h) for i, (top, h) in reversed(list(enumerate(tops)))]
    if nulls is not None:
        heads.append((len(tops), None, nulls))
    if not heads:
        return rows.sparkSession.createDataFrame([], BESIDE)
    array = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    # blocks are numbered in the order of documents: the greatest ids are block 0
    block = F.lit(len(tops))
    if tops:
        ascending = _block(F.col("doc_id"), array([t for t, _ in tops]), len(tops))
        block = F.when(F.col("doc_id").isNotNull(), F.lit(len(tops) - 1) - ascending).otherwise(block)
    rows = rows.withColumn("block", block.cast("int"))
    ids, hashes = array([t if t is not None else 0 for _, t, _ in heads]), array([h for _, _, h in heads])
    is_head = (F.get(hashes, F.col("block")) == F.col("hash")) & (F.col("doc_id").isNull() | (F.get(ids, F.col("block")) == F.col("doc_id")))
    here, visit = F.struct(F.col("block"), F.lit(False).alias("visitor")), F.struct(F.pmod(F.col("block") - 1, F.lit(len(heads))).alias("block"), F.lit(True).alias("visitor"))
    placed = rows.select("doc_id", "text", "hash", F.inline(F.when(is_head, F.array(here, visit)).otherwise(F.array(here))))
    order = ["block", "visitor", F.desc_nulls_last("doc_id"), "hash"]
    streamed = placed.repartition("block").sortWithinPartitions(*order).select("block", "visitor", "doc_id", "text")
    return streamed.mapInArrow(_beside(k, window), BESIDE)
