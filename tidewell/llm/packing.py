"""Best-fit packing of tokenised documents, with each partition's bin count certified.

Documents become pieces of at most ``size`` tokens (only longer ones are cut). Pieces are spread
over partitions and packed there by best-fit decreasing. A dual-feasible-function bound says how
few bins the partition could need. Where the bound is met, the packing is final but for the loosest bin, which
may fit with those of other partitions; partitions with a gap keep their full bins only. The pieces of all other bins are
passed on, to be dealt out anew and packed again, until no gap is left or an exchange settles hardly anything more.

Only (doc_id, piece, length) rows are shuffled, never texts. A null or empty text is a single
end token. Repeated doc_ids are told apart by a row number of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, partitions_for, prepare
from .tokens import cache_for, default_path

SIZE, END_ID = 2048, 0
PARTITION_PIECES, ROUNDS = 20_000, 8
#: An exchange that leaves more than this part of its pieces open is the last but one.
HARDLY = 0.9
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, size: int = SIZE, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = path or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, packed in zip(batch.column(0).to_pylist(), cache_for(path).packed(batch.column(1).to_pylist()), strict=True):
            ids = packed + end
            total = len(ids) // 4
            out += [(doc, n, at, min(size, total - at), zlib.crc32(ids[4 * at : 4 * (at + size)])) for n, at in enumerate(range(0, total, size))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(documents.select("doc_id", "text"), cut, PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best bound of the dual feasible functions u_t: above size-t whole, below t nothing, else in proportion.

    With t = 0 this is the total divided by the size; with other t it counts pieces that exclude each other.
    """
    counts = np.bincount(lengths, minlength=size + 1)
    weights = counts * np.arange(size + 1)
    many, much = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(weights)])
    t = np.arange(0, size // 2 + 1)
    whole = many[size + 1] - many[size - t + 1]
    rest = much[size - t + 1] - much[t]
    return int((whole + -(-rest // size)).max()) if len(lengths) else 0


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the free room of each bin, by best-fit decreasing.

    A bit set of the free rooms in use finds the tightest open bin in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = size, len(free)
            free.append(size)
        bins[i], offsets[i] = at, size - room
        free[at] = left = room - n
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.array(free, dtype=np.int64)


PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, settled boolean"


def _pack(size: int, round_no: int, parts: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        # Arrow carries the ids as they are; in pandas a null among them would turn them into floats
        rows = rows.take(pa.array(np.lexsort((rows["row"].to_numpy(), -rows["length"].to_numpy()))))
        lengths = rows["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, size)
        settled = np.full(len(rows), True)
        if not last and len(free) > lower_bound(lengths, size):
            settled = free[bins] == 0
        elif not last and parts > 1:
            settled = bins != free.argmax()
        sequence = (round_no << 56) + (rows["part"][0].as_py() << 24) + bins
        columns = [rows[c].combine_chunks() for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*columns, pa.array(sequence), pa.array(offsets), pa.array(settled)], names=[c.split()[0] for c in PACKED.split(", ")])

    return run


def pack(documents: DataFrame, size: int = SIZE, path: str | None = None, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    prepare(documents.sparkSession)
    cut = pieces(documents, size, path).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    full = cut.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [full.select(*columns)]
    todo = cut.where(F.col("length") < size)
    left, before = todo.count(), None
    for n in range(rounds):
        if not left:
            break
        last = n == rounds - 1 or before is not None and left > HARDLY * before
        parts = partitions_for(left, partition_pieces)
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("row", F.lit(n)), F.lit(parts)).cast("int"))
        packed = dealt.groupBy("part").applyInArrow(_pack(size, n, parts, last), PACKED).checkpoint()
        done.append(packed.where("settled").select(*columns))
        if last:
            break
        todo = packed.where("not settled").drop("sequence_id", "offset", "settled")
        before, left = left, todo.count()
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
