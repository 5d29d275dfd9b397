"""Substring deduplication by relative Lempel-Ziv factors over content-defined reference blocks.

Every text is cut into overlapping reference blocks: the runs of ``width``-word windows that share one
minimizer (the least hash of the short word runs in the window). The index over all documents
keeps for each block the least document that holds it. A document is factored against
that index: a block whose least holder is another document is a factor, and adjoining factors
form the duplicate spans. Factor boundaries are settled window by window: blocks that share a minimizer but differ are
opened, and each of their windows is looked up among those of the blocks' least holders.
Equal windows always have the same minimizer, so no repeated window is missed.

Words are runs of bytes other than space and x09-x0D. A word is removed if it lies in a window that
also starts in a document with a smaller doc_id. Null and short texts lose nothing, as do rows
whose doc_id is null. Rows that repeat a doc_id are told apart by their text; equal rows get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import map_batches, prepare, release, sealed, text_bytes, written

WIDTH, GRAM = 50, 8
#: Blocks in an index that is sent to the tasks.
INDEX_ROWS = 1 << 16
SEGMENTS = "doc_id long, uid long, anchor long, block long, start int, n int"
KEY = ["doc_id", "uid"]
#: The same without nulls: inner and outer joins on it read one shuffle of the texts.
PLACE = ["place", "uid"]
SPANS = "array<struct<start: int, words: int>>"


def minimizers(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the least gram (the last of equals) in each run of ``span`` grams."""
    at, size = np.arange(len(grams)), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] <= grams[a], b, a)

    while size * 2 <= span:
        at, size = lower(at[:-size], at[size:]), size * 2
    return at if size == span else lower(at[: len(grams) - span + 1], at[span - size :])


def blocks_of(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, block hash, first window, number of windows) of each reference block."""
    if len(words) < width:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    hashes = hashing.word_hashes(words)
    sums = hashing.prefix_sums(hashes)
    starts = np.arange(len(words) - gram + 1)
    grams = hashing.spans(sums, starts, starts + gram)
    least = minimizers(grams, width - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(first, len(least)))
    whole = hashing.spans(hashing.prefix_sums(hashes, hashing.BASES[1]), first, first + n + width - 1, hashing.BASES[1])
    return grams[least[first]].view(np.int64), whole.view(np.int64), first, n


def _segments(width: int, gram: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks_of(t.split(), width, gram) for t in text_bytes(batch.column(2))]
        sizes = [len(f[0]) for f in found]
        rows = np.repeat(np.arange(len(found)), sizes)
        flat = [np.concatenate([f[i] for f in found]) for i in range(4)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2], pa.int32()), pa.array(flat[3], pa.int32())],
            ["doc_id", "uid", "anchor", "block", "start", "n"],
        )

    return run


class Index:
    """Reference blocks in sorted arrays, for a task's own lookups."""

    def __init__(self, rows: pa.Table):
        block, anchor, least, split = (rows.column(c).to_numpy() for c in ("b", "a", "least", "split"))
        order = np.lexsort((anchor, block))
        self.block, self.anchor, self.least, self.split = block[order], anchor[order], least[order], split[order]

    def find(self, anchor: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Place of each (anchor, block), -1 where it is not indexed."""
        if not len(self.block):
            return np.full(len(block), -1)
        at = np.searchsorted(self.block, block)
        last = np.searchsorted(self.block, block, side="right")
        for _ in range(int((last - at).max(initial=0))):  # blocks of one hash and several anchors hardly exist
            on = (at < last) & (self.anchor[np.minimum(at, len(self.block) - 1)] != anchor)
            if not on.any():
                break
            at = at + on
        return np.where(at < last, at, -1)


def _look_up(index, width: int, gram: int):
    """Of each document the spans of the blocks that a smaller one holds, and the blocks to be opened."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = index.value
        spans, listed = [], []
        for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(2)), strict=True):
            anchor, block, start, n = blocks_of(text.split(), width, gram)
            at = held.find(anchor, block)
            whole = (at >= 0) & (held.least[at] < doc) if len(held.block) else at >= 0
            split = (at >= 0) & ~whole & held.split[at] if len(held.block) else at >= 0
            spans.append([{"start": int(s), "words": int(k) + width - 1} for s, k in zip(start[whole], n[whole])])
            listed.append([{"start": int(s), "n": int(k), "anchor": int(a)} for s, k, a in zip(start[split], n[split], anchor[split])])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kinds[0]), pa.array(listed, kinds[1])], ["doc_id", "uid", "spans", "listed"])

    return run


def _open(width: int, gram: int):
    """Windows of the listed blocks: hash and first word of each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys, starts, anchors = [], [], [], []
        for row, (text, listed) in enumerate(zip(text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
            sums = hashing.prefix_sums(hashing.word_hashes(text.split()))
            n = np.array([x["n"] for x in listed])
            at = np.repeat([x["start"] for x in listed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys.append(hashing.spans(sums, at, at + width).view(np.int64))
            anchors.append(np.repeat([x["anchor"] for x in listed], n))
            starts.append(at)
            rows.append(np.full(len(at), row))
        rows = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(starts), pa.int32())], ["doc_id", "uid", "anchor", "window", "start"])

    return run


def spans_of(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, uid, spans (first word and number of words) of every document that repeats a smaller one.

    ``keyed`` are documents with ``uid``, the xxhash64 of the text, and ``place``, the doc_id or 0 for null. Very common passages are
    aggregated to their least holder before the shuffle; the join back is a plain equi-join that can split hot
    keys. The windows are left lazy: in one plan with the caller's join of ``keyed`` on ``PLACE`` the texts are shuffled once.
    """
    usable = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(*KEY, "text")
    segments = map_batches(usable, _segments(width, gram), SEGMENTS)
    holders = segments.groupBy("anchor", "block").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    holders = written(holders)  # read twice, and a plan with two uses of it would scan the texts twice
    release(keyed.sparkSession)
    split = holders.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("split"))
    index = holders.join(split, "anchor", "left").where("held > 1 OR split").select(F.col("anchor").alias("a"), F.col("block").alias("b"), "least", F.coalesce("split", F.lit(False)).alias("split")).checkpoint()
    del holders, split
    release(keyed.sparkSession)
    span = lambda words: F.struct(F.col("start"), words.cast("int").alias("words"))
    if index.count() <= INDEX_ROWS:  # a small index goes to the documents, else the blocks meet it in a shuffle
        shared = keyed.sparkSession.sparkContext.broadcast(Index(index.toArrow()))
        found = map_batches(usable, _look_up(shared, width, gram), f"doc_id long, uid long, spans {SPANS}, listed array<struct<start: int, n: int, anchor: long>>")
        found = found.where((F.size("spans") > 0) | (F.size("listed") > 0)).checkpoint()
        whole = found.where(F.size("spans") > 0).select(*KEY, "spans")
        listed = found.where(F.size("listed") > 0).dropDuplicates(KEY).select(*KEY, "listed")
    else:
        found = segments.join(index, (segments.anchor == index.a) & (segments.block == index.b)).where((F.col("least") < F.col("doc_id")) | F.col("split"))
        found = found.select(*KEY, "anchor", "start", "n", (F.col("least") < F.col("doc_id")).alias("whole")).checkpoint()
        whole = found.where("whole").select(*KEY, span(F.col("n") + (width - 1)).alias("span"))
        listed = found.where("not whole").groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "anchor")).alias("listed"))
    release(keyed.sparkSession)
    rest = [c for c in keyed.columns if c not in (*KEY, "text")]
    windows = map_batches(keyed.join(listed.withColumnRenamed("doc_id", "place"), PLACE).select(*KEY, "text", "listed", *rest), _open(width, gram), "doc_id long, uid long, anchor long, window long, start int")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("anchor").alias("a"), F.col("window").alias("w"), "least")
    matched = windows.join(least, (windows.anchor == least.a) & (windows.window == least.w)).where(F.col("least") < F.col("doc_id"))
    matched = matched.select(*KEY, span(F.lit(width)).alias("span"))
    if "span" in whole.columns:
        return whole.union(matched).groupBy(*KEY).agg(F.collect_set("span").alias("spans"))
    both = whole.union(matched.groupBy(*KEY).agg(F.collect_set("span").alias("spans")))
    return both.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def factors(spans: list[dict] | None, width: int = WIDTH) -> list[tuple[int, int]]:
    """(first word, words) of the factors of one document, parsed greedily from left to right.

    A factor starts at the first word not yet tried that starts a repeated window and goes on as far as every next window is in some
    reference block. Where one block's match ends and the next begins, the window over the boundary decides: it belongs to one
    of the two blocks, so the factor goes on only if that block holds it. Factors overlap if a window is missing in between.
    """
    out: list[tuple[int, int]] = []
    for start, words in sorted((s["start"], s["words"]) for s in spans or ()):
        if out and start + width - 1 <= out[-1][0] + out[-1][1]:  # its first window is next to or among those of the factor
            begin, held = out[-1]
            out[-1] = (begin, max(held, start + words - begin))
        else:
            out.append((start, words))
    return out


def covered(n_words: int, spans: list[dict] | None, width: int = WIDTH) -> np.ndarray:
    """True for each word inside a factor."""
    gone = np.zeros(n_words, dtype=bool)
    for start, words in factors(spans, width):
        gone[start : start + words] = True
    return gone


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, spans in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
        words = text.split()
        gone = covered(len(words), spans)
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
        out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*out, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` with uid and the column spans, null where nothing repeats."""
    prepare(documents.sparkSession)
    keyed = documents.withColumns({"uid": F.xxhash64("text"), "place": F.coalesce("doc_id", F.lit(0).cast("long"))})
    found = keyed.join(spans_of(keyed, width).withColumnRenamed("doc_id", "place"), PLACE, "left")
    return found.withColumn("spans", F.when(F.col("doc_id").isNotNull(), F.col("spans")))


def digest(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = with_spans(documents.select("doc_id", "text"), width)
    return map_batches(found.select("doc_id", "text", "spans"), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_BLANK = b" \t\n\x0b\x0c\r"


def cut_text(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans; what is kept is unchanged, blanks around a cut become one."""
    import re

    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    gone = covered(len(places), spans)
    out, at, i = [], 0, 0
    while i < len(places):
        if not gone[i]:
            i += 1
            continue
        j = i
        while j < len(places) and gone[j]:
            j += 1
        out.append(text[at : places[i][0]].rstrip(_BLANK))
        at = places[j][0] if j < len(places) else len(text)
        if j < len(places) and b"".join(out):
            gap = text[places[j - 1][1] : at]
            out.append(b"\n" if b"\n" in gap else b" ")
        i = j
    return b"".join([*out, text[at:]])


def remove_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` with the repeated spans cut out of text, and n_chars counted anew where present.

    Documents of which nothing is left are dropped; others keep all their columns.
    """
    counted = "n_chars" in documents.columns
    keyed, restore = sealed(documents, "doc_id", "text", "n_chars")
    found = with_spans(keyed, width)
    rest = [c for c in keyed.columns if c != "text"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if s is None else cut_text(t, s).decode() for t, s in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], ["cut_text", *batch.schema.names[2:]])

    schema = ", ".join(["cut_text string", "text string", *(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in rest)])
    # the text goes twice: once to be cut, once as it was
    out = map_batches(found.select("text", "spans", F.col("text").alias("kept_text"), *rest), cut, schema)
    out = out.withColumn("text", F.coalesce("cut_text", "text")).where(F.col("cut_text").isNull() | (F.col("cut_text") != ""))
    if counted:
        out = out.withColumn("n_chars", F.when(F.col("cut_text").isNotNull(), F.char_length("text").cast(keyed.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restore(out)


ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM docs WHERE len(w) >= {WIDTH})),
first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS k FROM windows JOIN first USING (h) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
