"""Benchmark decontamination: Wu-Manber search for many test strings, over words.

Symbols are words. Test strings of one length m are searched together: a table tells for each
block of two words how far the search may move on; where it may not, the hash of the last words
selects a bucket of test strings, and a direct comparison confirms. Cursors of a whole
batch advance together in numpy; long texts get several cursors, so no text is long.

An item's windows are its runs of ``width`` consecutive words; an item with fewer words, but
some, is one window. Null and empty texts have no words. Repeated items and documents are
rows of their own. The benchmark is searched in blocks of items, so its size is bounded per pass.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, map_batches, prepare, text_bytes

WIDTH = 10
#: Bounds of what a pass sends to the tasks.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 32 << 20
CHUNK = 512
#: ASCII letters and digits and all bytes of other characters make words; A-Z are lower-cased.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass
class Table:
    """Test strings of m words: shifts by block, buckets by the last words."""

    m: int
    patterns: np.ndarray  # one a row, word numbers
    owners: list[list[int]]  # items that hold the pattern
    blocks: np.ndarray  # sorted block keys
    shifts: np.ndarray
    suffixes: np.ndarray  # sorted suffix hashes, with the pattern of each
    suffix_of: np.ndarray


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


_MULTIPLIER = np.int64(1_000_003)


def build(items: list[tuple[object, bytes]], width: int = WIDTH) -> tuple[dict[bytes, int], list[Table]]:
    """The words of all test strings, numbered from 1, and a table for each length of test string."""
    number: dict[bytes, int] = {}
    held: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for at, (_, text) in enumerate(items):
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
        m = min(width, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            own = held[m][tuple(ids[i : i + m])]
            if not own or own[-1] != at:
                own.append(at)
    tables = []
    for m, found in sorted(held.items()):
        patterns = np.array(list(found), dtype=np.int64).reshape(-1, m)
        size = min(2, m)
        best: dict[int, int] = {}
        for end in range(size - 1, m):
            keys = patterns[:, end] if size == 1 else _key(patterns[:, end - 1], patterns[:, end])
            for key in np.unique(keys).tolist():
                best[key] = m - 1 - end  # later ends come later and are smaller
        blocks = np.array(sorted(best), dtype=np.int64)
        tails = _suffix(patterns, np.full(len(patterns), m - 1), np.arange(len(patterns)), m)
        order = np.argsort(tails, kind="stable")
        tables.append(Table(m, patterns, list(found.values()), blocks, np.array([best[b] for b in blocks.tolist()], dtype=np.int64), tails[order], order))
    return number, tables


def _suffix(words: np.ndarray, ends: np.ndarray, rows: np.ndarray | None, m: int) -> np.ndarray:
    """Hash of the last (up to four) words."""
    out = np.zeros(len(ends), dtype=np.int64)
    for back in range(min(4, m)):
        out = out * _MULTIPLIER + (words[rows, ends - back] if rows is not None else words[ends - back])
    return out


def search(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: Table, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of each occurrence inside the texts words[start:stop]."""
    m = table.m
    firsts, lasts = [], []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        for at in range(a, b - m + 1, chunk):
            firsts.append(at + m - 1)
            lasts.append(min(at + chunk - 1 + m, b))
    at, stop = np.array(firsts, dtype=np.int64), np.array(lasts, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    furthest = m if m == 1 else m - 1
    while len(at):
        keys = words[at] if m == 1 else _key(words[at - 1], words[at])
        slot = np.minimum(np.searchsorted(table.blocks, keys), len(table.blocks) - 1)
        shift = np.where(table.blocks[slot] == keys, table.shifts[slot], furthest)
        here = at[shift == 0]
        if len(here):
            tails = _suffix(words, here, None, m)
            low, high = np.searchsorted(table.suffixes, tails), np.searchsorted(table.suffixes, tails, side="right")
            ends = np.repeat(here, high - low)
            offset = np.arange(len(ends)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            which = table.suffix_of[np.repeat(low, high - low) + offset]
            same = (words[ends[:, None] - np.arange(m - 1, -1, -1)] == table.patterns[which]).all(1)
            if same.any():
                found.append((ends[same] - m + 1, which[same]))
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([p for _, p in found])


HITS = "n_words long, hits array<int>"


def _scan(items, width: int):
    """Searches the last column; the columns before it are passed on. ``items`` is a broadcast."""
    built: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(build(items.value, width))
        number, tables = built[0]
        texts = [words_of(t) for t in text_bytes(batch.column(batch.num_columns - 1))]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        stops = np.cumsum(sizes)
        get = number.get
        words = np.fromiter((get(w, 0) for t in texts for w in t), dtype=np.int64, count=int(stops[-1]))
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        owners: list[set[int]] = [set() for _ in texts]
        for table in tables:
            first, which = search(words, stops - sizes, stops, table)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + table.m, -1)
            for doc, p in zip(np.searchsorted(stops, first, side="right").tolist(), which.tolist(), strict=True):
                owners[doc].update(table.owners[p])
        where = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
        doc = np.searchsorted(stops, where, side="right")
        own = np.split((where - (stops - sizes)[doc]).astype(np.int32), np.searchsorted(doc, np.arange(1, len(texts))))
        found = [pa.array(sizes), list_array(own, pa.int32()), list_array([np.array(sorted(o), dtype=np.int32) for o in owners], pa.int32())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "n_words", "hits", "items"])

    return run


def _passes(benchmark: DataFrame, items_per_pass: int) -> int:
    total, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-total // items_per_pass), -(-size // BYTES_PER_PASS))


def _items(benchmark: DataFrame, passes: int, n: int):
    """The items of pass n, broadcast."""
    some = benchmark if passes == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
    rows = [(r[0], (r[1] or "").encode()) for r in some.select("item_id", "text").toLocalIterator()]
    return benchmark.sparkSession.sparkContext.broadcast(rows)


def occurrences(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, n_words, hits (word positions inside occurrences), item_ids (of the items that occur).

    The benchmark is read in passes of about ``items_per_pass`` items and ``BYTES_PER_PASS`` bytes, which bounds
    what the driver and a task hold; with more than one pass the documents are numbered and checkpointed, so that every
    pass reads the same numbers, each pass's hits are written before the next is read, and the passes meet by that number.
    """
    prepare(documents.sparkSession)
    passes = _passes(benchmark, items_per_pass)
    documents = documents.select("doc_id", "text")
    keys = {"doc_id": documents.schema["doc_id"].dataType.simpleString()}
    if passes > 1:
        documents = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").checkpoint()
        keys = {"row": "long"} | keys
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + f", {HITS}"
    out = None
    for n in range(passes):
        items = _items(benchmark, passes, n)
        names = [None if i is None else str(i) for i, _ in items.value]
        found = map_batches(documents, _scan(items, width), f"{schema}, items array<int>")
        literal = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
        found = found.select(*keys, "n_words", "hits", F.transform("items", lambda i: F.element_at(literal, i + 1)).alias("item_ids")) if len(names) <= 1000 else _named(found, names, schema)
        if passes == 1:
            return found
        # the first pass has a row for every document, the others those with hits
        found = (found.where(F.size("hits") > 0) if n else found).checkpoint()
        items.destroy()
        out = found if out is None else out.union(found)
    merged = out.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.flatten(F.collect_list("item_ids")).alias("item_ids"),
    )
    return merged.drop("row")


def _named(found: DataFrame, names: list[str | None], schema: str) -> DataFrame:
    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [[names[i] for i in x] for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.list_(pa.string()))], [*batch.schema.names[:-1], "item_ids"])

    return map_batches(found, name, f"{schema}, item_ids array<string>")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the report: counts, and a hash of the item ids."""
    ids = F.array_sort(F.array_distinct(F.filter("item_ids", lambda x: x.isNotNull())))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``documents`` in which no test string occurs.

    The verdict travels with the text in one batch, so nothing is joined or shuffled.
    """
    prepare(documents.sparkSession)
    passes = _passes(benchmark, ITEMS_PER_PASS)
    for n in range(passes):
        items = _items(benchmark, passes, n)
        scan = _scan(items, width)
        at = [documents.columns.index(c) for c in ("doc_id", "text")]

        def keep(batch: pa.RecordBatch, scan=scan, at=at) -> pa.RecordBatch:
            ids = pa.array(range(batch.num_rows), pa.int64())
            hits = scan(pa.RecordBatch.from_arrays([ids, batch.column(at[1])], ["doc_id", "text"])).column(2)
            return batch.filter(pa.array(hits.value_lengths().to_numpy(zero_copy_only=False) == 0))

        documents = map_batches(documents, keep, documents.schema)
        if passes > 1:
            documents = documents.checkpoint()
            items.destroy()
    return documents


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents), items AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT item_id, w, least({WIDTH}, len(w)) AS m, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT r, i, m, item_id FROM places JOIN windows USING (m, p)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM found) GROUP BY 1),
named AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
