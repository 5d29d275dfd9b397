"""Alignment of two tokenizers' tokens by the bytes that they cover, and how often ids are linked in a corpus.

Both cut the same bytes, a space and the text. Each token's start is looked up among the other side's starts by
``merge_asof``, keyed by document, which gives the token that covers it; the union of both directions is every pair of
tokens that overlap, and places where both end cut the document into groups. A link is a pair of tokens that end together.

Tokens are found once for each distinct unit (blanks and what follows them, which neither tokenizer merges over); units are
also where a very long text is cut, so that a task holds ``PART_BYTES`` of tokens at a time, whatever a text's length.

What the corpus says about a pair of ids is counted over all documents. Pairs that hold over a ``HEAVY``-th of all links are fewer than
``HEAVY``, so they are sent to the documents; the others meet them in a shuffle, in which no pair has more than that share.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte (as with U+2581), have no tokens: zeros and ''.
Repeated rows are rows of their own and count each time; a null doc_id is carried along; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_array, map_batches, prepare

PART_BYTES = 1_000_000
HEAVY = 100_000
_CACHE_UNITS, _AT_ONCE = 600_000, 1000
#: A blank or line end after something else starts a unit; other white space belongs to the unit that it is in.
_UNITS = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_SPACE = "▁"
_SIDE_B = np.uint32(1 << 31)
#: Where byte-level tokenizers cut a text before merging, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def _by_ranks(path: str, vocabulary: dict[str, int], raw: list[bytes]) -> Callable[[str], list[int]] | None:
    """A tiktoken encoder of the file's vocabulary, if a merge always makes a later id than those before it."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={raw[i]: i for i in vocabulary.values() if raw[i]}, special_tokens={}).encode_ordinary


def _join(table: list[bytes], ids: list[int] | np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids))


class TokenizerPair:
    """The packed ids of both tokenizers by unit; ``odd`` are units whose bytes one of them doesn't give back.

    Ids are packed in 32 bits, those of B with the highest bit set. Where the merges of A are in the order of their ids, as here, A's file is
    run by tiktoken, which gives the same ids faster.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.ids: dict[str, bytes] = {}
        self.odd: set[str] = set()
        whole = Tokenizer.from_file(path_a)
        whole.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        code, vocabulary = _byte_level(), whole.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * whole.get_vocab_size()
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(code[c] for c in token)
        self.encode_a = _by_ranks(path_a, vocabulary, self.bytes_a) or (lambda text: whole.encode(text, add_special_tokens=False).ids)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(rf"[^{_SPACE}]{_SPACE}", p) or "\n" in p[1:] for p in pieces):
            raise ValueError("pieces that go on over a blank or a line end can't be found unit by unit")
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(_SPACE)
        #: decimal ids with what follows them, as eight bytes: A inside a group, A at its end, B inside, B at the end
        self.names = np.array([b"%d" % i + end for side, end in ((self.bytes_a, b","), (self.bytes_a, b"|"), (self.bytes_b, b","), (self.bytes_b, b";")) for i in range(len(side))], dtype="S8").view(np.int64)

    def _tokens(self, units: list[str]) -> Iterator[bytes | None]:
        """Tokens of units that end in something else than white space, found as one text and cut apart at the units' ends."""
        raw = [u.encode() for u in units]
        text, ends = "".join(units), np.cumsum([len(x) for x in raw])
        # the leading blank is added to what is encoded; before a line end it is one too many
        ids_a = np.array(self.encode_a(text), dtype="<u4")
        ids_b = np.array(self.b.encode(text[text[0] == " " :], num_threads=1)[text[0] != " " :], dtype="<u4")
        if _join(self.bytes_a, ids_a) != b"".join(raw) or _join(self.bytes_b, ids_b) != b"".join(raw):
            half = len(units) // 2  # what isn't given back is found by halves
            yield from [*self._tokens(units[:half]), *self._tokens(units[half:])] if half else [None]
            return
        unit_a, unit_b = (np.searchsorted(ends, np.cumsum(lengths[ids])) for lengths, ids in ((self.lengths_a, ids_a), (self.lengths_b, ids_b)))
        order = np.argsort(np.concatenate([2 * unit_a, 2 * unit_b + 1]), kind="stable")
        packed = np.concatenate([ids_a, ids_b | _SIDE_B])[order].tobytes()
        low = 0
        for high in (4 * np.cumsum(np.bincount(unit_a, minlength=len(units)) + np.bincount(unit_b, minlength=len(units)))).tolist():
            yield packed[low:high]
            low = high

    def _last(self, unit: str) -> bytes | None:
        """Tokens of a unit that ends in white space, which only a text's last unit does."""
        x = self.encode_a(unit)
        y = [self.blank] if unit == " " else self.b.encode(unit[unit[0] == " " :], num_threads=1)[unit[0] != " " :]
        same = _join(self.bytes_a, x) == unit.encode() == _join(self.bytes_b, y)
        return np.concatenate([np.array(x, dtype="<u4"), np.array(y, dtype="<u4") | _SIDE_B]).tobytes() if same else None

    def units(self, texts: list[str | None]) -> list[list[str]]:
        """The units of a space and each text, none for null and empty texts; they are known until the next call."""
        cut = [_UNITS.findall(" " + t) if t else [] for t in texts]
        new = set().union(*cut)
        if len(self.ids) > _CACHE_UNITS:
            held = {u: self.ids[u] for u in new if u in self.ids}
            self.ids.clear()
            self.ids.update(held)
        new = [u for u in new if u not in self.ids]
        self.odd.clear()
        plain = [u for u in new if not u[-1].isspace()]
        for low in range(0, len(plain), _AT_ONCE):
            some = plain[low : low + _AT_ONCE]
            self.ids.update(zip(some, self._tokens(some), strict=True))
        self.ids.update((u, self._last(u)) for u in new if u[-1].isspace())
        for u in new:
            if self.ids[u] is None:
                self.odd.add(u)
                del self.ids[u]
        return cut


_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


def pair_for(path_a: str, path_b: str) -> TokenizerPair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = TokenizerPair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def covering(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a, b): every two tokens that overlap, by their numbers.

    Frames hold doc, start (ascending over all documents) and the token's number. Where two tokens overlap, one of them
    starts inside the other, so looking each start up on the other side finds all; pairs with one start are found twice.
    """
    there = pd.merge_asof(a, b, on="start", by="doc")
    back = pd.merge_asof(b, a, on="start", by="doc")
    again = a["start"].to_numpy()[back["a"].to_numpy()] == back["start"].to_numpy()
    return pd.concat([there[["a", "b"]], back.loc[~again, ["a", "b"]]], ignore_index=True)


class Part:
    """Tokens of several documents' parts, and what aligning them gives."""

    def __init__(self, pair: TokenizerPair, docs: list[int], packed: list[bytes]):
        self.pair, self.docs = pair, docs
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        of = np.repeat(np.arange(len(docs)), [len(x) // 4 for x in packed])
        side_b = ids >= _SIDE_B
        self.a, self.b = ids[~side_b].astype(np.int64), (ids[side_b] - _SIDE_B).astype(np.int64)
        self.doc_a, self.doc_b = of[~side_b], of[side_b]
        self.counts_a, self.counts_b = (np.bincount(x, minlength=len(docs)) for x in (self.doc_a, self.doc_b))
        self.ends_a, self.ends_b = np.cumsum(pair.lengths_a[self.a]), np.cumsum(pair.lengths_b[self.b])
        frame = lambda doc, ends, lengths, name: pd.DataFrame({"doc": doc, "start": ends - lengths, name: np.arange(len(doc))})
        self.overlaps = covering(frame(self.doc_a, self.ends_a, pair.lengths_a[self.a], "a"), frame(self.doc_b, self.ends_b, pair.lengths_b[self.b], "b"))
        x, y = self.overlaps["a"].to_numpy(), self.overlaps["b"].to_numpy()
        together = self.ends_a[x] == self.ends_b[y]
        # each end has one token a side, so both sides of the links are in the same order
        self.link_a, self.link_b = np.sort(x[together]), np.sort(y[together])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token: groups end where tokens of both sides do."""
        last = [np.zeros(len(x), dtype=np.int64) for x in (self.a, self.b)]
        last[0][self.link_a], last[1][self.link_b] = 1, 1
        return tuple(np.cumsum(x) - x for x in last)

    def texts(self) -> Iterator[tuple[int, bytes]]:
        """Each document's groups as text, with a semicolon after each of them."""
        group_a, group_b = self.groups()
        n = len(self.link_a)
        held_a, held_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        at_a = np.arange(len(self.a)) + (np.cumsum(held_b) - held_b)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(held_a)[group_b]
        size_a, size_b = len(self.pair.bytes_a), len(self.pair.bytes_b)
        words = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        words[at_a], words[at_b] = self.a, self.b + 2 * size_a
        words[at_a[np.cumsum(held_a) - 1]] += size_a
        words[at_b[np.cumsum(held_b) - 1]] += size_b
        named = self.pair.names[words]
        low = 0
        for doc, count in zip(self.docs, (self.counts_a + self.counts_b).tolist(), strict=True):
            yield doc, named[low : low + count].tobytes().translate(None, b"\0")
            low += count


def _parts(pair: TokenizerPair, texts: list[str | None], part_bytes: int) -> Iterator[Part]:
    """Whole documents or parts of them, cut between units, ``part_bytes`` of text at a time; texts that aren't given back are left out."""
    docs, packed, held = [], [], 0
    for doc, units in enumerate(pair.units(texts)):
        if not units or not pair.odd.isdisjoint(units):
            continue
        low = 0
        while low < len(units):
            some, size = units if low == 0 else units[low:], len(texts[doc])
            if size > part_bytes - held:  # bytes are counted only where the part may be full
                sizes = np.cumsum([len(u.encode()) for u in some])
                some = some[: max(1, int(np.searchsorted(sizes, part_bytes - held, "right")))]
                size = int(sizes[len(some) - 1])
            docs.append(doc)
            packed.append(b"".join(map(pair.ids.__getitem__, some)))
            held, low = held + size, low + len(some)
            if held >= part_bytes or low < len(units):
                yield Part(pair, docs, packed)
                docs, packed, held = [], [], 0
    if docs:
        yield Part(pair, docs, packed)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def aligned(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the linked ids: pairs (id of A times B's vocabulary plus id of B) and their times.

    ``groups_sha256`` is of the groups as "a1,a2|b1;a3|b2,b3" in decimal ids.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = pair_for(path_a, path_b)
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        counts = np.zeros((3, len(texts)), dtype=np.int64)
        digests: dict[int, object] = {}
        linked: list[list[np.ndarray]] = [[] for _ in texts]
        for part in _parts(pair, texts, part_bytes):
            np.add.at(counts[0], part.docs, part.counts_a)
            np.add.at(counts[1], part.docs, part.counts_b)
            of = part.doc_a[part.link_a]
            each = np.bincount(of, minlength=len(part.docs))
            np.add.at(counts[2], part.docs, each)
            codes = part.a[part.link_a] * len(pair.bytes_b) + part.b[part.link_b]
            for doc, some in zip(part.docs, np.split(codes, np.cumsum(each)[:-1]), strict=True):
                linked[doc].append(some)
            for doc, text in part.texts():
                if doc in digests:
                    digests[doc].update(b";" + text[:-1])
                else:
                    digests[doc] = hashlib.sha256(text[:-1])
        found = [np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.int64),) * 2 for x in linked]
        columns = [ids, *(pa.array(counts[k]) for k in (0, 1, 2, 2)), pa.array([digests[i].hexdigest() if i in digests else "" for i in range(len(texts))])]
        columns += [list_array([x[k] for x in found], pa.int32()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED.split(", ")])

    return map_batches(documents.select("doc_id", "text"), run, ALIGNED)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each pair of ids, and whether no pair with this id of B has more."""
    counts = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts = counts.checkpoint()
    id_b = (F.col("pair") % size_b).alias("id_b")
    most = counts.groupBy(id_b).agg(F.max("n").alias("most"))
    return counts.withColumn("id_b", id_b).join(most, "id_b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def links(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, part_bytes: int = PART_BYTES, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``count_sum`` sums, over a document's links, how many links of the corpus hold the same ids; ``n_best`` counts the links
    whose number is the highest of their id of B.
    """
    prepare(documents.sparkSession)
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]
    found = aligned(documents, path_a, path_b, part_bytes).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    counts = pair_counts(found, len(pair_for(path_a, path_b).bytes_b)).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * heavy > total
    each = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")

    def scored(rows: DataFrame) -> DataFrame:
        n_best: Column = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return rows.groupBy("row").agg(n_best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    many = F.broadcast(counts.where(often))  # fewer than ``heavy`` rows, since each holds over a heavy-th of the total
    by_many = scored(each.join(many, "pair"))
    by_few = scored(each.join(many, "pair", "left_anti").join(counts.where(~often), "pair"))
    sums = by_many.union(by_few).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
