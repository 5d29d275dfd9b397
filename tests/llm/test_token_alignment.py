"""Token alignment against both tokenizers run over whole texts, token pair by token pair."""

import hashlib
import random
from collections import Counter

import pytest

from tidewell.llm import queries, token_alignment
from tidewell.llm.common import table


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = token_alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=path_b)


def plain(rows, tokenizers):
    """The contract's columns by comparing every token of A with every token of B that is near."""
    a, b = tokenizers
    code, found, counts = token_alignment._byte_level(), [], Counter()
    for doc, text in rows:
        x = [(i, bytes(code[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        if text and not b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode():
            x = y = []
        ends = [[], []]
        for side, tokens in zip(ends, (x, y)):
            at = 0
            for _, t in tokens:
                at += len(t)
                side.append(at)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], [0, 0]
        for stop in common:
            group = []
            for side, tokens in enumerate((x, y)):
                high = ends[side].index(stop, low[side]) + 1
                group.append([i for i, _ in tokens[low[side] : high]])
                low[side] = high
            groups.append("|".join(",".join(map(str, ids)) for ids in group))
            links.append((group[0][-1], group[1][-1]))
        counts.update(links)
        found.append((doc, len(x), len(y), groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def test_query(spark, data, tokenizers):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, data).collect()), key=repr) == plain(rows, tokenizers)


@pytest.mark.parametrize("part_bytes, heavy", [(40, 3), (1_000_000, 100_000)])
def test_odd_texts(spark, tokenizers, part_bytes, heavy):
    """Nulls, blanks of all kinds, special tokens as text, repeated rows, ids beyond double precision, a column with a clashing name."""
    rng = random.Random(3)
    letters = [*" \n\n  abC'st1.,\r\t\x1c\xa0　é日<>\x85 ", "▁", "<|endoftext|>", "</s>", "<0x41>", "don't", "\U0001f600", " the", " and"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", " ", "  ", "\n", "▁", "the " * 400, "x" * 3000, "日本語" * 50, "a  b"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(2**53 + 1, "same text"), (2**53 + 1, "same text")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pairs int").repartition(3)
    got = token_alignment.links(df, part_bytes=part_bytes, heavy=heavy)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, tokenizers)
    assert token_alignment.links(df.limit(0)).count() == 0


def test_all_overlaps_are_found():
    import numpy as np
    import pandas as pd

    rng = random.Random(5)
    for _ in range(50):
        frames, spans = [], []
        sizes = [rng.randint(1, 30) for _ in range(3)]
        for name in "ab":
            rows, at, n = [], 0, 0
            for doc, size in enumerate(sizes):
                cuts = sorted({0, size, *(rng.randint(1, size) for _ in range(6))})
                for low, high in zip(cuts, cuts[1:]):
                    rows.append((doc, at + low, at + high, n))
                    n += 1
                at += size
            spans.append(rows)
            frames.append(pd.DataFrame([(d, s, k) for d, s, _, k in rows], columns=["doc", "start", name]))
        want = {(x[3], y[3]) for x in spans[0] for y in spans[1] if max(x[1], y[1]) < min(x[2], y[2])}
        got = token_alignment.covering(*frames)
        assert len(got) == len(want) and set(map(tuple, got.to_numpy(dtype=np.int64).tolist())) == want
