"""Ids of the token cache against the tokenizer itself."""

import random

import numpy as np
import pytest

from tidewell.llm import tokens

ALPHABETS = {
    "latin": [chr(x) for x in range(256)],
    "edges": list("abzABZ'''stmdrevl0129 \t\n.,!<>|-_ß\xc0\xe0\xd6\xd7\xf7\xf8\xfe\xff\xaa\xb5\xba\xb2\xbc \xad\xa0\x85\x1c"),
    "others": list("aB' .1<|é日本Σσς\u0130\u017f\u1e9e\ufb01\u0301\u2003\u200b"),
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_ids(name):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    whole, cache, rng = Tokenizer.from_file(path), tokens.TokenCache(path), random.Random(4)
    texts = ["".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|startoftext|>a", "don't we'll I'VE", "a" * 500]
    for text, packed in zip(texts, cache.packed(texts)):
        assert packed == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
