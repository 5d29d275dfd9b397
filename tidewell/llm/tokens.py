"""Token ids of whole texts, with the tokenizer run once for each distinct unit.

The tokenizer lower-cases, cuts a text into units (letters, single digits, runs of other characters) and never
merges over a unit's edge, so a text's ids are those of its units. Texts of Latin-1 characters only are cut here, by the
same rule; other texts, and those that may hold a special token or an odd blank, are cut at ASCII blanks, and
each part is encoded by the tokenizer. Ids are cached as packed bytes; new units of a batch are encoded
together and cut apart at the tokens that end a unit. A text then costs one join of bytes.
"""

from __future__ import annotations

import re

import numpy as np

#: Blanks, ASCII without control characters, and the printable part of Latin-1.
_LATIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0xA1, 256)])
#: The units of lower-case Latin-1 text: contractions, letters, one digit, or a run of anything else.
_UNITS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF]+|[0-9\xB2\xB3\xB9\xBC-\xBE]|[^\t-\r a-z0-9\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF\xB2\xB3\xB9\xBC-\xBE]+")
_PARTS = re.compile(r"[^ \t\n\r]+")
_CACHE_UNITS = 400_000
_AT_ONCE = 20_000
_LONGEST = 64
_WORD_END = "</w>"


class TokenCache(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.encode_many = tokenizer.encode, tokenizer.encode_batch_fast
        self.ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(_WORD_END)]] = True

    def __missing__(self, unit: str) -> bytes:
        packed = np.array(self.encode(unit, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(unit) <= _LONGEST:
            self[unit] = packed
        return packed

    def learn(self, units: list[str]) -> None:
        """Encode units as one text; they part at the tokens that end a unit."""
        for low in range(0, len(units), _AT_ONCE):
            some = units[low : low + _AT_ONCE]
            ids = np.array(self.encode_many([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) == len(some):
                raw, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
                self.update((w, raw[a:b]) for w, a, b in zip(some, starts, stops.tolist(), strict=True))

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null has none."""
        parts, latin = [], []
        for text in texts:
            plain = bool(text) and _is_plain(text)
            parts.append(_UNITS.findall(text.lower()) if plain else _PARTS.findall(text) if text else [])
            if plain:
                latin.append(parts[-1])
        units = set().union(*latin)
        if len(self) > _CACHE_UNITS:  # what this batch has, too, stays: all frequent units are in it
            kept = {u: self[u] for u in units if u in self}
            self.clear()
            self.update(kept)
        self.learn([u for u in units if u not in self and len(u) <= _LONGEST])
        get = self.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def _is_plain(text: str) -> bool:
    try:
        return "<|" not in text and not text.encode("latin-1").translate(None, _LATIN)
    except UnicodeEncodeError:
        return False


_CACHES: dict[str, TokenCache] = {}


def cache_for(path: str) -> TokenCache:
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
    return _CACHES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
