"""64-bit hashes of words and of word sequences, vectorised with numpy.

A sequence w[i:j] has the hash (S[j] - S[i]) * B**-i mod 2**64 with S the prefix sums of
w[n] * B**n and B odd, so every window of a text costs a few vector operations.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i mod 2**64 for i in [0, n)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            both.append(p)
        have = _POWERS[base] = (both[0], both[1])
    return have


def prefix_sums(words: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    up, _ = _powers(base, len(words) + 1)
    out = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the spans [start, stop), mixed."""
    _, down = _powers(base, len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(words: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each k consecutive words; none for shorter texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    at = np.arange(n)
    return spans(prefix_sums(words, base), at, at + k, base)
