"""Word shingles of a text as sets of 64-bit hashes, with numpy.

Words are runs of bytes other than the ASCII white space; A-Z count as a-z. A word's hash
comes from prefix sums of byte values times powers of an odd base, so that a text costs
a few array operations whatever its words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np

# Words of a shingle.
SHINGLE = 5
# Bytes that are hashed at once; longer texts go piece by piece, cut between words.
PIECE = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# What is neither an ASCII letter or digit nor part of a character beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_RANDOM = np.random.Generator(np.random.PCG64(5))
_EXACT = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = 0x9E3779B97F4A7C15
_ORDER = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(
    data: np.ndarray, gaps: np.ndarray = SPACES, fold: bool = True, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a byte array: runs without a byte of ``gaps``.
    ``fold``: A-Z count as a-z. With ``prefixes``, the hashes have a row more for the
    first bytes of each word, for each of these numbers."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~gaps[data]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(1 << max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _EXACT)[data] * up[: len(data)], out=sums[1:])
    ends = [end, *(np.minimum(end, start + n) for n in prefixes)]
    rows = [
        mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) + np.uint64(i << 40))
        for i, stop in enumerate(ends)
    ]
    return (np.stack(rows) if prefixes else rows[0]), start, end


def to_bytes(text: str | bytes | None) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return np.frombuffer(raw, np.uint8)


def pieces(data: np.ndarray, gaps: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """Consecutive parts of about ``PIECE`` bytes, none of them ending inside a word."""
    at = 0
    while at < len(data):
        cut = min(at + PIECE, len(data))
        while cut < len(data):  # a word that runs on over the cut stays whole
            free = np.flatnonzero(gaps[data[cut : cut + PIECE]])
            cut = cut + int(free[0]) if len(free) else min(cut + PIECE, len(data))
            if len(free):
                break
        yield data[at:cut]
        at = cut


def word_hashes(text: str | bytes | None, gaps: np.ndarray = SPACES, fold: bool = True) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    found = [hashed_words(part, gaps, fold)[0] for part in pieces(to_bytes(text), gaps)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a text with fewer words is one
    shingle, one without words has none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    size = min(n, SHINGLE)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * _ORDER[j]
    return np.unique(mix(total))


def set_digest(shingles: np.ndarray) -> bytes:
    """16 bytes that are equal for equal sets."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both)
