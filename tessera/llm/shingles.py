"""Word and shingle hashes of whole texts, in numpy, for use inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D after A-Z are lower-cased; all of these are ASCII, so the
UTF-8 bytes can be cut directly. A word's hash is a polynomial over a random byte table modulo 2**64, finalised by
a mixing function; a shingle's hash mixes a linear form of the word hashes. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = _powers[base] = np.multiply.accumulate(np.full(max(2 * n, 1 << 14), base, dtype=np.uint64))
    return have[:n]


#: For words of letters only: every ASCII character that isn't a letter separates.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def word_hashes(text: str, separator: np.ndarray = _SEPARATOR) -> np.ndarray:
    """One 64-bit hash a word, in order; A-Z count as a-z."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    inside = ~separator[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    v = _BYTE[b]
    v[~inside] = 0
    sums = np.add.reduceat(v * powers(_BASE, len(b)), starts)
    return mix(sums * powers(pow(_BASE, -1, 2**64), len(b))[starts])


_WIDTH = {w: np.random.default_rng(w).integers(1, 2**63, w, dtype=np.uint64) | U64(1) for w in range(1, 65)}


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text the whole sequence as one; none without words."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    if n < width:
        return mix(np.array([(h * _WIDTH[n]).sum() + U64(n)], dtype=np.uint64))
    c = _WIDTH[width]
    total = h[: n - width + 1] * c[0]
    for i in range(1, width):
        total += h[i : n - width + 1 + i] * c[i]
    return np.unique(mix(total + U64(width)))
