"""Words of whole batches of UTF-8 texts, and 64-bit keys of words and of runs of words, by array operations.

A word is a longest run of digits, letters a to z (A to Z count as these) and bytes from 128 on, so every character
beyond ASCII belongs to words. Keys are those of the lower-cased words. Texts are taken in pieces of a fixed number of
bytes, and a word that a cut meets is put together again, so memory doesn't grow with a text but for 24 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes that are taken at once

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_STEP = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_VALUE = mixed(LOWER.astype(np.uint64) + np.uint64(1))


@cache
def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of texts in order: the bytes of all texts, where each word starts and ends, its key, and the number of the
    first word of each text (one entry more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    first: np.ndarray

    def text(self, at: int, size: int) -> str:
        """``size`` words from word ``at`` on, lower-cased, with spaces between."""
        return b" ".join(LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes() for i in range(at, at + size)).decode("utf-8", "replace")

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, keys) of all runs of ``size`` words that lie within one text."""
        n = len(self.keys) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total = total * _STEP + self.keys[k : k + n]
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]  # where the text of each word ends
        at = np.flatnonzero(np.arange(n) + size <= last)
        return at, mixed(total[at] + np.uint64(size))


def words_of(texts: pa.Array) -> Words:
    """The words of an array of strings; nulls have none."""
    texts = texts.cast(pa.large_string())
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + size + 1] if size else np.zeros(1, np.int64)
    whole = texts.buffers()[2] if size else None
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole is not None and whole.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if texts.null_count:
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if lengths.sum() != len(data):  # a null may keep bytes
            return words_of(texts.fill_null(""))
    return _split(data, offsets)


def _split(data: np.ndarray, offsets: np.ndarray) -> Words:
    up, down = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))
    starts, ends, raws = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        inside = np.zeros(len(part) + 2, dtype=bool)
        inside[1:-1] = _INSIDE[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edges[0::2], edges[1::2]
        borders = np.unique(offsets[np.searchsorted(offsets, at + 1) : np.searchsorted(offsets, at + len(part))] - at)
        borders = borders[inside[borders] & inside[borders + 1]]
        if len(borders):
            s, e = np.sort(np.concatenate([s, borders])), np.sort(np.concatenate([e, borders]))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], dtype=np.uint64, out=sums[1:])
        raw = (sums[e] - sums[s]) * down[s]
        cut = np.searchsorted(offsets, at)
        if len(s) and s[0] == 0 and len(ends[-1]) and ends[-1][-1] == at and not (cut < len(offsets) and offsets[cut] == at):
            before = int(ends[-1][-1] - starts[-1][-1])
            raws[-1][-1] = (int(raws[-1][-1]) + int(raw[0]) * pow(_BASE, before, 2**64)) % 2**64
            ends[-1][-1] = at + e[0]
            s, e, raw = s[1:], e[1:], raw[1:]
        if len(s):
            starts.append(s + at)
            ends.append(e + at)
            raws.append(raw)
    begin, end = np.concatenate(starts), np.concatenate(ends)
    keys = mixed(np.concatenate(raws) + (end - begin).astype(np.uint64) * _STEP)
    return Words(data, begin, end, keys, np.searchsorted(begin, offsets))
