"""Words and word n-grams as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .workers import Recent

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(Recent):
    """Word (bytes) to its 64-bit hash."""

    def __init__(self, make=xxhash.xxh3_64_intdigest):
        super().__init__(make)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: what stands between ASCII white space. (For bytes, split() knows no other.)"""
    return text.encode().split() if text else []


#: Bytes of a text that are looked at in one go; a piece ends with a word.
PIECE = 1 << 18
_WHITE = re.compile(rb"[\x20\x09-\x0d]")
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text, the same words as :func:`split_words` gives, all in numpy.

    A hash is a polynomial over the word's bytes, mixed. Equal words have equal hashes; it is for
    choosing places, not for telling words apart.
    """
    found, lo = [], 0
    while lo < len(raw):
        hi = len(raw)
        if hi - lo > PIECE and (m := _WHITE.search(raw, lo + PIECE)):
            hi = m.start()
        data = np.frombuffer(raw, np.uint8, hi - lo, lo)
        black = np.zeros(len(data) + 2, bool)
        black[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edges = np.flatnonzero(black[1:] != black[:-1])
        starts, ends = edges[0::2], edges[1::2]
        if len(starts):
            sizes = ends - starts
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            values = (data[black[1:-1]].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
            found.append((mixed(np.add.reduceat(values, first)), starts + lo, ends + lo))
        lo = hi
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(map(np.concatenate, zip(*found))) if len(found) > 1 else found[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words, in order; a shorter text has one for all it has."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    count = len(hashes) - n + 1
    h = hashes[:count].copy()
    for j in range(1, n):
        h *= _M1
        h ^= h >> np.uint64(29)
        h += hashes[j : j + count]
    return mixed(h + np.uint64(n))
