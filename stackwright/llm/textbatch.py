"""Vectorised text helpers for one Arrow batch: many texts as one byte array."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from stackwright.llm.common import slices

_rng = np.random.default_rng(20240229)
#: Fixed random values of the 256 bytes, and an odd base for positions, for word hashes.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For tokens without punctuation: everything of ASCII but letters and digits stands between them.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def powers(n: int) -> np.ndarray:
    return _powers(max(64, 1 << (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values, well mixed."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts (null: none): runs of bytes that are no white space.

    buf: the bytes, each text stripped and with one space after it; text_at: where each text starts,
    with the length of all at its end; start: where each word starts; hash: 64 bits a word; first:
    index of each text's first word, with the number of words at its end.
    """

    def __init__(self, texts, lower: bool = False, between: np.ndarray = IS_SPACE):
        raw = [(t or "").strip(SPACES).encode("utf-8", "surrogatepass") for t in texts]
        self.buf = buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.text_at = text_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.space = space = between[buf]
        begins = ~space
        begins[1:] &= space[:-1]
        self.start = np.flatnonzero(begins)
        self.first = np.searchsorted(self.start, text_at)
        self.word_of_byte = np.cumsum(begins, dtype=np.int32) - 1
        if len(self.start):
            place = np.arange(len(buf), dtype=np.int64) - self.start[np.maximum(self.word_of_byte, 0)]
            with np.errstate(over="ignore"):
                value = BYTE_VALUE[LOWER[buf] if lower else buf] * powers(int(place.max()) + 1)[place]
                value[space] = 0
                self.hash = mix(np.add.reduceat(value, self.start))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


def each_text(texts, lower: bool = False, between: np.ndarray = IS_SPACE) -> Iterator[np.ndarray]:
    """The hashed words of each text (a pandas column), built some texts at a time."""
    for part in slices(texts):
        w = Words(texts.iloc[part], lower, between)
        for i in range(len(w)):
            yield w.of(i)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word windows; of fewer words, one of them all."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(words, min(k, len(words))))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * BASE + words[j : j + n]
    return mix(out)
