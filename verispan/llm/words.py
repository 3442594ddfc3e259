"""Vectorized words: hashes of all words of a block of texts, without a Python loop."""

from __future__ import annotations

import numpy as np

from .common import LOWER

#: Bytes that make words: ASCII letters and digits, and all bytes of longer UTF-8 sequences.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the step by place in a word; later places use them again from the start.
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _STEP, np.uint64)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit reaches every output bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def hashed_words(data: np.ndarray, at: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, text offsets): words of all texts in order.

    data holds the texts' bytes one after the other, at their n + 1 offsets. A-Z count as a-z;
    ``word`` says which bytes make words. Text k's words are those from offsets[k] to offsets[k + 1].
    """
    inside = word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[-1]]
    begin[edges] = inside[edges]
    place = np.flatnonzero(inside)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(at), np.int64)
    first = np.searchsorted(place, starts)
    within = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    terms = _TABLE[LOWER[data[place]]] * _POWERS[within & 4095]
    return mix(np.add.reduceat(terms, first)), starts, np.searchsorted(starts, at)


def hash_of(word: str) -> int:
    """The hash of one word, as ``hashed_words`` gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashed_words(raw, np.array([0, len(raw)]))[0][0])
