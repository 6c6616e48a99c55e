"""Words and word shingles of whole batches of texts as 64-bit hashes, without a Python loop over words.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, after
lower-casing A-Z. A word's hash is a sum of random values of its bytes times powers of an odd number, so that one
running sum over the buffer gives them all; splitmix64 finishes it.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER, mix, randoms

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = randoms(256, 11)
_ODD = 0xA0761D6478BD642F | 1
_BACK = pow(_ODD, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd number and of its inverse; the largest buffer so far decides how many are kept."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _BACK)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(base)
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the place of each text's first word among them (one more place at the end).

    data, offsets: UTF-8 bytes of the texts, one after another."""
    n, texts = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    space = _SPACE[data]
    begins = np.zeros(n + 1, bool)  # a text begins here, or the buffer ends
    begins[offsets] = True
    first = ~space & (np.concatenate([[True], space[:-1]]) | begins[:-1])
    last = ~space & (np.concatenate([space[1:], [True]]) | begins[1:])
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    power, back = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[LOWER[data]] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * back[start]), np.searchsorted(start, offsets)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; fewer words are one shingle, no words none."""
    n, count = len(word), np.diff(first)
    if not n:
        return [np.zeros(0, np.uint64)] * len(count)
    end = np.repeat(first[1:], count)
    at = np.arange(n)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        there = at + j < end
        step = mix(word[np.minimum(at + j, n - 1)] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + np.where(there, step, np.uint64(0)))
    many = np.maximum(count - k + 1, np.minimum(count, 1))
    return [np.unique(out[a : a + m]) for a, m in zip(first[:-1].tolist(), many.tolist(), strict=True)]
