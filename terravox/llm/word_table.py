"""A vectorised memo from words to id sequences.

Words of a whole batch are looked up at once: their bytes (up to 24) are three 64-bit numbers, which are the exact key
of an open-addressing table in numpy arrays. Only words that aren't there yet become Python strings; longer words have
a dictionary. The table has a bound; beyond it, it starts again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import mix

WIDE = 24
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class WordTable:
    def __init__(self, learn: Callable[[list[str]], list[bytes]], at_most: int = 1_200_000) -> None:
        """learn: little-endian unsigned 32-bit ids of each of some words."""
        self.learn, self.at_most = learn, at_most
        self.slots = 1 << (at_most * 3 // 2 - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.index = np.full(self.slots, -1, np.int32)
        self.keys = np.zeros((self.slots, 3), np.uint64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.n, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
        self.long: dict[str, int] = {}

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return mix(mix(mix(key[:, 2]) ^ key[:, 1]) ^ key[:, 0])

    def _find(self, key: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Value numbers, -1 for words that aren't there."""
        mask = np.uint64(self.slots - 1)
        slot = (hashed & mask).astype(np.int64)
        out = self.index[slot]
        left = np.nonzero(out >= 0)[0]
        left = left[(self.keys[slot[left]] != key[left]).any(axis=1)]
        while len(left):
            slot[left] = (slot[left] + 1) & (self.slots - 1)
            out[left] = self.index[slot[left]]
            left = left[out[left] >= 0]
            left = left[(self.keys[slot[left]] != key[left]).any(axis=1)]
        return out

    def _insert(self, key: np.ndarray, hashed: np.ndarray, value: np.ndarray) -> None:
        slot = (hashed & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = left[self.index[slot[left]] < 0]
            self.index[slot[free]] = value[free]  # of several, one stays
            won = free[self.index[slot[free]] == value[free]]
            self.keys[slot[won]] = key[won]
            placed = np.zeros(len(key), bool)
            placed[won] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def _add(self, found: list[str]) -> np.ndarray:
        """Learn new words and give their value numbers."""
        data = self.learn(found)
        size = np.array([len(d) // 4 for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), "<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(found) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(found)] = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.size[self.n : self.n + len(found)] = size
        self.used, self.n = self.used + len(flat), self.n + len(found)
        return np.arange(self.n - len(found), self.n)

    def values(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Value number of each word data[start : start + size]."""
        if not len(start):
            return np.zeros(0, np.int64)
        text = lambda i: data[start[i] : start[i] + size[i]].tobytes().decode()
        if self.n > self.at_most:
            self.clear()
        padded = np.concatenate([data, np.zeros(WIDE, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        key = np.empty((len(start), 3), np.uint64)
        for k in range(3):
            there = np.clip(size - 8 * k, 0, 8).astype(np.uint64)
            # a shift by 64 isn't defined: whole words are taken as they are
            part = eight[np.minimum(start + 8 * k, len(eight) - 1)]
            key[:, k] = np.where(there == 8, part, part & ((np.uint64(1) << (there % np.uint64(8) * np.uint64(8))) - np.uint64(1)))
        hashed = self._hash(key)
        out = self._find(key, hashed).astype(np.int64)
        long = np.nonzero(size > WIDE)[0]
        out[long] = 0
        while len(new := np.nonzero(out < 0)[0]):
            new = new[np.unique(hashed[new], return_index=True)[1]]
            value = self._add([text(i) for i in new.tolist()])
            self._insert(key[new], hashed[new], value)
            again = np.nonzero(out < 0)[0]
            out[again] = self._find(key[again], hashed[again])
        if len(long):
            found = [text(i) for i in long.tolist()]
            fresh = list(dict.fromkeys(w for w in found if w not in self.long))
            if fresh:
                self.long.update(zip(fresh, self._add(fresh).tolist(), strict=True))
            out[long] = [self.long[w] for w in found]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = b" \n", marks: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids begin (one more place at the end).

        Words lie between separators; a word also ends between an ASCII letter and one of the marks after it."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        gap = np.zeros(256, bool)
        gap[list(separators)] = True
        gap = gap[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        cut = begins.copy()
        if marks:
            mark = np.zeros(256, bool)
            mark[list(marks)] = True
            cut[1:-1] |= mark[data[1:]] & _LETTER[data[:-1]]
        first = np.nonzero(~gap & (np.concatenate([[True], gap[:-1]]) | cut[:-1]))[0]
        end = np.nonzero(~gap & (np.concatenate([gap[1:], [True]]) | cut[1:]))[0] + 1
        ids, upto = self.gather(self.values(data, first, end - first))
        return ids, upto[np.searchsorted(first, offsets)]

    def gather(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by value number, one after another, and where each word's begin (one more place at the end)."""
        size = self.size[value]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(upto[-1]) + np.repeat(self.start[value] - upto[:-1], size)], upto
