"""Byte-level BPE: encoding and decoding by the ranks of a vocabulary file.

Lookup has two tiers. A minimal perfect hash over the vocabulary's byte strings resolves a whole pre-token that is
itself a token in one probe. What misses is merged: its bytes form a linked list, and a heap holds the ranks of
neighbouring pairs, so a pre-token of n bytes takes n log n steps however long it is. A bounded memo of spans of text
(a word with the space before it, a line feed, punctuation) stands in front of both tiers.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import ids_of, raw, slices
from .word_table import _LETTER, WordTable


class PerfectHash:
    """A minimal perfect hash (hash and displace) from byte strings to 0..n-1; absent keys give -1."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate([[0], np.cumsum(counts)])
        taken, self.seeds, slots = np.zeros(self.n, bool), [0] * self.buckets, np.zeros(self.n, np.int64)
        free = None
        for b in np.argsort(-counts, kind="stable"):
            members = order[first[b] : first[b + 1]]
            if not len(members):
                break
            if len(members) == 1:  # the rest take free places directly: a negative seed is the place
                if free is None:
                    free = iter(np.nonzero(~taken)[0].tolist())
                slot = next(free)
                self.seeds[b], slots[members[0]], taken[slot] = -slot - 1, slot, True
                continue
            own, seed = hashes[members].tolist(), 1
            while True:
                at = [self._place(h, seed) for h in own]
                if len(set(at)) == len(at) and not taken[at].any():
                    break
                seed += 1
            self.seeds[b], slots[members] = seed, at
            taken[at] = True
        self.keys: list[bytes] = [b""] * self.n
        self.index = [0] * self.n
        for i, slot in enumerate(slots.tolist()):
            self.keys[slot], self.index[slot] = keys[i], i

    def _place(self, h: int, seed: int) -> int:
        return (((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 29) % self.n

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        slot = -seed - 1 if seed < 0 else self._place(h, seed)
        return self.index[slot] if self.keys[slot] == key else -1


_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def odd_white_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: is there white space beside white space or at an end, or other than spaces and line feeds?"""
    white = _WHITE[data]
    both = np.zeros(len(data), bool)
    both[1:] = white[1:] & white[:-1]
    both |= white & (data != 32) & (data != 10)
    begins = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    both[begins] |= white[begins]
    both[ends] |= white[ends]
    # the same by bytes outside ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
    lead = np.nonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))[0]
    if len(lead):
        far = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = far[lead], far[lead + 1], far[lead + 2]
        there = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        there |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        both[lead[there]] = True
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.nonzero(both)[0], side="right") - 1] = True
    return out


#: Fixed value: the pre-token pattern of which it is known that no match crosses the spans of encode_batch().
SPANS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """encode() and decode() as the tiktoken library's encode_ordinary() and decode_bytes()."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 200_000) -> None:
        self.pattern, self.at_most, self.spans = regex.compile(pattern), memo, pattern == SPANS
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.hash, self.ids = PerfectHash(tokens), [ranks[t] for t in tokens]
        # (id, id) -> id of the merge; a pair merges by the rank of what it makes
        self.merges = ranks
        self.pieces: dict[str, bytes] = {}
        self.table = WordTable(self._learn)
        self.bytes_of = [b""] * (max(self.ids, default=-1) + 1)
        for t in tokens:
            self.bytes_of[ranks[t]] = t
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]

    def pretoken(self, piece: bytes) -> list[int]:
        whole = self.hash.find(piece)
        return [self.ids[whole]] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals: a heap of (rank, place) over bytes linked to their neighbours."""
        rank, n = self.merges.get, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j] = left + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = parts[i] + parts[k]
                if (r := rank(pair)) is not None:
                    heapq.heappush(heap, (r, i, len(pair)))
            if (k := before[i]) >= 0:
                pair = parts[k] + parts[i]
                if (r := rank(pair)) is not None:
                    heapq.heappush(heap, (r, k, len(pair)))
        return [rank(p) for p in parts if p is not None]

    def _piece(self, piece: str) -> bytes:
        out = np.array(self.pretoken(piece.encode()), "<u4").tobytes()
        if len(piece) < 64:
            if len(self.pieces) >= self.at_most:
                for k in list(islice(self.pieces, self.at_most // 4)):  # the oldest quarter goes
                    del self.pieces[k]
            self.pieces[piece] = out
        return out

    def _whole(self, text: str) -> list[bytes]:
        """Ids of each pre-token, by a memo of their own: many spans differ only in punctuation."""
        get, new = self.pieces.get, self._piece
        return [get(p) or new(p) for p in self.pattern.findall(text)]

    def _learn(self, spans: list[str]) -> list[bytes]:
        return [b"".join(self._whole(s)) for s in spans]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._whole(text)), "<u4")

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (one more place at the end).

        Texts are cut into spans that no pre-token crosses: before a space that stands alone between other characters,
        around a line feed that does, and between an ASCII letter and a full stop or comma. Spans are looked up in a
        table of their bytes. Texts with white space next to white space, at an end or outside ASCII go as a whole, and
        so do all texts where the pattern isn't SPANS.
        """
        data, offsets = raw(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        odd = odd_white_space(data, offsets) if self.spans else np.ones(n, bool)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        line = data == 10
        start = begins[:-1] | (data == 32) | line
        start[1:] |= line[:-1] | (_MARK[data[1:]] & _LETTER[data[:-1]])
        at = np.nonzero(start)[0]
        owner = np.searchsorted(offsets, at, side="right") - 1
        size = np.diff(np.append(at, len(data)))
        plain = ~odd[owner]
        ids, upto = self.table.gather(self.table.values(data, at[plain], size[plain]))
        count = np.bincount(owner[plain], weights=np.diff(upto), minlength=n).astype(np.int64)
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(count)])
        parts, done = [], 0
        for i in range(n):
            if odd[i]:
                own = self.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode())
                count[i] = len(own)
                parts.append(own)
            else:
                parts.append(ids[done : done + count[i]])
                done += count[i]
        return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum(count)])

    def shown(self, ids: np.ndarray) -> bytes:
        """Decimal ids with one space between."""
        return b" ".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """Once a Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return ByteBPE(ranks, pattern)


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing; long texts are encoded whole (about 30 times a text's
    bytes at once). Other columns are ignored, whatever their names. vocabulary is a file of base64 tokens and ranks
    that every executor has at that path. Repeated rows are encoded each; empty tables give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch):
                n, ids_sha, text_sha = [], [], []
                flat, begin = coder.encode_batch(ids_of(part, "text"))
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    ids = flat[a:b]
                    n.append(b - a)
                    ids_sha.append(hashlib.sha256(coder.shown(ids)).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([ids_of(part), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
