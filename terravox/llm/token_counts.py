"""Exact token counts of a piece BPE model at every prefix, by dynamic programming over last tokens.

A BPE encoding of a prefix ends in exactly one token, and two tokens can stand side by side only if encoding their
joined text gives just these two. So the encoding of each prefix follows from shorter ones: of the tokens that the
prefix ends in, the last one is that whose left neighbour (the last token of the rest) may stand before it. One
table holds the count at every prefix; how many tokens a text has, where it must be cut for a budget and whether a
prefix fits are look-ups in it.

Text is cut before each run of spaces (U+2581 in the model) that follows another character: no piece of these models
has one inside, so no merge crosses and counts of the parts add up. Counts of such words are kept in a bounded memo.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_of, slices, texts

SPACE = "▁"

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class PieceBPE:
    """Counts for a sentencepiece BPE model with the identity normaliser, byte fallback and a dummy prefix."""

    def __init__(self, model: bytes, memo: int = 800_000) -> None:
        self.rank: dict[str, float] = {}
        self.at_most, self.memo = memo, {}
        self.bytes = False
        self.prefix = True
        spec: dict[int, bytes | int] = {}
        for field, value in _fields(model):
            if field == 1:
                f = dict(_fields(value))
                kind = f.get(3, NORMAL)
                if kind == NORMAL:
                    self.rank[f[1].decode()] = -float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0])
                elif kind == BYTE:
                    self.bytes = True
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces aren't supported")
            elif field == 3:
                spec = dict(_fields(value))
        self.prefix = bool(spec.get(3, 1))
        if spec.get(2) or spec.get(4, 1):
            raise ValueError("only models that leave the text as it is are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has a space inside")
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.lines = all("\n" not in p for p in self.rank)
        self.fits_memo: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the best pair first, leftmost of equals. Decides which tokens may be neighbours."""
        rank, n = self.rank.get, len(text)
        parts: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
                continue
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
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """May right follow left? Only if together they encode to themselves."""
        key = (left, right)
        out = self.fits_memo.get(key)
        if out is None:
            if len(self.fits_memo) >= 400_000:
                self.fits_memo.clear()
            out = self.fits_memo[key] = self.merged(left + right) == [left, right]
        return out

    @lru_cache(maxsize=200_000)  # noqa: B019  one model lives as long as its worker
    def alone(self, token: str) -> bool:
        """Is the token's own encoding the token?"""
        return self.merged(token) == [token]

    def cost(self, char: str) -> int:
        """Tokens of a character that is no piece: its UTF-8 bytes, or one unknown."""
        return len(char.encode()) if self.bytes else 1

    def word(self, text: str) -> list[int]:
        """Tokens at every prefix of a word (spaces as U+2581), 0 first.

        An automaton lists the pieces that end at each place, longest first. A character that is no piece is a token
        that no piece is merged with. Unknown characters of a model without byte pieces count one each.
        """
        n, done = len(text), 0
        counts, last = [0] * (n + 1), [""] * (n + 1)  # "": the beginning, or a character that is no piece
        known = self.fits_memo.get
        for end, token in self.automaton.iter(text):
            if end < done:
                continue  # a longer piece ends here
            while done < end:
                counts[done + 1], done = counts[done] + self.cost(text[done]), done + 1
            start = end + 1 - len(token)
            before = last[start]
            if before:
                fit = known((before, token))
                if fit is None:
                    fit = self.fits(before, token)
            else:
                fit = start == end or self.alone(token)
            if fit:
                done = end + 1
                counts[done], last[done] = counts[start] + 1, token
        while done < n:
            counts[done + 1], done = counts[done] + self.cost(text[done]), done + 1
        return counts

    def _count(self, word: str) -> int:
        out = self.word(word)[-1]
        if len(self.memo) >= self.at_most:
            for k in list(self.memo)[: self.at_most // 4]:
                del self.memo[k]
        if len(word) < 64:
            self.memo[word] = out
        return out

    def parts(self, text: str, prefix: bool | None = None) -> list[str]:
        """Words of a text with the spaces before them; the joined parts are the text as the model sees it."""
        words = text.replace(" ", SPACE).split(SPACE)
        if not (self.prefix if prefix is None else prefix):
            head = words.pop(0)
            parts = [head] if head else []
        else:
            parts = []
        if not words:
            return parts
        if "" not in words:
            return parts + [SPACE + w for w in words]
        spaces = ""
        for w in words:
            spaces += SPACE
            if w:
                parts.append(spaces + w)
                spaces = ""
        return parts + [spaces] if spaces else parts

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.lines and "\n" in text:  # a line feed is no piece: nothing merges across it
            first, *lines = text.split("\n")
            out = self._sum(self.parts(first)) + len(lines) * self.cost("\n")
            return out + sum(self._sum(self.parts(line, False)) for line in lines)
        return self._sum(self.parts(text))

    def _sum(self, words: list[str]) -> int:
        found = list(map(self.memo.get, words))
        if None in found:
            found = [self._count(w) if n is None else n for w, n in zip(words, found, strict=True)]
        return sum(found)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        out = [0]
        if not text:
            return np.zeros(1, np.int64)
        done = 0
        for word in self.parts(text):
            own = self.word(word)
            out += [done + c for c in own[1:]]
            done += own[-1]
        if self.prefix:  # the model's own space in front is no character of the text
            out = [0, *out[2:]]
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most so many tokens, without encoding again."""
        fits = np.nonzero(self.prefix_counts(text) <= budget)[0]
        return text[: int(fits[-1])] if len(fits) else ""


@lru_cache(maxsize=4)
def load(path: str) -> PieceBPE:
    """Once a Python worker."""
    with open(path, "rb") as f:
        return PieceBPE(f.read())


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; long texts are counted whole (about 100 times a text's bytes at
    once). Other columns are ignored, whatever their names. Repeated rows are counted each; empty tables give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        for batch in batches:
            for part in slices(batch):
                found = texts(ids_of(part, "text")).to_pylist()
                n = np.array([coder.count(t) for t in found], np.int64)
                size = pa.array([len(t.encode()) for t in found], pa.int64())
                yield pa.RecordBatch.from_arrays([ids_of(part), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
