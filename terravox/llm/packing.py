"""Packing token pieces into sequences: bin completion with branch and bound.

Bins are filled around the largest piece that is left. A depth-first search enumerates fillings of what it leaves
free, by length (pieces of one length are interchangeable) and longest pieces first. A filling is dominated, and
dropped, if a piece that is left would still fit, or if one that is left could stand in for some of its pieces and fill
the bin better. The others are tried by rising waste.

Best-fit decreasing gives the first incumbent, and a bound on sums and on large pieces says when nothing is better. A
packing in as few bins as the incumbent may waste only so much: a filling with which the waste so far goes beyond that
is cut, and the search goes back to the next filling of the bin before. Each packing that is found is the new
incumbent, and the next has to save a bin. The search has NODES nodes a piece; what the incumbent is by then stays, so a
block never takes more bins than by best fit.

Rows are dealt to blocks of a bounded number of pieces, each packed on its own; a block wastes less than it would
with its neighbours only in its last few sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ids_of, mix, raw, slices
from .word_table import WordTable

SEQUENCE = 4096
#: Documents of a block on average; nodes of the search for one filling, fillings of a bin that are kept, and nodes for each piece of a block (a small block has MORE).
BLOCK, FILLING, KEPT, NODES, MORE = 20_000, 300, 12, 30, 30_000


class Stock:
    """How many pieces there are of each length; bit n of `present` says whether there is any of length n."""

    def __init__(self, counts: np.ndarray) -> None:
        self.count = counts.tolist()
        self.present = int.from_bytes(np.packbits(counts > 0, bitorder="little").tobytes(), "little")

    def at_most(self, n: int) -> int:
        """The largest length up to n, 0 if there is none (bit 0 stands for that)."""
        return (self.present & ((2 << n) - 1)).bit_length() - 1

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.present ^= 1 << n

    def give(self, n: int) -> None:
        if not self.count[n]:
            self.present ^= 1 << n
        self.count[n] += 1


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins by best-fit decreasing: each piece, largest first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms = 0
    for n in range(capacity, 0, -1):
        for _ in range(int(counts[n])):
            if fits := rooms >> n:
                room = n + (fits & -fits).bit_length() - 1
                own = free[room].pop()
                if not free[room]:
                    rooms ^= 1 << room
            else:
                room, own = capacity, len(bins)
                bins.append([])
            bins[own].append(n)
            room -= n
            if room:
                free[room].append(own)
                rooms |= 1 << room
    return bins


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: for each length k, pieces over capacity - k are alone, those over half can't meet, and pieces from k to half share what room these leave."""
    n = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * n)
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = number[capacity] - number[capacity - k]
    large, sum_large = number[capacity - k] - number[half], total[capacity - k] - total[half]
    sum_small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int((alone + large + np.maximum(0, -((large * capacity - sum_large - sum_small) // capacity))).max())


def dominated(filling: list[int], room: int, present: int) -> bool:
    """Could a piece that is left replace some pieces of the filling and leave less room (or the same room, for several pieces)?"""
    single = several = 0
    for n in filling:
        several |= (single | several) << n
        single |= 1 << n
    if several & present:
        return True
    every, width = (single | several) << 1, 1
    if not room:
        return False
    while width < room:
        step = min(width, room - width)
        every |= every << step
        width += step
    return bool(every & present)


def fillings(stock: Stock, free: int, waste: int, nodes: int = FILLING) -> tuple[list[list[int]], int]:
    """Undominated fillings of `free` that leave at most `waste`, least room first, and the nodes that were visited.

    The search ends early once it has a perfect one; where it ends for lack of nodes, a dominated one may be the best."""
    found: list[tuple[int, list[int]]] = []
    other: tuple[int, list[int]] = (waste + 1, [])
    chosen: list[tuple[int, int]] = []
    left, perfect = nodes, False

    def keep(room: int) -> None:
        nonlocal other, perfect
        present, own = stock.present, [n for n, k in chosen for _ in range(k)]
        for n, k in chosen:
            if stock.count[n] == k:
                present ^= 1 << n
        if not dominated(own, room, present):
            found.append((room, own))
            perfect = perfect or not room
        elif room < other[0]:
            other = (room, own)

    def search(room: int, top: int, skipped: int) -> None:
        """skipped: the smallest length of which one more would have fitted; a filling that has room for it is dominated."""
        nonlocal left
        n = stock.at_most(min(room, top))
        if not n and room <= waste and room < skipped:
            keep(room)
        while n:
            most = min(stock.count[n], room // n)
            for k in range(most, 0, -1):
                left -= 1
                chosen.append((n, k))
                search(room - k * n, n - 1, skipped if k == most else min(skipped, n))
                chosen.pop()
                if left <= 0 or (perfect and left < nodes - 60):
                    return
            skipped = min(skipped, n)
            n = stock.at_most(n - 1)

    search(free, free, free + 1)
    if not found or other[0] < min(found)[0]:  # what dominates it lies beyond the nodes
        found.append(other) if other[0] <= waste else None
    return [f for _, f in sorted(found, key=lambda f: f[0])[:KEPT]], nodes - left


def complete(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of lengths, never more than best-fit decreasing makes."""
    counts, whole = np.bincount(sizes, minlength=capacity + 1), int(sizes.sum())
    best, bound = best_fit(counts, capacity), least_bins(counts, capacity)
    goal, nodes = len(best), NODES * len(sizes) + MORE
    while goal >= bound and len(sizes):
        bins, used = _search(Stock(counts), capacity, goal * capacity - whole, nodes)
        nodes -= used
        if bins is None:
            break
        best, goal = bins, len(bins) - 1
    return best


def _search(stock: Stock, capacity: int, waste: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """A packing that leaves at most `waste` free in all, or None if the nodes run out or there is none among the fillings kept."""
    stock.present |= 1  # the end of every look-up
    path: list[tuple[list[list[int]], int, int]] = []  # fillings of each bin yet to be tried, the one in use, waste before the bin
    bins: list[list[int]] = []
    given = nodes

    def back() -> bool:
        """Undo bins until one has another filling, and use that."""
        nonlocal waste
        while path:
            ways, at, before = path.pop()
            own = bins.pop()
            for n in own[1:]:
                stock.give(n)
            if at + 1 < len(ways):
                use(own[0], ways, at + 1, before)
                return True
            stock.give(own[0])
            waste = before
        return False

    def use(n: int, ways: list[list[int]], at: int, before: int) -> None:
        nonlocal waste
        for m in ways[at]:
            stock.take(m)
        bins.append([n, *ways[at]])
        path.append((ways, at, before))
        waste = before - (capacity - n - sum(ways[at]))

    while n := stock.at_most(capacity):
        if nodes <= 0:
            return None, given
        stock.take(n)
        ways, used = fillings(stock, capacity - n, waste, min(FILLING, nodes)) if n < capacity else ([[]], 1)
        nodes -= used + 1
        if ways:
            use(n, ways, 0, waste)
            continue
        stock.give(n)
        if not back():
            return None, given - nodes
    return bins, given - nodes


def pack(sizes: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are 1 to capacity long."""
    sizes = np.asarray(sizes, np.int64)
    bins = complete(sizes, capacity)
    # deal pieces of each length to the places that ask for it
    order = np.argsort(sizes, kind="stable")
    places = np.array([(n, b, o) for b, own in enumerate(bins) for n, o in zip(own, np.cumsum([0, *own[:-1]]).tolist(), strict=True)], np.int64).reshape(-1, 3)
    by = np.argsort(places[:, 0], kind="stable")
    out_bin, out_at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    out_bin[order], out_at[order] = places[by, 1], places[by, 2]
    return out_bin, out_at


#: Chunks whose pre-tokens are found here: visible ASCII and Latin letters, where NFC and lower-casing are one character to one.
_PLAIN = regex.compile(r"[!-~¡-¬®-įı-ň]*")
#: The tokenizer file's own pattern, for lower-cased chunks without white space.
_PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Ids:
    """Token ids of texts by the tokenizers library, remembered for chunks between spaces and line feeds.

    The library's pre-tokenizer never crosses white space, nor goes from a letter to a full stop or comma, so the ids of
    a text are those of its chunks; it lower-cases, so A-Z may be lower-cased before. Chunks of plain characters are cut into pre-tokens, which have a memo of their own (many chunks differ only in case and
    punctuation); new ones go to the library together, with spaces between, and are told apart by their word ends.
    Other chunks go to the library as they are.
    """

    def __init__(self, path: str, memo: int = 150_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.at_most = Tokenizer.from_file(path), memo
        # lower-case ASCII words are whole pre-tokens already: the same model without the steps before it
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.specials = re.compile(b"|".join(re.escape(t.encode()) for t in self.special) or b"(?!)")
        self.table = WordTable(self.learn, 500_000)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        data, offsets = raw(column)
        low = LOWER[data]
        for found in self.specials.finditer(low):  # only lower-casing makes some of these special: those stay as they are
            low[found.start() : found.end()] = data[found.start() : found.end()]
        return self.table.encode(low, offsets, marks=b".,")

    def learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian unsigned 32-bit numbers."""
        plain = {c: [c] if c.isascii() and c.isalpha() else _PRETOKENS.findall(c.lower()) for c in fresh if _PLAIN.fullmatch(c) and not ("<" in c and any(t in c for t in self.special))}
        if len(self.words) > self.at_most:
            self.words = {c: self.words[c] for c in list(self.words)[-(self.at_most // 2) :]}
        new = list(set().union(*plain.values()).difference(self.words))
        letters = [w for w in new if w.isascii() and w.isalpha()]
        self._learn(letters, self.letters)
        self._learn([w for w in new if not (w.isascii() and w.isalpha())], self.tokenizer)
        get = self.words.__getitem__
        done = {c: get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for c, ws in plain.items()}
        rest = [c for c in fresh if c not in done]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            done[c] = np.array(e.ids, "<u4").tobytes()
        return [done[c] for c in fresh]

    def _learn(self, new: list[str], tokenizer) -> None:
        """Many pre-tokens in one call, with spaces between."""
        for i in range(0, len(new), 2048):
            some = new[i : i + 2048]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.nonzero(self.ends[ids])[0] + 1
            if len(cut) != len(some):  # a word end inside a pre-token: not in this vocabulary
                raise ValueError("word ends don't match the pre-tokens")
            data, at = ids.tobytes(), 0
            for w, end in zip(some, (cut * 4).tolist(), strict=True):
                self.words[w], at = data[at:end], end


@lru_cache(maxsize=4)
def load(path: str) -> Ids:
    """Once a Python worker."""
    return Ids(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long"


def pieces(docs: DataFrame, tokenizer: str, blocks: int, capacity: int = SEQUENCE, end: int = 1) -> DataFrame:
    """Pieces of each document's ids with the end id after them, each piece with a block to be packed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = load(tokenizer), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                ids, begin = coder.encode(ids_of(part, "text"))
                data, out = ids.astype("<u4").tobytes(), []
                for ident, a, b in zip(ids_of(part).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    own = data[4 * a : 4 * b] + last
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        out.append((ident, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                # by place, not by content: copies spread over the blocks like other rows
                block = (mix(np.arange(row, row + len(out), dtype=np.uint64)) % np.uint64(blocks)).astype(np.int64)
                row += len(out)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block)], ["doc_id", "piece", "start", "length", "ids_crc32", "block"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end: int = 1) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: none) and the end id; only documents longer than capacity are cut.
    Offsets in a sequence are gapless from 0. Long texts are encoded whole (about 30 times a text's bytes at once), ties
    between pieces of one length don't matter, other columns are ignored, whatever their names. Repeated rows are packed each; an empty table gives no rows. A document
    without a doc_id is packed like others. sequence_id is the block's number times 2^32 plus the place in it.
    """
    blocks = max(1, round(docs.select("doc_id").count() / BLOCK))

    def run(table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        block = int(table["block"][0].as_py())
        sequence, offset = pack(size, capacity)
        return table.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence + (block << 32))).append_column("offset", pa.array(offset))

    return pieces(docs, tokenizer, blocks, capacity, end).groupBy("block").applyInArrow(run, _PIECES.replace("block long", "sequence_id long, offset long"))
