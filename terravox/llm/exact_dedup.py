"""Exact deduplication by Patricia-trie owners.

Texts are normalised (null as empty, A-Z lower-cased) and keyed by byte length and content hash. Each map task
inserts whole byte strings into a compressed radix trie, whose terminals hold the best identifier and the number
of rows, and hands on one row for each distinct text it has seen; so a text that fills a third of the table is one
row a task before any shuffle. After the shuffle by (length, hash) the partial owners of a key arrive together and
go through a second trie, which compares full strings again: different texts with equal keys stay apart.

A trie has a budget of bytes. Beyond it, its largest subtree is spilled: those terminals leave as partial owners,
which a later stage merges like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, ids_of, join_groups, slices, texts, written


class Node:
    __slots__ = ("best", "count", "edges", "label")

    def __init__(self, label: bytes) -> None:
        self.label, self.edges, self.best, self.count = label, {}, None, 0


class PatriciaTrie:
    """Byte strings with an owner each. largest: which identifier of equal strings owns them; a null identifier owns only if there is no other."""

    def __init__(self, largest: bool = True, budget: int = 24 << 20) -> None:
        self.root, self.largest, self.budget, self.held = Node(b""), largest, budget, 0

    def better(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.largest else min(a, b)

    def insert(self, key: bytes, ident: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.best = ident if not node.count else self.better(node.best, ident)
                node.count += count
                return
            child = node.edges.get(key[at])
            if child is None:
                leaf = Node(key[at:])
                leaf.best, leaf.count = ident, count
                node.edges[key[at]] = leaf
                self.held += len(leaf.label) + 200
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_prefix(label, key, at)
            middle = Node(label[:shared])
            child.label = label[shared:]
            middle.edges[child.label[0]] = child
            node.edges[key[at]] = middle
            self.held += 200
            node, at = middle, at + shared

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            n, before = stack.pop()
            whole = before + n.label
            if n.count:
                yield whole, n.best, n.count
            stack += [(c, whole) for c in n.edges.values()]

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n.label) + 200
            stack += n.edges.values()
        return total

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Take out the heaviest subtree below the root, while the trie is over its budget."""
        while self.held > self.budget and self.root.edges:
            weights = {k: self.weight(c) for k, c in self.root.edges.items()}
            heaviest = max(weights, key=weights.get)
            yield from self.terminals(self.root.edges.pop(heaviest))
            self.held -= weights[heaviest]


def common_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of what label and key[at:] share, by halving: slices are compared in C."""
    low, high = 1, min(len(label), len(key) - at)
    if label[:high] == key[at : at + high]:
        return high
    while low < high - 1:
        half = (low + high) // 2
        if label[low:half] == key[at + low : at + half]:
            low = half
        else:
            high = half
    return low


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return b"" if text is None else text.encode().translate(LOWER_BYTES)


_OWNERS = "text_len long, text_hash long, body binary, best long, n long"


def _key(body: bytes) -> tuple[int, int]:
    return len(body), int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _partial(largest: bool):
    def run(batches):
        trie = PatriciaTrie(largest)

        def rows(found):
            block, held = [], 0
            for body, best, n in found:
                block.append((*_key(body), body, best, n))
                held += len(body)
                if held > 4 << 20:
                    yield _batch(block)
                    block, held = [], 0
            if block:
                yield _batch(block)

        for batch in batches:
            for part in slices(batch):
                for ident, text in zip(ids_of(part).to_pylist(), texts(ids_of(part, "text")).to_pylist(), strict=True):
                    trie.insert(text.encode().translate(LOWER_BYTES), ident)
                if trie.held > trie.budget:
                    yield from rows(trie.spill())
        yield from rows(trie.terminals())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["text_len", "text_hash", "body", "best", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _merged(largest: bool):
    """Over rows sorted by (text_len, text_hash): one trie for each run of equal keys."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches):
        at, trie, done = None, None, []

        def flush():
            if trie is not None:
                done.extend((hashlib.sha256(body).hexdigest(), best, n) for body, best, n in trie.terminals())

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            keys = list(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True))
            for i, key in enumerate(keys):
                if key != at:
                    flush()
                    at, trie = key, PatriciaTrie(largest)
                trie.insert(columns[2][i].as_py(), columns[3][i].as_py(), columns[4][i].as_py())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)
                done.clear()
        flush()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)

    return run


def owners(docs: DataFrame, largest: bool = True) -> DataFrame:
    """(text_sha256, keep_id, group_size): one row for each distinct normalised text of docs(doc_id, text, ...)."""
    partial = docs.select("doc_id", "text").mapInArrow(_partial(largest), _OWNERS)
    ordered = partial.repartition("text_len", "text_hash").sortWithinPartitions("text_len", "text_hash")
    return ordered.mapInArrow(_merged(largest), "text_sha256 string, keep_id long, group_size long")


def digest(text: str | F.Column = "text") -> F.Column:
    """SHA-256 of the normalised text, on the JVM: translate() lower-cases A-Z only."""
    lower = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.sha2(lower.cast("binary"), 256)


def exact_dedup(docs: DataFrame, largest: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts and equal to them; texts are compared whole, and a task holds 24 MB of them or the longest one. Of equal texts the largest doc_id is kept (the smallest with
    largest=False). Repeated rows with one doc_id and text each count and share their verdict. Rows without a doc_id
    count, but are kept only where the whole group has none. Empty tables give no rows; other columns are ignored.
    """
    return _verdicts(docs.select("doc_id", digest().alias("text_sha256")), docs, largest)


def _verdicts(mine: DataFrame, docs: DataFrame, largest: bool) -> DataFrame:
    """mine(doc_id, text_sha256) with the verdicts: only texts that several rows share are joined."""
    found = written(owners(docs, largest), "owners")
    shared = found.where("group_size > 1")
    total = found.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    out = join_groups(mine, shared, ["text_sha256"], "group_size", total, F.xxhash64("doc_id"))
    alone = F.col("group_size").isNull()
    keep, size = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of docs, all columns, that own their text.

    Rows without a doc_id stay; repeated rows of an owner stay too. A doc_id with several texts is judged for each of
    them. Null texts are empty ones; an empty table stays one. Columns may have any names."""
    gone = exact_dedup(docs, largest).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("_gone_id")) & (digest(docs["text"]) == F.col("_gone_sha")), "left_anti")
