"""Near-duplicate detection by MinHash with an LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles, a MinHash signature and a 128-bit fingerprint of the set.
   Texts with equal sets are one node from here on, so thousands of copies cost one row.
2. Each of TREES trees is one sorted order of the nodes: by DEPTH signature values of its own. A range exchange sorts
   all trees at once; ties are split by identifier, so no prefix lands in one task. Neighbours with a common prefix of
   at least FIRST values are candidates. Where a prefix is crowded the region is cut at a deeper prefix, and again,
   until it has at most REGION nodes; a region that is crowded even at full depth (nearly equal texts) pairs each
   node with its next neighbours in that order only. The trees' orders differ, so such a group is still connected by
   many chains. Rows at partition edges are paired in a second pass.
3. A 128-bit sketch next to the order drops candidates that are far below the threshold (4.5 standard deviations).
4. What remains is confirmed on full sets computed again from the texts: first one pair for each node, then only
   pairs that the components so far don't already join. Components come from alternating stars.
5. Crowded regions are gone through once more, now with the components known: in each, every node outside the
   region's largest component meets all nodes of other components there on full sets, in chunks, so a text at the edge of a large group isn't lost to the few neighbours of step 2. The nodes of
   all regions with more than OUTSIDE such nodes are joined by rare shingles instead: two sets that are linked share
   a shingle among the rarest of each (prefix filter), so that loses no link either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, join_groups, mix, randoms, raw, slices, written
from .components import components
from .id_filter import thinned
from .words import shingles, words

TREES, DEPTH, FIRST, REGION, NEIGHBOURS = 20, 8, 4, 24, 2
#: Rows of a range partition of the forest.
ROWS = 150_000
#: Nodes outside the largest component of a crowded region that meet the whole region; beyond that the region goes through the prefix filter.
OUTSIDE = 4_096
#: Texts of a chunk that they meet at a time, and nodes with a rare shingle in common that are paired one by one.
CHUNK = 256
#: Sketch bits that may differ: 128 bits, of which a share (1 - similarity) / 2 differs on average.
SKETCH = 128


def sketch_limit(similarity: float) -> int:
    differ = (1 - similarity) / 2
    return int(np.ceil(SKETCH * differ + 4.5 * np.sqrt(SKETCH * differ * (1 - differ))))


_SIGNED = "doc_id long, body long, n_shingles long, set1 long, set2 long, signature binary, sketch1 long, sketch2 long"
_FACTORS = (randoms(2 * TREES * DEPTH, 23) >> np.uint64(32)).astype(np.uint32)
_FACTORS[::2] |= np.uint32(1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash values (16 bits each), set fingerprints (two 64-bit sums) and sketches (two 64-bit words) of sets that aren't empty."""
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    all_ = np.concatenate(sets)
    small = (all_ >> np.uint64(32)).astype(np.uint32)
    values = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for j in range(TREES * DEPTH):
        values[:, j] = np.minimum.reduceat(small * _FACTORS[2 * j] + _FACTORS[2 * j + 1], start)
    mixed = values * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    bits = np.packbits((mixed[:, :SKETCH] >> np.uint32(7) & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64)
    sums = np.stack([np.add.reduceat(mix(all_ + np.uint64(17)), start), np.add.reduceat(mix(all_ ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)], axis=1)
    return (mixed >> np.uint32(16)).astype(np.uint16), sums, bits


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingles(*words(*raw(ids_of(part, "text"))), k)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.nonzero(n)[0]
                signature, sums, bits = np.zeros((len(n), TREES * DEPTH), np.uint16), np.zeros((len(n), 2), np.uint64), np.zeros((len(n), 2), np.uint64)
                if len(full):
                    signature[full], sums[full], bits[full] = signatures([sets[i] for i in full.tolist()])
                cells = pa.array([r.tobytes() for r in signature], pa.binary())
                yield pa.RecordBatch.from_arrays([ids_of(part), ids_of(part, "body"), pa.array(n), *(pa.array(sums[:, i].view(np.int64)) for i in (0, 1)), cells, *(pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in (0, 1))], ["doc_id", "body", "n_shingles", "set1", "set2", "signature", "sketch1", "sketch2"])

    return run


_ROW = "tree int, key1 long, key2 long, node long, sketch1 long, sketch2 long"
_ORDER = ["tree", "key1", "key2", "node"]


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's rows in the trees: DEPTH values as two longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            n = part.num_rows
            values = np.frombuffer(b"".join(ids_of(part, "signature").to_pylist()), np.uint16).reshape(n, TREES, DEPTH)
            key = np.ascontiguousarray(values.transpose(1, 0, 2)).view(np.int64).reshape(TREES * n, 2)
            flat = lambda c: np.tile(ids_of(part, c).to_numpy(), TREES)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(flat("node")), pa.array(flat("sketch1")), pa.array(flat("sketch2"))], ["tree", "key1", "key2", "node", "sketch1", "sketch2"])


def neighbours(tree: np.ndarray, key1: np.ndarray, key2: np.ndarray, node: np.ndarray, sketch1: np.ndarray, sketch2: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller, larger) among rows sorted by (tree, key1, key2, node), and which rows are in crowded regions.

    The first and the last region may go on in other partitions and count as crowded."""
    n = len(node)
    if n < 2:
        return np.zeros((0, 2), np.int64), np.ones(n, bool)
    value = np.stack([key1, key2], axis=1).astype(np.int64).view(np.uint16).reshape(n, DEPTH)
    same = np.logical_and.accumulate((value[1:] == value[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1)
    common = np.concatenate([[0], same.sum(axis=1)])  # with the row before
    region, crowded, done = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    for depth in range(FIRST, DEPTH + 1):
        run = np.cumsum(common < depth) - 1
        size = np.bincount(run)[run]
        now = ~done & ((size <= REGION) | (depth == DEPTH))
        region[now], crowded[now], done[now] = run[now] + depth * n, size[now] > REGION, True
        if done.all():
            break
    wide = np.cumsum(common < FIRST)
    found = []
    for step in range(1, min(REGION, n)):
        near = (region[step:] == region[:-step]) & ~crowded[step:]
        if step <= NEIGHBOURS:
            near |= wide[step:] == wide[:-step]
        left = np.nonzero(near)[0]
        right = left + step
        differ = np.bitwise_count(sketch1[left] ^ sketch1[right]).astype(np.int64) + np.bitwise_count(sketch2[left] ^ sketch2[right])
        left, right = node[left[differ <= limit]], node[right[differ <= limit]]
        found.append(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1)[left != right])
    pairs = np.concatenate(found)
    full = (np.bincount(wide)[wide] > REGION) | (wide == wide[0]) | (wide == wide[-1])
    return np.unique(pairs, axis=0) if len(pairs) else pairs, full


_FOUND = "a long, b long, seam long, " + _ROW


def _candidates(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        column = pa.Table.from_batches(rows)
        values = [column[c].to_numpy().view(np.uint64) if c.startswith("sketch") else column[c].to_numpy() for c in column.column_names]
        pairs, crowded = neighbours(*values, limit)
        part, n = TaskContext.get().partitionId(), len(values[0])
        none = lambda k, t: pa.nulls(k, t)
        names = ["a", "b", "seam", *column.column_names]
        kinds = [f.type for f in column.schema]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(len(pairs), pa.int64()), *(none(len(pairs), t) for t in kinds)], names)
        full = column.filter(pa.array(crowded)).combine_chunks()
        if full.num_rows:
            yield pa.RecordBatch.from_arrays([*(none(full.num_rows, pa.int64()) for _ in range(3)), *(c.chunk(0) for c in full.columns)], names)
        # what may have neighbours in the partition before or after
        for seam, at in ((part - 1, slice(0, REGION)), (part, slice(max(0, n - REGION), n))):
            edge = column.slice(at.start, at.stop - at.start).combine_chunks()
            k = edge.num_rows
            yield pa.RecordBatch.from_arrays([none(k, pa.int64()), none(k, pa.int64()), pa.array(np.full(k, seam)), *(c.chunk(0) for c in edge.columns)], names)

    return run


def _seam(limit: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.select([c.split()[0] for c in _ROW.split(", ")]).sort_by([(c, "ascending") for c in _ORDER])
        pairs, _ = neighbours(*(table[c].to_numpy().view(np.uint64) if c.startswith("sketch") else table[c].to_numpy() for c in table.column_names), limit)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def forest(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a < b) of nodes(node, signature, sketch1, sketch2), and the tree rows of crowded regions."""
    limit = sketch_limit(similarity)
    planted = nodes.mapInArrow(_planted, _ROW)
    parts = max(1, -(-nodes.count() * TREES // ROWS))
    ordered = planted.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    found = written(ordered.mapInArrow(_candidates(limit), _FOUND), "forest")
    seams = found.where("seam is not null").groupBy("seam").applyInArrow(_seam(limit), "a long, b long")
    return found.where("a is not null").select("a", "b").union(seams).distinct(), found.where("a is null and seam is null").drop("a", "b", "seam")


def _met(k: int, similarity: int):
    """Over rows sorted by (tile, side): the texts of a chunk (side 0), then those that meet it (side 1), each against all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, index = None, [], None
        for batch in batches:
            for part in slices(batch):
                sets = shingles(*words(*raw(ids_of(part, "text"))), k)
                columns = [ids_of(part, c).to_pylist() for c in ("tree", "key1", "key2", "part", "side", "node", "own")]
                links = []
                for *at, side, node, own, found in zip(*columns, sets, strict=True):
                    if at != tile:
                        tile, chunk, index = at, [], None
                    if side == 0:
                        chunk.append((node, own, found))
                        continue
                    if not chunk:
                        continue
                    if index is None:
                        index = Chunk(chunk)
                    links += [(node, y) for y in index.linked(found, own, similarity)]
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


class Chunk:
    """An inverted index over the shingles of some texts."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        self.node = np.array([r[0] for r in rows], np.int64)
        self.own = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        every, owner = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.value, self.start = np.unique(every[order], return_index=True)
        self.end = np.append(self.start[1:], len(every))

    def linked(self, found: np.ndarray, own: int, similarity: int) -> list[int]:
        """A linked node of each other component."""
        if not len(found) or not len(self.value):
            return []
        at = np.minimum(np.searchsorted(self.value, found), len(self.value) - 1)
        at = at[self.value[at] == found]
        many = self.end[at] - self.start[at]
        place = np.arange(int(many.sum())) + np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        both = np.bincount(self.owner[place], minlength=len(self.node))
        hit = np.nonzero((both > 0) & (100 * both >= similarity * (self.size + len(found) - both)) & (self.own != own))[0]
        return self.node[hit[np.unique(self.own[hit], return_index=True)[1]]].tolist()


def _tiles(rows: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Rows for _met(): all nodes of a region dealt into chunks, and each node outside its largest component once for every chunk."""
    inside = rows.join(regions, key).withColumn("chunks", F.ceil(F.col("rows") / CHUNK))
    columns = lambda part, side: ["tree", "key1", "key2", part.alias("part"), F.lit(side).alias("side"), "node", "own"]
    dealt = inside.select(*columns(F.pmod(F.xxhash64("node"), "chunks"), 0))
    return dealt.union(inside.where("own <> largest").select(*columns(F.explode(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<long>")), 1)))


def _sized(rows: DataFrame, key: list[str]) -> DataFrame:
    """Regions with more than one component: their rows, largest component and nodes outside it."""
    sizes = rows.groupBy(*key, "own").agg(F.count("*").alias("n"))
    return sizes.groupBy(*key).agg(F.max_by("own", F.struct("n", "own")).alias("largest"), F.sum("n").alias("rows"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")


def _exploded(k: int):
    """Each node's shingles, one a row, with the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingles(*words(*raw(ids_of(part, "text"))), k)
                n = np.array([len(s) for s in sets], np.int64)
                repeated = [pa.array(np.repeat(c, n)) for c in (ids_of(part, "node").to_numpy(), ids_of(part, "own").to_numpy(), n)]
                yield pa.RecordBatch.from_arrays([*repeated, pa.array(np.concatenate(sets).view(np.int64))], ["node", "own", "size", "shingle"])

    return run


def by_rare_shingles(hot: DataFrame, bodies: DataFrame, k: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) and tiles that hold every link between different components of hot(node, own).

    With shingles in one order, rarest first, a set x shares at least ceil(s |x|) of its shingles with any set linked to
    it, so the first |x| - ceil(s |x|) + 1 of both have one in common. Nodes with a common first shingle are paired;
    where they are more than CHUNK they become a region of tiles instead, once for each distinct set of nodes."""
    each = hot.join(bodies, "node").mapInArrow(_exploded(k), "node long, own long, size long, shingle long")
    each = written(each, "hot-shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    needed = -F.floor(-F.col("size") * similarity / 100)  # ceil
    first = each.join(often, "shingle").withColumn("rank", rank).where((F.col("rank") <= F.col("size") - needed + 1) & (F.col("often") > 1))
    first = written(first.select("shingle", "node", "own", "size"), "hot-prefixes")
    sized = written(_sized(first, ["shingle"]), "hot-regions")
    few = first.join(sized.where(F.col("rows") <= CHUNK), "shingle").select("shingle", "node", "own", "size")
    left, right = (few.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "own", "size"))) for x in "ab")
    alike = (F.col("size_a") * 100 >= similarity * F.col("size_b")) & (F.col("size_b") * 100 >= similarity * F.col("size_a"))
    pairs = left.join(right, "shingle").where((F.col("node_a") < F.col("node_b")) & (F.col("own_a") != F.col("own_b")) & alike)
    many = first.join(sized.where(F.col("rows") > CHUNK), "shingle")
    # regions of the same nodes count once: equal sizes and equal sums of two hashes
    same = many.groupBy("shingle").agg(F.count("*").alias("n"), *(F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"sum{i}") for i in (1, 2)))
    once = same.groupBy("n", "sum1", "sum2").agg(F.min("shingle").alias("shingle")).select("shingle")
    keyed = lambda df: df.withColumns({"tree": F.lit(-1), "key1": F.col("shingle"), "key2": F.lit(0).cast("long")})
    tiles = _tiles(keyed(first), sized.where(F.col("rows") > CHUNK).join(once, "shingle", "left_semi"), ["shingle"])
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), tiles


def across(crowded: DataFrame, component: DataFrame, bodies: DataFrame, k: int, similarity: int) -> DataFrame:
    """Links (a, b) between different components in crowded regions. component: (node, component), not for every node.

    A region's nodes are dealt into chunks; each node outside its largest component meets every chunk, and the chunk's
    inverted index gives all its intersections at once. Only one link for each node, chunk and component comes out.
    Regions with more than OUTSIDE such nodes go through by_rare_shingles() together."""
    rows = crowded.join(component, "node", "left").select("tree", "key1", F.lit(0).cast("long").alias("key2"), "node", F.coalesce("component", "node").alias("own"))
    rows = written(rows, "crowded")
    wide = written(_sized(rows, ["tree", "key1"]), "crowded-regions")
    tiles, pairs = _tiles(rows, wide.where(F.col("outside") <= OUTSIDE), ["tree", "key1"]), None
    over = wide.where(F.col("outside") > OUTSIDE)
    if not over.isEmpty():
        hot = rows.join(over, ["tree", "key1"], "left_semi").select("node", "own").distinct()
        pairs, more = by_rare_shingles(hot, bodies, k, similarity)
        tiles = tiles.union(more)
    tile = ["tree", "key1", "key2", "part"]
    met = tiles.join(bodies, "node").repartition(*tile).sortWithinPartitions(*tile, "side")
    links = met.mapInArrow(_met(k, similarity), "a long, b long")
    return (links if pairs is None else links.union(confirmed(written(pairs, "hot-pairs"), bodies, k, similarity))).distinct()


def _confirm(k: int, similarity: int):
    """Over rows sorted by (a, b, nulls first): a's text comes first, then those of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            for part in slices(batch):
                sets = shingles(*words(*raw(ids_of(part, "text"))), k)
                links = []
                for a, b, own in zip(ids_of(part, "a").to_pylist(), ids_of(part, "b").to_pylist(), sets, strict=True):
                    if b is None:
                        at, mine = a, own
                    elif a == at and len(own) * 100 >= similarity * len(mine) and len(mine) * 100 >= similarity * len(own):
                        small, large = (own, mine) if len(own) < len(mine) else (mine, own)
                        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                        if both and 100 * both >= similarity * (len(own) + len(mine) - both):
                            links.append((a, b))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, bodies: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. bodies: (node, text) with every node of the pairs."""
    others = pairs.join(bodies, pairs["b"] == bodies["node"]).select("a", "b", "text")
    firsts = bodies.join(pairs.select("a").distinct(), bodies["node"] == F.col("a"), "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    together = firsts.union(others).repartition("a").sortWithinPartitions(F.col("a"), F.col("b").asc_nulls_first())
    return together.mapInArrow(_confirm(k, similarity), "a long, b long")


def classes(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * intersection >= similarity * union of their k-word shingle sets; component_id is the
    smallest doc_id that links reach, kept says whether it is the row's own. Null, empty and wordless texts have no
    shingles and no links; texts of fewer than k words have one shingle, all their words. Texts are read whole (about
    40 times a text's bytes at once). Repeated rows share their verdict; a doc_id with several texts has a verdict for
    each of them, and doesn't link one text's family with another's. Rows without a doc_id are linked with nothing:
    component_id is null and they are kept. Empty tables give no rows. Columns may have any names.
    """
    return _classes(docs, k, similarity).drop("body")


def _named(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows(doc_id, body, ...) with a name for each document: its doc_id, or a hash with its text where a doc_id has several texts."""
    if repeated is None:
        return rows.withColumn("name", F.col("doc_id"))
    marked = rows.join(repeated.withColumn("_several", F.lit(True)), "doc_id", "left")
    return marked.withColumn("name", F.when(F.col("_several"), F.xxhash64("doc_id", "body")).otherwise(F.col("doc_id"))).drop("_several")


def _classes(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """classes() with the text's 64-bit hash as body."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("body"), docs["text"].alias("text"))
    signed = written(own.mapInArrow(_signed(k), _SIGNED), "signed")
    texts = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    repeated = written(texts.where("low <> high").select("doc_id"), "repeated")
    repeated = None if repeated.isEmpty() else repeated
    own, signed = _named(own, repeated), _named(signed, repeated)

    real = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "set1", "set2"]
    groups = written(real.groupBy(*key).agg(F.min("name").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("members")), "sets")
    first = groups.select(F.col("node").alias("name"), *key)
    nodes = real.join(first, ["name", *key], "left_semi").select(F.col("name").alias("node"), "signature", "sketch1", "sketch2").dropDuplicates(["node"])
    nodes = written(nodes, "nodes")
    pairs, crowded = forest(nodes, similarity / 100)
    pairs = written(pairs, "pairs")

    ids = pairs.select(F.explode(F.array("a", "b")).alias("name")).union(crowded.select("node")).distinct()
    ids = written(ids, "ids")
    # of repeated rows one is enough
    bodies = thinned(own.select("name", "text"), "name", ids).join(ids, "name", "left_semi").select(F.col("name").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    bodies = written(bodies, "bodies")
    some = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    joined = components(confirmed(some, bodies, k, similarity))
    left, right = joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(some, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    # what is joined already goes on as stars, so the next components start near their end
    joined = components(joined.union(confirmed(rest, bodies, k, similarity)))
    whole = components(joined.union(across(crowded, joined, bodies, k, similarity)))

    found = groups.join(whole, "node", "left").select(*key, "least", "members", F.coalesce("component", "node").alias("component_id"))
    if repeated is not None:  # names aren't identifiers: the smallest of these in a component
        least = found.groupBy("component_id").agg(F.min("least").alias("smallest"))
        found = found.join(least, "component_id").select(*key, "members", F.col("smallest").alias("component_id"))
    found = found.select(*key, "members", "component_id")
    total = groups.agg(F.sum("members").alias("n")).first()["n"] or 0
    out = join_groups(signed.select("doc_id", "body", *key), found, key, "members", total, F.xxhash64("doc_id", "body"), F.col("n_shingles") == 0)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "body", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first_of_each(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are the smallest doc_id of their component.

    Rows without a doc_id or without words stay, and so do all repeated rows of a document that stays; a doc_id with
    several texts is judged for each of them. An empty table stays one. Columns may have any names."""
    gone = _classes(docs, k, similarity).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("body").alias("_gone_body")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("_gone_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_gone_body")), "left_anti")
