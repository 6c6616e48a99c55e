"""What Arrow batches go through in Python workers; this module makes no Columns, so a worker can import it without a session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

#: Edges of which one task finds the components at once.
SMALL = 1_000_000


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v), SMALL at a time, as stars: every node of a piece hangs on the piece's smallest."""
    above: dict = {}

    def top(i):
        while (j := above.get(i, i)) != i:
            above[i] = i = above.get(j, j)
        return i

    def done() -> pa.RecordBatch:
        pairs = [(i, top(i)) for i in list(above)]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.types[k]) for k in (0, 1)], ["u", "v"])

    schema, held = None, 0
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held > SMALL:
            yield done()
            held = 0
    if above:
        yield done()


def envelope(at: list[int], height: list[float], far: float) -> tuple[list[float], list[int]]:
    """For each place of a line: least height[i] + (place - at[i])^2 over sources lower than far (far if there is none), and that source's number (-1)."""
    hull: list[int] = []
    begin: list[float] = []  # where each parabola of the hull becomes the lowest
    for i, (x, h) in enumerate(zip(at, height, strict=True)):
        if h >= far:
            continue
        s = float("-inf")
        while hull:
            j = hull[-1]
            s = (h + x * x - height[j] - at[j] * at[j]) / (2 * (x - at[j]))
            if s > begin[-1]:
                break
            hull.pop()
            begin.pop()
            s = float("-inf")
        hull.append(i)
        begin.append(s)
    out, who, k = [], [], 0
    for x in at:
        while k + 1 < len(hull) and begin[k + 1] < x:
            k += 1
        found = hull[k] if hull else -1
        out.append(height[found] + (x - at[found]) ** 2 if hull else far)
        who.append(found)
    return out, who


def envelopes(others: list[str], axis: str, far: float):
    """Over rows sorted by line and place on it; a line may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
                cut = line_starts(held, others)
                if len(cut) > 1:
                    yield from solved(held.slice(0, cut[-1]), cut[:-1])
                    held = held.slice(cut[-1])
        if held is not None:
            yield from solved(held, line_starts(held, others))

    def solved(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        at, d2, take = table[axis].to_pylist(), table["d2"].to_pylist(), []
        out: list[float] = []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            best, who = envelope(at[a:b], d2[a:b], far)
            out += best
            take += [a + w if w >= 0 else None for w in who]
        table = table.combine_chunks()
        nearest = table["nearest"].take(pa.array(take, pa.int64()))
        table = table.set_column(table.schema.get_field_index("d2"), "d2", pa.array(out, pa.float64()))
        yield from table.set_column(table.schema.get_field_index("nearest"), "nearest", nearest).to_batches()

    return run


def line_starts(table: pa.Table, others: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in others:
        own = table[c].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.nonzero(new)[0].tolist()


def ears(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Triangles over one hole, ear by ear: the corner with the least angle inside the hole goes first."""
    after = dict(zip(pdf["b"].tolist(), pdf["a"].tolist(), strict=True))  # a hole is gone round against its faces
    place = {a: np.array(p) for a, p in zip(pdf["a"].tolist(), pdf[["x", "y", "z"]].to_numpy().tolist(), strict=True)}
    out: list[tuple[int, int, int]] = []
    start = min(after)
    loop, at = [start], after[start]
    while at != start and at in after and len(loop) <= len(after):
        loop.append(at)
        at = after[at]
    if at == start and len(set(loop)) == len(loop) == len(after):  # loops that meet in a vertex are left open
        points = np.array([place[i] for i in loop])
        across = np.cross(points, np.roll(points, -1, axis=0)).sum(axis=0)

        def angle(i: int) -> float:
            p, q, r = (place[loop[(i + d) % len(loop)]] for d in (-1, 0, 1))
            u, v = p - q, r - q
            size = np.linalg.norm(u) * np.linalg.norm(v)
            inner = float(np.arccos(np.clip(u @ v / size, -1, 1))) if size else 0.0
            return 2 * np.pi - inner if np.cross(v, u) @ across < 0 else inner

        while len(loop) > 3:
            i = min(range(len(loop)), key=lambda i: (round(angle(i), 12), loop[i]))
            out.append((loop[i - 1], loop[i], loop[(i + 1) % len(loop)]))
            loop.pop(i)
        out.append(tuple(loop))
    return pd.DataFrame([(key[0], n, *t) for n, t in enumerate(out)], columns=["hole", "n", "v0", "v1", "v2"])


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost; collinear points left out."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(q: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


#: Queries that are held against boxes at once; coordinates of one matrix of distances.
BLOCK, MATRIX = 256, 1 << 20


def places(batch: pa.RecordBatch, axes: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch[a].to_numpy(zero_copy_only=False).astype(float) for a in axes], axis=1).reshape(-1, len(axes))


def cells_of(p: np.ndarray, low: np.ndarray, side: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Numbers of cells, n along an axis (or each axis); what lies outside belongs to the outermost."""
    n = np.broadcast_to(n, p.shape[1])
    with np.errstate(all="ignore"):
        at = np.clip(np.nan_to_num((p - low) / side * n), 0, n - 1).astype(int)
    return at @ np.concatenate([[1], np.cumprod(n[:-1])]).astype(int)


def distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Every q to every p, added up axis by axis as SQL does."""
    with np.errstate(all="ignore"):
        d2 = np.zeros((len(q), len(p)))
        for a in range(q.shape[1]):
            d = q[:, a, None] - p[None, :, a]
            d2 += d * d
        return np.sqrt(d2)


def boxes_of(axes: tuple[str, ...], low: np.ndarray, side: np.ndarray, n: int):
    """A row for each cell that a task's points have: its box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full((n ** len(axes), len(axes)), np.inf), np.full((n ** len(axes), len(axes)), -np.inf)
        for batch in batches:
            p = places(batch, axes)
            cell = cells_of(p, low, side, n)
            np.minimum.at(least, cell, p)
            np.maximum.at(most, cell, p)
        own = np.nonzero(least[:, 0] < np.inf)[0]
        columns = [pa.array(own.astype(np.int32)), *(pa.array(x[own, a]) for x in (least, most) for a in range(len(axes)))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", *(f"{e}{a}" for e in ("low_", "high_") for a in axes)])

    return run


def with_cell(axes: tuple[str, ...], low: np.ndarray, side: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(cells_of(places(batch, axes), low, side, n).astype(np.int32)))

    return run


def outermost(axes: tuple[str, ...], directions: np.ndarray):
    """A task's furthest point in each direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full(len(directions), -np.inf), np.zeros((len(directions), len(axes)))
        for batch in batches:
            p = places(batch, axes)
            if not len(p):
                continue
            with np.errstate(all="ignore"):
                along = np.nan_to_num(p @ directions.T, nan=-np.inf)
            i = along.argmax(axis=0)
            top = along[i, np.arange(len(directions))]
            better = top > best
            best[better], at[better] = top[better], p[i[better]]
        own = np.nonzero(best > -np.inf)[0]
        columns = [pa.array(own.astype(np.int32)), pa.array(best[own]), *(pa.array(at[own, a]) for a in range(len(axes)))]
        yield pa.RecordBatch.from_arrays(columns, ["direction", "along", *axes])

    return run


def _reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At least the distance of each q to whatever lies in each box."""
    with np.errstate(all="ignore"):
        d2 = np.zeros((len(q), len(low)))
        for a in range(q.shape[1]):
            d = np.maximum(np.abs(q[:, a, None] - low[None, :, a]), np.abs(q[:, a, None] - high[None, :, a]))
            d2 += d * d
        return np.sqrt(d2) * (1 + 1e-12)


def _blocks(q: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray):
    """Blocks of near queries: their rows, a distance that each query's furthest point has at least, the boxes that can hold it for some of them, and how far those reach."""
    side = np.maximum(q.max(axis=0) - q.min(axis=0), 1e-300) if len(q) else np.ones(q.shape[1])
    order = np.argsort(cells_of(q, q.min(axis=0), side, 8), kind="stable") if len(q) else np.zeros(0, int)
    for at in range(0, len(q), BLOCK):
        rows = order[at : at + BLOCK]
        own = q[rows]
        floor = distances(own, known).max(axis=1)
        with np.errstate(all="ignore"):
            far = np.maximum(np.abs(own.max(axis=0) - low), np.abs(high - own.min(axis=0)))  # of the block's box
            boxes = np.nonzero(np.sqrt((far * far).sum(axis=1)) * (1 + 1e-9) >= floor.min())[0]
        reach = _reach(own, low[boxes], high[boxes])
        can = (reach >= floor[:, None]).any(axis=0)
        yield rows, floor, boxes[can], reach[:, can]


def far_boxes(axes: tuple[str, ...], number: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray):
    """Numbers of the boxes that can hold the furthest point of one of a task's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.zeros(len(number), bool)
        for batch in batches:
            for _, _, boxes, _ in _blocks(places(batch, axes), low, high, known):
                live[boxes] = True
        yield pa.RecordBatch.from_arrays([pa.array(number[live].astype(np.int32))], ["cell"])

    return run


def furthest_of(axes: tuple[str, ...], low: np.ndarray, high: np.ndarray, known: np.ndarray, held):
    """(query_id, point_id, distance) of the furthest point in boxes, ties to the smaller id.

    held: a broadcast of (first row of each box and their end, place of each row's id among all ids, ids, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rank, ids, p = held.value
        for batch in batches:
            q = places(batch, axes)
            best, who = np.full(len(q), -1.0), np.full(len(q), -1)
            for rows, floor, boxes, reach in _blocks(q, low, high, known):
                own, at_least = q[rows], floor.copy()
                with np.errstate(all="ignore"):
                    order = np.argsort(-reach.max(axis=0), kind="stable")
                at = 0
                while at < len(order):
                    part, size = [], 0  # boxes that go into one matrix; one alone may be larger
                    while at < len(order) and (not part or size + starts[boxes[order[at]] + 1] - starts[boxes[order[at]]] <= MATRIX // BLOCK):
                        k = order[at]
                        at += 1
                        if (reach[:, k] >= at_least).any():
                            part.append(boxes[k])
                            size += starts[boxes[k] + 1] - starts[boxes[k]]
                    points = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in part]) if part else np.zeros(0, int)
                    points = points[np.argsort(rank[points])]
                    for i in range(0, len(points), 4 * MATRIX // BLOCK):
                        some = points[i : i + 4 * MATRIX // BLOCK]
                        d = distances(own, p[some])
                        first = d.argmax(axis=1)
                        top, found = d[np.arange(len(own)), first], some[first]
                        better = (top > best[rows]) | (top == best[rows]) & (rank[found] < rank[who[rows]])
                        best[rows[better]], who[rows[better]] = top[better], found[better]
                    at_least = np.maximum(at_least, best[rows])
            kept = np.nonzero(who >= 0)[0]
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(kept)), ids.take(pa.array(who[kept])), pa.array(best[kept])], ["query_id", "point_id", "distance"])

    return run


class Views(NamedTuple):
    """Groups of images by bounds: a row each in low and high (place and direction), the least cosine, and an image of it (place, direction, cosine)."""

    low: np.ndarray
    high: np.ndarray
    cosine: np.ndarray
    one: np.ndarray


def view_scores(q: np.ndarray, images: np.ndarray) -> np.ndarray:
    """Centrality / distance^2 of each q in each image (place, direction, cosine), added up axis by axis as SQL does; -1 if it isn't seen."""
    with np.errstate(all="ignore"):
        depth, d2 = np.zeros((len(q), len(images))), np.zeros((len(q), len(images)))
        for a in range(3):
            off = q[:, a, None] - images[None, :, a]
            depth += off * images[None, :, 3 + a]
            d2 += off * off
        view = depth / np.sqrt(d2)
        return np.where((depth > 0) & (view >= images[None, :, 6]), view / d2, -1.0)


def _view_bound(low: np.ndarray, high: np.ndarray, v: Views, some=slice(None)) -> np.ndarray:
    """At least the score of whatever lies in each box of places in each image of a group; -1 if none sees it."""
    with np.errstate(all="ignore"):
        depth, d2 = np.zeros((len(low), len(v.low[some]))), np.zeros((len(low), len(v.low[some])))
        for a in range(3):
            near, far = low[:, a, None] - v.high[some, a], high[:, a, None] - v.low[some, a]
            least, most = v.low[some, 3 + a], v.high[some, 3 + a]
            depth += np.maximum(np.maximum(near * least, near * most), np.maximum(far * least, far * most))
            gap = np.maximum(0, np.maximum(near, -far))
            d2 += gap * gap
        view = np.where(d2 > 0, np.minimum(1.0, depth / np.sqrt(d2)), 1.0) * (1 + 1e-9)
        return np.where((depth > 0) & (view >= v.cosine[some]), np.where(d2 > 0, view / d2 * (1 + 1e-9), np.inf), -1.0)


def _view_blocks(q: np.ndarray, v: Views):
    """Blocks of near queries: their rows, a score that the best of each has at least, and groups by what they can reach, best first."""
    side = np.maximum(q.max(axis=0) - q.min(axis=0), 1e-300) if len(q) else np.ones(3)
    order = np.argsort(cells_of(q, q.min(axis=0), side, 8), kind="stable") if len(q) else np.zeros(0, int)
    for at in range(0, len(q), BLOCK // 4):
        rows = order[at : at + BLOCK // 4]
        own = q[rows]
        bound = _view_bound(own.min(axis=0)[None], own.max(axis=0)[None], v)[0]
        first = np.argsort(-bound, kind="stable")
        first, floor, i = first[bound[first] > 0], np.full(len(own), -1.0), 0
        while i < len(first) and bound[first[i]] >= floor.min():
            floor = np.maximum(floor, view_scores(own, v.one[first[i : i + 64]]).max(axis=1))
            i += 64
        yield rows, own, floor, first[bound[first] >= floor.min()]


def view_cells(number: np.ndarray, v: Views):
    """Numbers of the groups that can have the best view of one of a task's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.zeros(len(number), bool)
        for batch in batches:
            for _, own, floor, groups in _view_blocks(places(batch, ("x", "y", "z")), v):
                live[groups[(_view_bound(own, own, v, groups) >= floor[:, None]).any(axis=0)]] = True
        yield pa.RecordBatch.from_arrays([pa.array(number[live].astype(np.int32))], ["cell"])

    return run


def leaves(images: np.ndarray, most: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """An order of the images and the first row of each leaf (and their end): halved across the widest side of their places until `most` are left."""
    order, starts, todo = np.arange(len(images)), [], [(0, len(images))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
            continue
        p = images[order[a:b], :3]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(p[:, np.ptp(p, axis=0).argmax()], half)]
        todo += [(a, a + half), (a + half, b)]
    return order, np.append(np.sort(starts), len(images)).astype(int)


def best_views(v: Views, held):
    """(query_id, point_id, score) of the best of the images in held, ties to the smaller id, where no image of v is better.

    held: a broadcast of (first row of each leaf and their end, Views of the leaves, place of each row's id among all ids, ids, images)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, groups, rank, ids, images = held.value
        for batch in batches:
            q = places(batch, ("x", "y", "z"))
            best, who = np.full(len(q), -1.0), np.full(len(q), -1)
            for rows, own, floor, _ in _view_blocks(q, v):
                bound = _view_bound(own.min(axis=0)[None], own.max(axis=0)[None], groups)[0]
                first = np.argsort(-bound, kind="stable")
                first = first[(bound[first] > 0) & (bound[first] >= floor.min())]
                reach = _view_bound(own, own, groups, first)
                for i in range(0, len(first), 8):
                    if bound[first[i]] < floor.min():
                        break
                    can = first[i : i + 8][(reach[:, i : i + 8] >= floor[:, None]).any(axis=0)]
                    if not len(can):
                        continue
                    some = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in can])
                    some = some[np.argsort(rank[some])]
                    s = view_scores(own, images[some])
                    at = s.argmax(axis=1)
                    top, found = s[np.arange(len(own)), at], some[at]
                    better = (top > 0) & ((top > best[rows]) | (top == best[rows]) & (rank[found] < rank[who[rows]]))
                    best[rows[better]], who[rows[better]] = top[better], found[better]
                    floor = np.maximum(floor, best[rows])
            kept = np.nonzero(who >= 0)[0]
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(kept)), ids.take(pa.array(who[kept])), pa.array(best[kept])], ["query_id", "point_id", "score"])

    return run
