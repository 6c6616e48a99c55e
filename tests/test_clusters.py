"""Clusters, planes, axes and depth normals against plain code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravox.registry import Later

align, cluster, depth = (Later(f"operators.{n}") for n in ("align", "cluster", "depth"))

RNG = np.random.default_rng(7)
BLOBS = np.concatenate([RNG.normal(c, 0.05, (40, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 1))])


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(pd.DataFrame(BLOBS, columns=list("xyz")).assign(surfel_id=np.arange(len(BLOBS))))


def test_kmeans_is_a_fixed_point_of_its_iteration(points):
    got = cluster.kmeans(points, 3, 50).orderBy("surfel_id").toPandas()["cluster"].to_numpy()
    centres = np.stack([BLOBS[got == i].mean(axis=0) for i in sorted(set(got))])
    assert (((BLOBS[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == np.searchsorted(sorted(set(got)), got)).all()


def test_kmeans_by_rounds_against_plain_code(points):
    ids = [r[0] for r in points.orderBy(F.xxhash64(F.col("surfel_id"), F.lit(5))).select("surfel_id").limit(4).collect()]
    centres = BLOBS[ids].copy()
    for _ in range(3):
        near = ((BLOBS[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([BLOBS[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(4)])
    near = ((BLOBS[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    got = cluster.kmeans(points, 4, 3, 5).orderBy("surfel_id").toPandas()["cluster"].to_numpy()
    assert (got == near).all()


def test_region_growing_is_components_over_strong_edges(spark):
    a, b, s = RNG.integers(0, 60, 80), RNG.integers(0, 60, 80), RNG.random(80)
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    strong = [(int(x), int(y)) for x, y, w in zip(a, b, s, strict=True) if w >= 0.4 and x != y]
    for x, y in strong:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    edges = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "affinity": s}))
    got = {r.node: r.component for r in cluster.region_growing(edges, 0.4).collect()}
    assert got == {i: find(i) for i in {v for e in strong for v in e}}


def test_refine_takes_the_majority_of_neighbours(spark):
    n = 30
    label = RNG.integers(0, 3, n)
    edges = sorted({(int(a), int(b)) for a, b in RNG.integers(0, n, (120, 2)) if a != b} | {(0, 1)})
    want = {}
    for i in range(n):
        near = [label[b] for a, b in edges if a == i]
        best = max(range(3), key=near.count)
        want[i] = best if near and 2 * near.count(best) > len(near) else label[i]
    got = cluster.refine(spark.createDataFrame(pd.DataFrame({"surfel_id": range(n), "cluster": label})), spark.createDataFrame(edges, "a long, b long"))
    assert {r.surfel_id: r.cluster for r in got.collect()} == want


def test_small_clusters_merge_and_large_ones_stay(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aaabccdddd")], "surfel_id long, cluster string")
    assert "".join(r.cluster for r in cluster.merge_small(rows, 3).orderBy("surfel_id").collect()) == "aaabbbdddd"
    assert {r.surfel_id for r in cluster.keep_largest(rows, 2).collect()} == {0, 1, 2, 6, 7, 8, 9}


def test_mean_shift_against_plain_code(spark):
    shape = (6, 5, 4)
    v = np.maximum(RNG.normal(0, 1, shape), 0)
    v[0] = 0
    to = {}
    for c in np.ndindex(shape):
        near = [(p, v[p] * np.exp(-sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) / 2)) for p in np.ndindex(shape) if max(abs(a - b) for a, b in zip(p, c, strict=True)) <= 2]
        total = sum(w for _, w in near)
        to[c] = tuple(min(max(int(sum(w * p[k] for p, w in near) / total + 0.5), 0), shape[k] - 1) for k in range(3)) if total > 0 else c

    def rest(c):
        seen = []
        while c not in seen:
            seen.append(c)
            c = to[c]
        return {np.ravel_multi_index(p, shape) for p in seen[seen.index(c) :]}

    rows = pd.DataFrame([(1, *c, v[c]) for c in np.ndindex(shape)], columns=["grid_id", "ix", "iy", "iz", "value"]).astype({"grid_id": "int32", "ix": "int32", "iy": "int32", "iz": "int32"})
    for r in cluster.mean_shift(spark.createDataFrame(rows), shape).collect():
        assert r.cluster in rest((r.ix, r.iy, r.iz)), r


def test_axes_and_plane_against_singular_vectors(spark):
    turn, _ = np.linalg.qr(RNG.normal(size=(3, 3)))
    p = RNG.normal(size=(200, 3)) * (3, 1, 0.01) @ turn + (1, 2, 3)
    df = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")))
    mean, axes, values = align.principal_axes(df)
    _, s, want = np.linalg.svd(p - p.mean(axis=0))
    assert np.allclose(mean, p.mean(axis=0)) and np.allclose(np.abs((axes * want).sum(axis=1)), 1) and np.allclose(values, s**2 / len(p))
    for i in range(2):
        assert np.sign(p @ axes[i]).sum() >= 0
    normal, d = align.fit_plane(df)
    assert normal[2] >= 0 and np.allclose(abs(normal @ want[2]), 1) and np.isclose(normal @ p.mean(axis=0) + d, 0)


def test_depth_normals_against_plain_code(spark):
    d = 2 + RNG.random((5, 6))
    d[2, 3] = 0
    at = {(x, y): (np.array([(x - 2.5) * d[y, x] / 4, (y - 2) * d[y, x] / 4, -d[y, x]]) if d[y, x] > 0 else None) for y in range(5) for x in range(6)}
    rows = pd.DataFrame([(1, x, y, d[y, x]) for y in range(5) for x in range(6)], columns=["image_id", "ix", "iy", "depth"])
    for r in depth.normals(depth.positions(spark.createDataFrame(rows), 4, 4, 2.5, 2)).collect():
        near = [at.get((r.ix + a, r.iy + b)) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        if any(p is None for p in near):
            assert r.nx is None and r.ny is None and r.nz is None
        else:
            n = np.cross(near[0] - near[1], near[2] - near[3])
            assert np.allclose((r.nx, r.ny, r.nz), n / np.linalg.norm(n))


def test_vertex_means(spark):
    from terravox.operators.mesh_more import vertex_means

    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 9.0, 9.0, 9.0)], "vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 3, 1), (2, 0, 0, 1)], "face_id long, v0 long, v1 long, v2 long")
    values = spark.createDataFrame([(0, 4.0), (1, 1.0), (2, 50.0)], "face_id long, value double")
    assert {r.vertex_id: r.value for r in vertex_means(v, f, values).collect()} == {0: 3.0, 1: 3.0, 2: 4.0, 3: 1.0}
