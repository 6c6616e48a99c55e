"""Mesh edits and paths on small solids, by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.operators import batches


@pytest.fixture(scope="module")
def ops(spark):
    from terravox.operators import mesh, mesh_edit, mesh_more

    return mesh, mesh_edit, mesh_more


def euler(mesh, faces):
    return faces.select(F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct().count() - mesh.edges(faces).count() + faces.count()


def closed(mesh, faces):
    """Every edge has two faces that go along it in opposite directions."""
    half = faces.select(F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("e")).select("e.*")
    return half.count() == half.distinct().count() == half.join(half.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).count()


def test_box_is_closed(spark, ops):
    mesh, edit, more = ops
    v, f = edit.box(spark, (0, 0, 0), (1, 2, 3))
    assert euler(mesh, f) == 2 and closed(mesh, f)
    assert mesh.corners(v, f).agg(F.sum(mesh.area())).first()[0] == pytest.approx(22)
    # normals point outwards: the corner at the origin looks away from the middle
    n = more.vertex_normals(v, f).where("vertex_id = 6").first()
    assert n.nx < 0 and n.ny < 0 and n.nz < 0


def test_edits_keep_a_solid_closed(spark, ops):
    mesh, edit, more = ops
    v, f = edit.box(spark, (0, 0, 0), (1, 2, 3))
    v2, f2 = edit.subdivide_long_edges(v, f, 1.8)
    assert closed(mesh, f2) and euler(mesh, f2) == 2
    assert mesh.edge_lengths(v2, mesh.edges(f2)).agg(F.max("length")).first()[0] <= 1.8
    assert mesh.corners(v2, f2).agg(F.sum(mesh.area())).first()[0] == pytest.approx(22)
    v3, f3 = edit.collapse_short_edges(v2, f2, 1.01)
    assert closed(mesh, f3) and euler(mesh, f3) == 2 and f3.count() < f2.count()
    assert v3.join(f3.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct(), "vertex_id").count() == f3.select(F.explode(F.array("v0", "v1", "v2"))).distinct().count()
    v4, f4 = edit.split_faces(v, f, f.where("face_id < 5"))
    assert closed(mesh, f4) and f4.count() == 22 and v4.count() == 13
    f5 = edit.swap_edges(v2, f2, 0.01)
    assert closed(mesh, f5) and f5.count() == f2.count()
    assert more is not None


def test_swap_takes_the_better_diagonal(spark, ops):
    _, edit, more = ops
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 5.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0)], "vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "face_id long, v0 long, v1 long, v2 long")
    gain = edit.swap_gains(v, f).first()
    assert (gain.v0, gain.v1) == (0, 2) and gain.gain > 0
    got = {frozenset((r.v0, r.v1, r.v2)) for r in edit.swap_edges(v, f, 1e-6).collect()}
    assert got == {frozenset((0, 1, 3)), frozenset((1, 2, 3))}


def test_holes_are_closed(spark, ops):
    mesh, edit, _ = ops
    v, f = edit.box(spark, (0, 0, 0), (1, 1, 1))
    open_ = f.where("face_id not in (2, 3)")
    filled = edit.fill_holes(v, open_, 100.0)
    assert filled.count() == 12 and closed(mesh, filled)
    assert edit.fill_holes(v, open_, 0.5).count() == 10


def test_ears_of_a_concave_hole():
    import pandas as pd

    loop = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 4.0), (3, 2.0, 1.0), (4, 0.0, 4.0)]
    pdf = pd.DataFrame([(loop[(i + 1) % 5][0], loop[i][0], *loop[(i + 1) % 5][1:], 0.0) for i in range(5)], columns=["a", "b", "x", "y", "z"])
    out = batches.ears((0,), pdf)
    place = {i: np.array((x, y)) for i, x, y in loop}
    areas = [np.cross(place[b] - place[a], place[c] - place[a]) / 2 for a, b, c in out[["v0", "v1", "v2"]].to_numpy().tolist()]
    assert len(out) == 3 and all(x > 0 for x in areas) and sum(areas) == pytest.approx(10)


def test_paths_over_edges(spark, ops):
    mesh, edit, more = ops
    v, f = edit.box(spark, (0, 0, 0), (1, 1, 1))
    pairs = {(r.a, r.b): r.distance for r in more.geodesic_pairs(v, f, 10.0).collect()}
    assert len(pairs) == 64 and all(pairs[a, b] == pytest.approx(pairs[b, a]) for a, b in pairs) and pairs[6, 3] <= 1 + math.sqrt(2) + 1e-12
    far = more.furthest_vertices(v, f, spark.createDataFrame([(6,)], "node long"), 3).collect()
    assert far[0].distance == pytest.approx(max(d for (a, _), d in pairs.items() if a == 6)) and len({r.vertex_id for r in far}) == 3
    assert all(a.distance >= b.distance for a, b in zip(far, far[1:], strict=False))


def test_envelope_is_the_minimum():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        height = [float(h) if rng.random() < 0.6 else 1e6 for h in rng.integers(0, 200, n)]
        out, who = batches.envelope(list(range(n)), height, 1e6)
        for x in range(n):
            best = min([h + (x - i) ** 2 for i, h in enumerate(height) if h < 1e6], default=1e6)
            assert out[x] == best and (who[x] < 0 if best == 1e6 else height[who[x]] + (x - who[x]) ** 2 == best)
