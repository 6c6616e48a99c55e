"""Operators against hand-computed values, numpy and properties."""

import math
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

SIDES = (6, 5)


@pytest.fixture
def grid2(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 9, (5, 6)).astype(float)
    rows = [(1, x, y, None if (x, y) == (2, 3) else float(v[y, x])) for y in range(5) for x in range(6)]
    return spark.createDataFrame(rows, "grid_id int, ix int, iy int, value double"), v


def values(df, *key):
    return {tuple(r[k] for k in key): r["value"] for r in df.collect()}


def test_percentile_truncates_and_clamps(spark):
    from terravox.operators import grid, props

    cells = spark.createDataFrame([(1, i, 0, float(v)) for i, v in enumerate([40, 10, 30, 20])] + [(1, 9, 0, None)], "grid_id int, ix int, iy int, value double")
    pick = lambda p: grid.percentile(cells, p).first()["value"]
    assert (pick(0.0), pick(0.5), pick(1.0)) == (10, 30, 40)
    p = spark.createDataFrame([(i, float(v)) for i, v in enumerate([40, 10, 30, 20])], "vertex_id long, a double")
    assert [props.percentile(p, "a", q).first()["value"] for q in (0, 50, 100)] == [10, 30, 40]
    assert grid.percentile(cells.where("false"), 0.5).count() == 0


def test_unknown_spreads_in_two_dimensions(grid2):
    from terravox.operators import grid

    cells, _ = grid2
    out = values(grid.convolve(cells, (1.0,) * 9, SIDES), "ix", "iy")
    assert out[(0, 0)] is None and out[(1, 2)] is None and out[(4, 1)] is not None
    assert values(grid.fill_gaps(cells, "ix", 2), "ix", "iy")[(2, 3)] == pytest.approx((values(cells, "ix", "iy")[(1, 3)] + values(cells, "ix", "iy")[(3, 3)]) / 2)
    twice = grid.reflect(grid.reflect(cells, SIDES), SIDES)
    assert values(twice, "ix", "iy") == values(cells, "ix", "iy")


def test_division_by_zero_differs_between_dimensions(spark):
    from terravox.operators import grid

    a = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 0, -5.0), (1, 2, 0, 0.0), (1, 3, 0, 4.0)], "grid_id int, ix int, iy int, value double")
    b = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 0, 0.0), (1, 2, 0, 0.0), (1, 3, 0, None)], "grid_id int, ix int, iy int, value double")
    assert [values(grid.combine(a, b, "divide"), "ix")[(i,)] for i in range(4)] == [1e6, -1e6, 0.0, None]
    three = lambda d: d.withColumn("iz", F.lit(0))
    assert values(grid.combine(three(a), three(b.fillna(2.0)), "divide"), "ix")[(0,)] == 5.0


def test_components_are_eight_connected_flat_and_six_connected_in_space(spark):
    from terravox.operators import graph

    flat = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 1.0), (1, 3, 1, 1.0)], "grid_id int, ix int, iy int, value double")
    assert graph.grid_components(flat, 0, (4, 2)).select("component").distinct().count() == 2
    space = flat.withColumn("iz", F.lit(0))
    assert graph.grid_components(space, 0, (4, 2, 1)).select("component").distinct().count() == 3


def test_distance_transform_is_exact(grid2):
    from terravox.operators import graph

    cells, _ = grid2
    mask = cells.withColumn("value", F.when((F.col("ix") == 1) & (F.col("iy") == 4) | (F.col("ix") == 5) & (F.col("iy") == 0), 1.0).otherwise(0.0))
    out = {(r.ix, r.iy): r.d2 for r in graph.squared_distance(mask, SIDES).collect()}
    assert out == {(x, y): float(min((x - 1) ** 2 + (y - 4) ** 2, (x - 5) ** 2 + y**2)) for x in range(6) for y in range(5)}
    none = graph.squared_distance(mask.withColumn("value", F.lit(0.0)), SIDES)
    assert {r.d2 for r in none.collect()} == {2.0 * 7**2}
    assert graph.dilate(mask, 0.0, SIDES).agg(F.sum("value")).first()[0] == 2


def test_nearest_neighbours_match_all_pairs(spark):
    from terravox.operators import spatial_join as J

    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random((60, 3)), rng.random((5, 3)) * 0.01 + 40])
    p[3] = p[2]
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "surfel_id long, x double, y double, z double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    got = {(r.query_id, r["rank"]): r.point_id for r in J.k_nearest(points, points, 7).collect()}
    assert got == {(i, n + 1): int(j) for i in range(len(p)) for n, j in enumerate(sorted(range(len(p)), key=lambda j: (d[i, j], j))[:7])}
    far = {r.query_id: r.point_id for r in J.furthest(points, points).collect()}
    assert all(d[i, j] == pytest.approx(d[i].max()) for i, j in far.items())
    pairs = {(r.query_id, r.point_id) for r in J.range_pairs(points, points, 0.2, 0.05).collect()}
    assert pairs == {(i, j) for i in range(len(p)) for j in range(len(p)) if 0.05**2 <= d[i, j] ** 2 <= 0.2**2}


def test_asof_clamps_at_both_ends(spark):
    from terravox.operators import asof

    lines = spark.createDataFrame([(1, 10, 1.0, 0.0), (1, 11, 2.0, 10.0), (1, 12, 4.0, 30.0)], "survey_id long, scanline_id long, timestamp double, px double")
    queries = spark.createDataFrame([(1, 0, 0.5), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 9.0)], "survey_id long, query_id long, timestamp double")
    out = {r.query_id: (r.before_id, r.after_id, r.px) for r in asof.interpolate(asof.asof(queries, lines, "survey_id", carry=("px",)), ("px",)).collect()}
    assert out == {0: (10, 10, 0.0), 1: (11, 11, 10.0), 2: (11, 12, 20.0), 3: (12, 12, 30.0)}


def test_human_labels_win(spark):
    from terravox.operators import labels

    a = spark.createDataFrame([(1, "m", 0, 1, 0.9), (1, "h", 1, 0, 0.1), (1, "truth", 2, 2, 1.0), (2, "m1", 0, 1, 0.5), (2, "m2", 1, 1, 0.5)], "object_id long, label string, place long, originator int, confidence double")
    assert {r.object_id: r.label for r in labels.current_label(a).collect()} == {1: "h", 2: "m1"}


def test_entropy_can_be_compatible(spark):
    from terravox.operators import props

    p = spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "vertex_id long, a double")
    assert props.entropy(p, "a").first()[0] == pytest.approx(1.0)
    assert math.isnan(props.entropy(p, "a", compatible=True).first()[0])


def cube(spark):
    v = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [(2 * n + k, *t) for n, q in enumerate(quads) for k, t in enumerate(((q[0], q[1], q[2]), (q[0], q[2], q[3])))]
    return spark.createDataFrame(v, "vertex_id long, x double, y double, z double"), spark.createDataFrame(f, "face_id long, v0 long, v1 long, v2 long")


def test_a_cube(spark):
    from terravox.operators import mesh

    v, f = cube(spark)
    m = mesh.measures(v, f).first()
    assert (m.area, m.cx, m.cy, m.cz) == pytest.approx((6, 0.5, 0.5, 0.5))
    assert mesh.boundary_vertices(f).count() == 0 and mesh.edges(f).count() == 18
    area = {r.vertex_id: r.area for r in mesh.vertex_areas(v, f).collect()}
    total = sum(r.curvature * area[r.vertex_id] for r in mesh.gauss_curvature(v, f).collect())
    assert total == pytest.approx(4 * math.pi)
    angles = sorted(round(r.angle, 6) for r in mesh.dihedral(v, f).collect())
    assert angles == [round(math.pi / 2, 6)] * 12 + [round(math.pi, 6)] * 6
    sv, sf = mesh.subdivide(v, f)
    assert sv.count() == 8 + 18 and sf.count() == 48
    assert mesh.corners(sv, sf).agg(F.sum(mesh.area())).first()[0] == pytest.approx(6)
    point = spark.createDataFrame([(1, 0.5, 0.5, 1.7), (2, 3.0, 0.5, 0.5), (3, 1.3, 1.4, 0.5)], "surfel_id long, x double, y double, z double")
    got = {r.surfel_id: r.distance for r in mesh.closest_on_mesh(point, v, f, 2.5).collect()}
    assert got == pytest.approx({1: 0.7, 2: 2.0, 3: 0.5})
    ray = spark.createDataFrame([(1, 0.25, 0.5, 5.0), (2, 7.0, 7.0, 5.0)], "ray_id long, x double, y double, z0 double")
    assert {r.ray_id: r.t for r in mesh.first_hits(ray, v, f, 0.7).collect()} == pytest.approx({1: 4.0})


def test_alignment_recovers_a_motion(spark):
    from terravox.operators import align

    rng = np.random.default_rng(5)
    p = rng.random((50, 3))
    r = np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]])
    q = 2.5 * p @ r.T + [1, 2, 3]
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)], "x double, y double, z double, u double, v double, w double")
    m = align.similarity(pairs, scale=True)
    assert np.allclose(m[:3, :3], 2.5 * r) and np.allclose(m[:3, 3], [1, 2, 3]) and align.rmsd(align.moved(pairs, m)) < 1e-9
    points = pairs.select(F.monotonically_increasing_id().alias("surfel_id"), "x", "y", (F.col("x") * 0.001).alias("z"))
    n, d = align.fit_plane(points)
    assert abs(n[2]) > 0.999 and abs(d) < 0.01
    assert align.ransac_plane(points, 0.01)[2] == 50


def test_cumulative_transforms_and_closure(spark):
    from terravox.operators import tree

    shift = lambda x, k=1.0: [k, 0, 0, x, 0, k, 0, 0, 0, 0, k, 0, 0, 0, 0, 1.0]
    nodes = spark.createDataFrame([("a", None, [float(v) for v in shift(1, 2)]), ("b", "a", [float(v) for v in shift(3)]), ("c", "b", [float(v) for v in shift(5)])], "node_id string, parent_id string, transform array<double>")
    assert {r.node_id: (r.world[0], r.world[3]) for r in tree.cumulative_transforms(nodes).collect()} == {"a": (2, 1), "b": (2, 7), "c": (2, 17)}
    assert {(r.ancestor, r.node_id, r.depth) for r in tree.closure(nodes).collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}
    assert {r.node_id: r.parent_id for r in tree.flatten(nodes).collect()} == {"a": None, "b": "a", "c": "a"}


def test_set_laws(spark):
    from terravox.operators import sets

    a, b = spark.range(0, 10).withColumnRenamed("id", "surfel_id"), spark.range(5, 15).withColumnRenamed("id", "surfel_id")
    n = lambda d: d.count()
    assert n(sets.union(a, b)) == n(a) + n(b) - n(sets.intersect(a, b)) and n(sets.subtract(a, b)) == n(a) - n(sets.intersect(a, b))


def test_splats_keep_their_mass(spark):
    from terravox.operators import grid

    rng = np.random.default_rng(7)
    p = spark.createDataFrame([(float(a), float(b)) for a, b in rng.random((40, 2)) * 4], "a double, b double")
    assert grid.splat(p, (F.col("a"), F.col("b")), F.lit(1.0), (6, 6)).agg(F.sum("value")).first()[0] == pytest.approx(40)


def test_block_pruning_never_loses_a_row(spark):
    from terravox.operators import predicates as P
    from terravox.plans.views import surfels

    points = surfels(spark, "/root/testdata/sf0.001")
    stats = P.block_stats(points)
    for c in (P.box((-0.1,) * 3, (0.1,) * 3), P.sphere((0, 0, 0), 0.2), P.cylinder((0, 0, 0), 0.1, -0.1, 0.1), P.halfspace((0, 0, 1), -0.2), P.timestamp(3, 40), P.coordinate("x", 0.1, 0.2)):
        assert P.scan(points, c, stats).count() == P.scan(points, c).count()


def test_streams_keep_current_labels(spark, tmp_path):
    from terravox.streaming import incremental

    schema = "object_id long, label string, place long, originator int, confidence double"
    spark.createDataFrame([(1, "m", 0, 1, 0.9), (2, "x", 0, 1, 0.2)], schema).write.parquet(f"{tmp_path}/in")
    run = lambda: incremental.keep_labels(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    spark.createDataFrame([(1, "h", 1, 0, 0.1), (2, "y", 1, 1, 0.7)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {r.object_id: r.label for r in incremental.labels_at(spark, f"file://{tmp_path}/out", 1).collect()} == {1: "h", 2: "y"}


def test_chains_reject_what_they_dont_know():
    from terravox.plans import chains

    assert chains.GRID2.parse(["-add", "3", "-abs"]) == [("add", ["3"]), ("abs", [])]
    with pytest.raises(ValueError):
        chains.GRID2.parse(["-nothing"])
    with pytest.raises(ValueError):
        chains.GRID3.parse(["-threshold", "1"])


def test_contours_and_surfaces_close(spark):
    from terravox.operators import depth

    rows = [(1, x, y, z, math.dist((x, y, z), (3.1, 2.9, 3.2))) for x in range(7) for y in range(7) for z in range(7)]
    cells = spark.createDataFrame(rows, "grid_id int, ix int, iy int, iz int, value double")
    found = depth.isosurface(cells, 2.2).collect()
    area = 0.0
    for r in found:
        p = np.array(r.corners)
        assert len(p) in (3, 4) and np.abs(np.linalg.norm(p - [3.1, 2.9, 3.2], axis=1) - 2.2).max() < 0.2
        area += sum(np.linalg.norm(np.cross(p[i] - p[0], p[i + 1] - p[0])) / 2 for i in range(1, len(p) - 1))
    assert area == pytest.approx(4 * math.pi * 2.2**2, rel=0.06)
    flat = cells.where("iz = 3").drop("iz")
    length = sum(math.dist((r.x0, r.y0), (r.x1, r.y1)) for r in depth.contours(flat, 2.2).collect())
    assert length == pytest.approx(2 * math.pi * math.sqrt(2.2**2 - 0.2**2), rel=0.05)


def test_hulls_and_slerp(spark):
    from terravox.functions import camera
    from terravox.operators import features

    rng = np.random.default_rng(9)
    p = [(1, float(a), float(b)) for a, b in rng.random((200, 2))] + [(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 1.0, 1.0), (1, 0.0, 1.0), (1, 0.5, 0.0), (2, 3.0, 3.0), (2, None, 1.0)]
    out = features.convex_hulls(spark.createDataFrame(p, "k long, x double, y double"), "k").collect()
    assert sorted((r.x, r.y) for r in out if r.k == 1) == [(0, 0), (0, 1), (1, 0), (1, 1)] and len([r for r in out if r.k == 2]) == 1
    q = camera.slerp(tuple(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)), tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)), F.lit(0.5))
    assert list(spark.range(1).select(*q).first()) == pytest.approx([math.sqrt(0.5), 0, 0, math.sqrt(0.5)])


def test_greedy_maxima_keep_their_distance(spark):
    from terravox.operators import depth

    cells = spark.createDataFrame([(1, x, y, float(10 * x + y)) for x in range(6) for y in range(6)], "grid_id int, ix int, iy int, value double")
    assert [(r.ix, r.iy) for r in depth.greedy_maxima(cells, 3, 3.0).orderBy(F.desc("value")).collect()] == [(5, 5), (5, 2), (2, 5)]


def test_greedy_maxima_go_on_when_one_ball_holds_all_candidates(spark):
    from terravox.operators import depth

    cells = spark.createDataFrame([(1, x, 0, float(200 - x)) for x in range(200)], "grid_id int, ix int, iy int, value double")
    pick = lambda n: [r.ix for r in depth.greedy_maxima(cells, n, 60.0, candidates=50).orderBy(F.desc("value")).collect()]
    assert pick(2) == [0, 60] and pick(5) == [0, 60, 120, 180]


def test_agglomeration_runs_until_nothing_merges(spark):
    from terravox.operators import cluster

    at, x = [], 0.0
    for i in range(9):
        at.append((i, x, 0.0, 0.0))
        x += 1 + i  # the next point is always nearer to the cluster than to the one after it
    points = spark.createDataFrame(at, "surfel_id long, x double, y double, z double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    assert {r.cluster for r in cluster.agglomerate(points, edges, 1000.0).collect()} == {0}
    with pytest.raises(RuntimeError):
        cluster.agglomerate(points, edges, 1000.0, rounds=1)


def test_agglomerative_objects_are_a_fixed_point(spark):
    from terravox import queries
    from terravox.plans.q_models import _near

    sf = "/root/testdata/sf0.001"
    label = {r.surfel_id: r.cluster for r in queries.registry()["agglomerative_objects"](spark, sf).collect()}
    s, e = _near(spark, sf)
    at = {r.surfel_id: np.array([r.x, r.y, r.z]) for r in s.collect()}
    centre = {c: np.mean([at[i] for i in at if label[i] == c], axis=0) for c in set(label.values())}
    touching = {(label[r.a], label[r.b]) for r in e.collect() if label[r.a] != label[r.b]}
    assert all(1 - np.linalg.norm(centre[a] - centre[b]) / 0.2 < 0.3 for a, b in touching)


def test_furthest_in_parts_with_ties_and_odd_places(spark, monkeypatch):
    """Points on a sphere and inside it, copies of them, and coordinates that are null, not a number or infinite, in SQL's order."""
    from terravox.operators import spatial_join as J

    monkeypatch.setattr(J, "HELD", 7)
    rng = np.random.default_rng(8)
    ball = rng.normal(size=(60, 3))
    ball[:40] /= np.linalg.norm(ball[:40], axis=1, keepdims=True)
    p = np.concatenate([ball, ball[:20], np.full((30, 3), 3.0)])
    schema = "surfel_id long, x double, y double, z double"
    rows = [(900 - i, *map(float, r)) for i, r in enumerate(p)]
    inf, nan = float("inf"), float("nan")
    odd = [(1000, None, 0.0, 0.0), (1001, 0.0, inf, 0.0), (1002, 0.0, -inf, 0.0), (1003, nan, 0.0, 0.0)]

    def want(queries, points):
        out = {}
        for i, *q in queries:
            best = []
            for j, *r in points:
                d = None if None in q or None in r else math.sqrt(reduce(add, ((a - b) * (a - b) for a, b in zip(q, r, strict=True))))
                best.append(((0, 0.0) if d is None else (2, 0.0) if d != d else (1, d), -j))
            (kind, d), j = max(best)
            out[i] = (-j, str((None, d, nan)[kind]))
        return out

    for queries, points in ((rows + odd, rows), (rows[:5] + odd, odd[:1]), (rows + odd, rows + odd[:3])):
        got = J.furthest(spark.createDataFrame(queries, schema), spark.createDataFrame(points, schema)).collect()
        assert {r.query_id: (r.point_id, str(r.distance)) for r in got} == want(queries, points) and len(got) == len(queries)
    assert J.furthest(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)).count() == 0


def test_best_view_in_parts_with_ties_and_odd_places(spark, monkeypatch):
    """Images that look anywhere, copies of them, and places that are null or not a number, in SQL's order."""
    from terravox.operators import spatial_join as J

    monkeypatch.setattr(J, "HELD", 150)
    rng = np.random.default_rng(9)
    eye, towards, cos = rng.normal(size=(400, 3)), rng.normal(size=(400, 3)), rng.uniform(0.2, 0.99, 400)
    towards /= np.linalg.norm(towards, axis=1, keepdims=True)
    images = [(1000 - i, *map(float, (*eye[i % 300], *towards[i % 300], cos[i % 300]))) for i in range(400)]
    inf, nan = float("inf"), float("nan")
    points = [(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(150, 3)) * 1.5)] + [(500, nan, 0.0, 0.0), (501, None, 0.0, 0.0), (502, 0.0, inf, 0.0), (503, 1e6, 1e6, 1e6)]
    views = "image_id long, ex double, ey double, ez double, tx double, ty double, tz double, cos_half_angle double"

    def want(images):
        out = {}
        for i, *q in points:
            best = []
            for j, *v in (r for r in images if None not in (*q, *r)):
                off = [a - b for a, b in zip(q, v[:3], strict=True)]
                depth, d2 = reduce(add, (a * b for a, b in zip(off, v[3:6], strict=True))), reduce(add, (a * a for a in off))
                seen = depth / math.sqrt(d2)
                if not (depth <= 0 or seen < v[6]):
                    best.append((seen != seen, seen / d2 if seen == seen else 0.0, -j))
            if best:
                odd, score, j = max(best)
                out[i] = (-j, str(nan if odd else score))
        return out

    for own in (images, images[:20] + [(7, nan, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5), (3, 0.0, 0.0, None, 0.0, 0.0, 1.0, 0.5)]):
        got = J.best_view(spark.createDataFrame(points, "surfel_id long, x double, y double, z double"), spark.createDataFrame(own, views)).collect()
        assert {r.surfel_id: (r.image_id, str(r.score)) for r in got} == want(own)
