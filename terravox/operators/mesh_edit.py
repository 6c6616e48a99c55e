"""Changes to a mesh's topology as DataFrames of vertices and faces.

Many edits at once are made in rounds: a round takes edits that touch no common face (those that come first in one
order among their neighbours), so the outcome is that of some sequence of single edits and doesn't depend on the
partitioning. Edges are derived from faces; there are none without a face.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import V3
from .batches import ears
from .graph import step
from .mesh import CORNERS, area, corners, edge_lengths, edges, face_components
from .mesh_more import sides

#: Corners of a box as low (0) or high (1) ends, and its twelve faces over them.
BOX_CORNERS = ((0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1), (0, 1, 0), (1, 1, 0), (0, 0, 0), (1, 0, 0))
BOX_FACES = ((0, 1, 3), (0, 3, 2), (2, 3, 5), (2, 5, 4), (4, 5, 7), (4, 7, 6), (6, 7, 1), (6, 1, 0), (1, 7, 5), (1, 5, 3), (6, 0, 2), (6, 2, 4))


def box(spark, low: Sequence[float], high: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    ends = (low, high)
    v = [(i, *(float(ends[s][a]) for a, s in enumerate(c))) for i, c in enumerate(BOX_CORNERS)]
    f = [(i, *c) for i, c in enumerate(BOX_FACES)]
    return spark.createDataFrame(v, "vertex_id long, x double, y double, z double"), spark.createDataFrame(f, "face_id long, v0 long, v1 long, v2 long")


def create_face(faces: DataFrame, face_id: int, v0: int, v1: int, v2: int) -> DataFrame:
    one = faces.sparkSession.createDataFrame([(face_id, v0, v1, v2)], "face_id long, v0 long, v1 long, v2 long")
    return faces.select("face_id", *CORNERS).union(one)


def delete_faces(faces: DataFrame, gone: DataFrame) -> DataFrame:
    """Faces but those of gone(face_id); their edges go with them unless another face has them."""
    return faces.join(gone.select("face_id"), "face_id", "left_anti")


def replace_vertices(faces: DataFrame, by: DataFrame) -> DataFrame:
    """Each vertex_id of by(vertex_id, into) becomes `into`; faces with fewer than three different corners go."""
    for c in CORNERS:
        to = by.select(F.col("vertex_id").alias(c), F.col("into").alias("_into"))
        faces = faces.join(to, c, "left").withColumn(c, F.coalesce("_into", c)).drop("_into")
    return faces.where("v0 <> v1 and v1 <> v2 and v2 <> v0").select("face_id", *CORNERS)


def merge_vertices(vertices: DataFrame, faces: DataFrame, by: DataFrame) -> tuple[DataFrame, DataFrame]:
    return vertices.join(by.select("vertex_id"), "vertex_id", "left_anti"), replace_vertices(faces, by)


def collapsible(faces: DataFrame, picked: DataFrame) -> DataFrame:
    """The edges of picked(v0, v1) whose ends share no other neighbours than those across their own faces: no fin would come of it."""
    e = edges(faces).select("v0", "v1")
    both = e.union(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1")))
    a, b = both.select(F.col("v0").alias("p0"), F.col("v1").alias("q")), both.select(F.col("v0").alias("p1"), F.col("v1").alias("q"))
    shared = picked.join(a, picked["v0"] == F.col("p0")).join(b, ["q"]).where(F.col("p1") == F.col("v1")).groupBy("v0", "v1").agg(F.count("*").alias("common"))
    of_faces = edges(faces).select("v0", "v1", "faces")
    return picked.join(shared, ["v0", "v1"], "left").join(of_faces, ["v0", "v1"]).where(F.coalesce("common", F.lit(0)) <= F.col("faces")).drop("common", "faces")


def apart(picked: DataFrame, faces: DataFrame, order: Sequence[str]) -> DataFrame:
    """Edges of picked(v0, v1, ...) that come first, by the order's columns, among all picked edges in the faces around either end."""
    touched = lambda key: picked.join(faces.select("face_id", F.explode(F.array(*CORNERS)).alias(key)), key).select("v0", "v1", *order, "face_id")
    around = touched("v0").union(touched("v1")).distinct()
    first = F.row_number().over(Window.partitionBy("face_id").orderBy(*order, "v0", "v1"))
    lost = around.withColumn("_n", first).where("_n > 1").select("v0", "v1").distinct()
    return picked.join(lost, ["v0", "v1"], "left_anti")


def collapse(vertices: DataFrame, faces: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each edge of picked(v0, v1) becomes its first vertex, at the middle; picked edges touch no common face."""
    ends = picked.select("v0", "v1")
    place = vertices.select(F.col("vertex_id").alias("v1"), *(F.col(c).alias(f"_{c}") for c in "xyz"))
    to = ends.join(place, "v1").select(F.col("v0").alias("vertex_id"), *(f"_{c}" for c in "xyz"))
    gone = ends.select(F.col("v1").alias("vertex_id"), F.col("v0").alias("into"))
    moved = vertices.join(gone.select("vertex_id"), "vertex_id", "left_anti").join(to, "vertex_id", "left")
    return moved.select("vertex_id", *(F.coalesce((F.col(c) + F.col(f"_{c}")) / 2, F.col(c)).alias(c) for c in "xyz")), replace_vertices(faces, gone)


def collapse_short_edges(vertices: DataFrame, faces: DataFrame, least: float, rounds: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Edges shorter than `least` collapse to their middles, shortest first, until there are none that can. A mesh of at most 4 faces stays."""
    for _ in range(rounds):
        short = edge_lengths(vertices, edges(faces).select("v0", "v1")).where(F.col("length") < least)
        picked = step(apart(collapsible(faces, short), faces, ["length"]))
        if picked.isEmpty() or faces.count() <= 4:
            return vertices, faces
        vertices, faces = (step(t) for t in collapse(vertices, faces, picked))
    raise RuntimeError(f"still collapsing after {rounds} rounds")


def collapse_face(vertices: DataFrame, faces: DataFrame, face_id: int) -> tuple[DataFrame, DataFrame]:
    """A face becomes one vertex (its first) at its centroid."""
    one = faces.where(F.col("face_id") == face_id)
    own = corners(vertices, one).select("v0", *(((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(f"_{c}") for c in "xyz"))
    gone = one.select(F.explode(F.array("v1", "v2")).alias("vertex_id"), F.col("v0").alias("into"))
    moved = vertices.join(gone.select("vertex_id"), "vertex_id", "left_anti").join(F.broadcast(own.withColumnRenamed("v0", "vertex_id")), "vertex_id", "left")
    return moved.select("vertex_id", *(F.coalesce(f"_{c}", c).alias(c) for c in "xyz")), replace_vertices(faces, gone)


def _numbers(vertices: DataFrame, faces: DataFrame) -> tuple[int, int]:
    v, f = vertices.agg(F.max("vertex_id").alias("v")).first()["v"], faces.agg(F.max("face_id").alias("f")).first()["f"]
    return (-1 if v is None else v) + 1, (-1 if f is None else f) + 1


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, 0 upwards without gaps: ranks inside range partitions plus the totals before."""
    parted = step(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    totals = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = parted.join(F.broadcast(before), "_part").withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy("_at")) + F.col("_before") - 1)
    return ranked.drop("_part", "_at", "_before")


def split_edges(vertices: DataFrame, faces: DataFrame, picked: DataFrame, t: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A new vertex on each edge of picked(v0, v1), at t from v0; each face at it becomes two. A face has at most one picked edge."""
    v, f = _numbers(vertices, faces)
    new = step(_ranked(picked.select("v0", "v1"), "v0", "v1").select("v0", "v1", (F.col("place") + v).alias("middle")))
    a, b = (vertices.select(F.col("vertex_id").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")) for k in ("v0", "v1"))
    mids = new.join(a, "v0").join(b, "v1").select(F.col("middle").alias("vertex_id"), *((F.col(f"v0{c}") * (1 - t) + F.col(f"v1{c}") * t).alias(c) for c in "xyz"))
    cut = None
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        own = faces.select("face_id", F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b"), F.col(f"v{k}").alias("c"), F.least(f"v{i}", f"v{j}").alias("v0"), F.greatest(f"v{i}", f"v{j}").alias("v1"))
        met = own.join(new, ["v0", "v1"]).select("face_id", "a", "b", "c", "middle")
        cut = met if cut is None else cut.union(met)
    cut = step(_ranked(cut, "face_id").withColumn("other", F.col("place") + f))
    two = cut.select("face_id", F.col("a").alias("v0"), F.col("middle").alias("v1"), F.col("c").alias("v2")).union(cut.select("other", "middle", "b", "c"))
    return vertices.select("vertex_id", "x", "y", "z").union(mids), faces.select("face_id", *CORNERS).join(cut.select("face_id"), "face_id", "left_anti").union(two)


def subdivide_long_edges(vertices: DataFrame, faces: DataFrame, most: float, rounds: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Edges longer than `most` are halved, longest first, until there are none."""
    for _ in range(rounds):
        long = edge_lengths(vertices, edges(faces).select("v0", "v1", "f0", "f1")).where(F.col("length") > most)
        at = long.select("v0", "v1", "length", F.explode(F.array_distinct(F.array("f0", "f1"))).alias("face_id"))
        first = F.row_number().over(Window.partitionBy("face_id").orderBy(F.desc("length"), "v0", "v1"))
        lost = at.withColumn("_n", first).where("_n > 1").select("v0", "v1").distinct()
        picked = step(long.join(lost, ["v0", "v1"], "left_anti").select("v0", "v1"))
        if picked.isEmpty():
            return vertices, faces
        vertices, faces = (step(t) for t in split_edges(vertices, faces, picked))
    raise RuntimeError(f"still splitting after {rounds} rounds")


def split_faces(vertices: DataFrame, faces: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new vertex at the centroid of each face of picked(face_id), which becomes three."""
    v, f = _numbers(vertices, faces)
    own = step(_ranked(corners(vertices, faces.join(picked.select("face_id"), "face_id", "left_semi").select("face_id", *CORNERS)), "face_id").withColumns({"middle": F.col("place") + v, "g": F.col("place") * 2 + f}))
    mids = own.select(F.col("middle").alias("vertex_id"), *(((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(c) for c in "xyz"))
    three = own.select("face_id", "v0", "v1", "middle").union(own.select("g", "v1", "v2", "middle")).union(own.select(F.col("g") + 1, "v2", "v0", "middle"))
    return vertices.select("vertex_id", "x", "y", "z").union(mids), faces.select("face_id", *CORNERS).join(own.select("face_id"), "face_id", "left_anti").union(three.toDF("face_id", *CORNERS))


def swap(faces: DataFrame, picked: DataFrame) -> DataFrame:
    """Each inner edge of picked(v0, v1, f0, f1, o0, o1) becomes that between the vertices across it, if there isn't one. Picked edges have no common face."""
    there = edges(faces).select("v0", "v1")
    new = picked.join(there.select(F.col("v0").alias("p"), F.col("v1").alias("q")), (F.least("o0", "o1") == F.col("p")) & (F.greatest("o0", "o1") == F.col("q")), "left_anti")
    new = new.where("o0 <> o1 and f0 <> f1").select(F.col("v0").alias("a"), F.col("v1").alias("b"), "f0", "f1", "o0", "o1")
    # which way round the first face goes along the edge decides for both
    first = new.join(faces.select(F.col("face_id").alias("f0"), F.array(*CORNERS).alias("c")), "f0")
    at = F.array_position("c", F.col("a"))
    forward = F.element_at("c", (at % 3 + 1).cast("int")) == F.col("b")
    tail, head = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    both = first.select("f0", "f1", "o0", "o1", tail.alias("t"), head.alias("h"))
    turned = both.select("f0", "o0", F.col("o1").alias("x"), F.col("h").alias("y")).union(both.select("f1", "o1", F.col("o0"), F.col("t"))).toDF("face_id", *CORNERS)
    return faces.select("face_id", *CORNERS).join(turned.select("face_id"), "face_id", "left_anti").union(turned)


def _least_angle(a: V3, b: V3, c: V3) -> F.Column:
    return F.least(G.angle(b.minus(a), c.minus(a)), G.angle(a.minus(b), c.minus(b)), G.angle(a.minus(c), b.minus(c)))


def swap_gains(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Inner edges with gain: by how much the least angle of their two faces grows if they are swapped."""
    inner = sides(vertices, faces).where("faces = 2 and o0 <> o1")
    for key, prefix in (("o0", "p"), ("o1", "q")):
        inner = inner.join(vertices.select(F.col("vertex_id").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in "xyz")), key)
    a, b, p, q = (V3.of(*(f"{n}{c}" for c in "xyz")) for n in "abpq")
    gain = F.least(_least_angle(p, q, a), _least_angle(p, q, b)) - F.least(_least_angle(a, b, p), _least_angle(a, b, q))
    return inner.select("v0", "v1", "f0", "f1", "o0", "o1", gain.alias("gain"))


def swap_edges(vertices: DataFrame, faces: DataFrame, least: float, rounds: int = 200) -> DataFrame:
    """Edges are swapped while that makes the least angle of their faces larger by at least `least` (more than 0), largest gain first."""
    for _ in range(rounds):
        better = swap_gains(vertices, faces).where(F.col("gain") >= least)
        at = better.select("v0", "v1", "gain", F.explode(F.array("f0", "f1")).alias("face_id"))
        lost = at.withColumn("_n", F.row_number().over(Window.partitionBy("face_id").orderBy(F.desc("gain"), "v0", "v1"))).where("_n > 1").select("v0", "v1").distinct()
        there = edges(faces).select(F.col("v0").alias("p"), F.col("v1").alias("q"))
        free = better.join(lost, ["v0", "v1"], "left_anti").join(there, (F.least("o0", "o1") == F.col("p")) & (F.greatest("o0", "o1") == F.col("q")), "left_anti")
        # two swaps that would make the same edge: the first one
        once = F.row_number().over(Window.partitionBy(F.least("o0", "o1"), F.greatest("o0", "o1")).orderBy(F.desc("gain"), "v0", "v1"))
        picked = step(free.withColumn("_n", once).where("_n = 1").drop("_n"))
        if picked.isEmpty():
            return faces
        faces = step(swap(faces, picked))
    raise RuntimeError(f"still swapping after {rounds} rounds")


def boundary_sides(faces: DataFrame) -> DataFrame:
    """(a, b) of each side that only one face has, as that face goes along it."""
    half = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    each = faces.select(half.alias("e")).select("e.a", "e.b", F.least("e.a", "e.b").alias("v0"), F.greatest("e.a", "e.b").alias("v1"))
    return each.groupBy("v0", "v1").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1").select("a", "b")


def holes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(hole, a, b, x, y, z, length): sides of each boundary loop, named by its smallest vertex."""
    from .graph import components

    rim = step(boundary_sides(faces))
    loops = components(rim)
    named = rim.join(loops, rim["a"] == loops["node"], "left").select(F.coalesce("component", "a").alias("hole"), "a", "b")
    a, b = (vertices.select(F.col("vertex_id").alias(k), *(F.col(c).alias(n) for c, n in zip("xyz", names, strict=True))) for k, names in (("a", "xyz"), ("b", "uvw")))
    return named.join(a, "a").join(b, "b").withColumn("length", G.point_point(V3.of("x", "y", "z"), V3.of("u", "v", "w"))).drop("u", "v", "w")


def fill_holes(vertices: DataFrame, faces: DataFrame, most: float) -> DataFrame:
    """Faces with each hole of perimeter up to `most` closed by triangles over its own vertices. One hole is one task's: the perimeter bounds it."""
    rim = step(holes(vertices, faces))
    small = rim.join(rim.groupBy("hole").agg(F.sum("length").alias("around"), F.count("*").alias("n")).where((F.col("around") <= most) & (F.col("n") >= 3)).select("hole"), "hole", "left_semi")
    new = step(small.groupBy("hole").applyInPandas(ears, "hole long, n long, v0 long, v1 long, v2 long"))
    _, f = _numbers(vertices, faces)
    return faces.select("face_id", *CORNERS).union(_ranked(new, "hole", "n").select((F.col("place") + f).alias("face_id"), *CORNERS))


def delete_small_components(vertices: DataFrame, faces: DataFrame, least: float) -> DataFrame:
    """Faces of components (by common edges) whose area is at least `least`."""
    own = corners(vertices, faces.select("face_id", *CORNERS)).select("face_id", area().alias("area")).join(face_components(faces), "face_id")
    small = own.groupBy("component").agg(F.sum("area").alias("area")).where(F.col("area") < least)
    return delete_faces(faces, own.join(small.select("component"), "component", "left_semi"))


def merge_meshes(meshes: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Meshes one after another; ids of each go on after those of the one before."""
    (vertices, faces), *more = meshes
    vertices, faces = vertices.select("vertex_id", "x", "y", "z"), faces.select("face_id", *CORNERS)
    for v, f in more:
        nv, nf = _numbers(vertices, faces)
        vertices = vertices.union(v.select(F.col("vertex_id") + nv, "x", "y", "z"))
        faces = faces.union(f.select(F.col("face_id") + nf, *(F.col(c) + nv for c in CORNERS)))
    return vertices, faces
