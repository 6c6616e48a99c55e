"""Components, paths and distance transforms: iterative operators as joins and aggregations until nothing changes.

Each step is a table in spark.checkpoint.dir (a temporary folder where that is unset and all runs on one machine, as in
tests), so plans stay short and a lost executor loses one step.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import SMALL, envelopes, stars
from .grid import V, axes_of, cell_of


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="terravox-steps-"))


def step(df: DataFrame) -> DataFrame:
    """The rows of df, written and read again: nothing of the plan behind them is left, nor what the optimizer knew of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest reachable node, for edges (a, b) of numbers or strings. That smallest node has no row itself.

    Each task contracts its own edges to stars before anything is shuffled; then large and small stars alternate until
    nothing changes. As soon as SMALL edges or fewer are left one task finishes the work."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = step(now.mapInArrow(stars, now.schema))
    before = None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state[0] <= SMALL:
            now = now.coalesce(1).mapInArrow(stars, now.schema).where("u <> v")
        if state == before or state[0] <= SMALL:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = small.where("u > v").distinct()
        now = step(small.mapInArrow(stars, small.schema).distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def grid_components(cells: DataFrame, level: float, resolution: Sequence[int]) -> DataFrame:
    """Known cells above the level with their component: the smallest linear index in it. 2D: eight neighbours, 3D: six.

    Runs along x are one node each: a window finds them, so a long corridor costs one step, not one a cell."""
    axes = axes_of(cells)
    others = [c for c in cell_of(cells) if c != "ix"]
    index = sum((F.col(a).cast("long") * s for a, s in zip(axes, _strides(resolution), strict=True)), F.lit(0))
    on = cells.where(V > level).select(*cell_of(cells), index.alias("i"))
    w = Window.partitionBy(*others).orderBy("ix")
    runs = on.withColumn("run", F.sum((F.col("ix") - F.coalesce(F.lag("ix").over(w), F.lit(-2)) > 1).cast("int")).over(w))
    runs = runs.withColumns({"node": F.min("i").over(Window.partitionBy(*others, "run"))})
    spans = runs.groupBy(*others, "node").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    steps = [(1,)] if len(axes) == 2 else [(1, 0), (0, 1)]
    slack = 1 if len(axes) == 2 else 0
    edges = None
    for s in steps:
        moved = spans.select("grid_id", *((F.col(a) + d).alias(a) for a, d in zip(axes[1:], s, strict=True)), F.col("node").alias("a"), F.col("x0").alias("y0"), F.col("x1").alias("y1"))
        met = moved.join(spans, others).where((F.col("y0") <= F.col("x1") + slack) & (F.col("x0") <= F.col("y1") + slack)).select("a", F.col("node").alias("b"))
        edges = met if edges is None else edges.union(met)
    joined = components(edges)
    return runs.join(joined, "node", "left").select(*cell_of(cells), F.coalesce("component", "node").alias("component"))


def _strides(resolution: Sequence[int]) -> list[int]:
    out = [1]
    for n in resolution[:-1]:
        out.append(out[-1] * n)
    return out


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("size"))


def component_filter(cells: DataFrame, labelled: DataFrame, level: float, least: int, under: float, small: float) -> DataFrame:
    """Cells below the level get `under`, cells of components smaller than `least` get `small`, the rest stay."""
    size = labelled.join(component_sizes(labelled), "component").select(*cell_of(cells), "size")
    out = cells.join(size, cell_of(cells), "left")
    return out.withColumn("value", F.when(V.isNull(), V).when(F.col("size").isNull(), F.lit(under)).when(F.col("size") < least, F.lit(small)).otherwise(V)).drop("size")


def largest_component(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """1 in the largest component (of equals the one with the smallest index), else 0."""
    best = component_sizes(labelled).orderBy(F.desc("size"), "component").limit(1)
    inside = labelled.join(F.broadcast(best.select("component")), "component", "left_semi").select(*cell_of(cells), F.lit(1.0).alias("in"))
    return cells.join(inside, cell_of(cells), "left").withColumn("value", F.coalesce("in", F.lit(0.0))).drop("in")


def squared_distance(cells: DataFrame, resolution: Sequence[int]) -> DataFrame:
    """Exact squared distance to the nearest cell that isn't 0 (unknown counts as 0), with that cell's value as `nearest`.

    Without a source every cell gets d (maxres + 1)^2 for d dimensions. Of equally near cells the one with the smaller
    index along the last axis, then the axis before, counts."""
    far = float(len(axes_of(cells)) * (max(resolution) + 1) ** 2)
    return _from_sources(cells, V.isNotNull() & (V != 0), far)


def _from_sources(cells: DataFrame, source: F.Column, far: float) -> DataFrame:
    """One axis after another; a line of cells goes once through the lower envelope of its sources' parabolas."""
    source = F.coalesce(source, F.lit(False))
    now = cells.select(*cell_of(cells), F.when(source, F.lit(0.0)).otherwise(F.lit(far)).alias("d2"), F.when(source, V).alias("nearest"))
    for a in axes_of(cells):
        others = [c for c in cell_of(cells) if c != a]
        now = now.repartition(*others).sortWithinPartitions(*others, a).mapInArrow(envelopes(others, a, far), now.schema)
    return now


def signed_distance(cells: DataFrame, resolution: Sequence[int]) -> DataFrame:
    """Distance to the cells that aren't 0, minus distance to those that are 0, negative or unknown."""
    out = squared_distance(cells, resolution).select(*cell_of(cells), F.sqrt("d2").alias("outside"))
    turned = cells.withColumn("value", F.when(V > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    inside = squared_distance(turned, resolution).select(*cell_of(cells), F.sqrt("d2").alias("inside"))
    return out.join(inside, cell_of(cells)).select(*cell_of(cells), (F.col("outside") - F.col("inside")).alias("value"))


def voronoi(cells: DataFrame, resolution: Sequence[int]) -> DataFrame:
    """value and squared distance (d2) of the nearest cell that isn't 0. Unknown cells of a 2D grid are sources as well, with an unknown value; without any source the value is 0 and d2 is 3 (maxres + 1)^2."""
    far = 3.0 * (max(resolution) + 1) ** 2
    found = _from_sources(cells, V.isNull() | (V != 0), far)
    return found.select(*cell_of(cells), F.when(F.col("d2") < far, F.col("nearest")).otherwise(0.0).alias("value"), "d2")


def _where_known(cells: DataFrame, result: DataFrame) -> DataFrame:
    known = cells.select(*cell_of(cells), V.isNotNull().alias("known"))
    return result.join(known, cell_of(cells)).select(*cell_of(cells), F.when(F.col("known"), F.col("value")).alias("value"))


def dilate(cells: DataFrame, distance: float, resolution: Sequence[int]) -> DataFrame:
    """1 within the distance of a cell that isn't 0, else 0; unknown cells are no sources and stay unknown."""
    near = squared_distance(cells, resolution).select(*cell_of(cells), F.when(F.col("d2") <= distance * distance, 1.0).otherwise(0.0).alias("value"))
    return _where_known(cells, near)


def erode(cells: DataFrame, distance: float, resolution: Sequence[int]) -> DataFrame:
    """1 farther than the distance from every known cell of at most 1e-20, else 0; unknown cells erode nothing and stay unknown."""
    empty = cells.withColumn("value", F.when(V <= 1e-20, F.lit(1.0)).when(V.isNotNull(), F.lit(0.0)))
    left = squared_distance(empty, resolution).select(*cell_of(cells), F.when(F.col("d2") > distance * distance, 1.0).otherwise(0.0).alias("value"))
    return _where_known(cells, left)


def shortest_paths(edges: DataFrame, sources: DataFrame, most: float = float("inf"), rounds: int = 10_000) -> DataFrame:
    """(node, distance, before) from the nearest source over edges (v0, v1, length) in both directions, up to `most`.

    Relaxation by joins: only nodes whose distance fell in the last round send it on. Ties go to the smaller predecessor."""
    known = sources.select(F.col("node"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("before"))
    front = known
    for _ in range(rounds):
        sent = front.join(edges, front["node"] == edges["v0"]).select(F.col("v1").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), F.col("v0").alias("before")).where(F.col("distance") <= most)
        best = sent.groupBy("node").agg(F.min(F.struct("distance", "before")).alias("b")).select("node", "b.distance", "b.before")
        old = known.select("node", F.col("distance").alias("old"))
        front = step(best.join(old, "node", "left").where(F.col("old").isNull() | (F.col("distance") < F.col("old") - 1e-12)).drop("old"))
        if front.isEmpty():
            return known
        known = step(known.join(front.select("node"), "node", "left_anti").unionByName(front))
    raise RuntimeError(f"still relaxing after {rounds} rounds")
