"""Sources and sinks: each query writes a view as files of a format and gives what reading them again finds."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import Later, query
from .q_models import _MESH, _mesh
from .views import cells2, cells3, props, surfels, table

G = Later("operators.graph")
FILES = Later("sources.files")
SCENE = Later("sources.scene")
SURFELS = Later("sources.surfels")


def _folder(spark) -> str:
    path = f"{G.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    atexit.register(G._remove, spark, path)
    return path


def _key(by: str) -> F.Column:
    """The value that a file was written for, out of its name."""
    return F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).cast("long").alias(by)


def _again(spark, df: DataFrame, kind: str, by: str) -> DataFrame:
    path = _folder(spark)
    FILES.write(df, path, kind, by)
    back = FILES.read(spark, f"{path}/*.{kind}", kind)
    return back.select(_key(by), *back.columns[1:])


_F = "CAST(CAST({0} AS FLOAT) AS DOUBLE)"


def _f(*columns: str) -> str:
    return ", ".join(f"{_F.format(c)} AS {c}" for c in columns)


def _units(kind: str) -> str:
    """Normals of length 1, out of float or double ones."""
    n = [_F.format(c) if kind == "float" else c for c in ("nx", "ny", "nz")]
    length = "sqrt({0} * {0} + {1} * {1} + {2} * {2})".format(*n)
    return ", ".join(f"round({v} / CASE WHEN {length} > 0 THEN {length} ELSE 1 END + 1.23e-8, 6) AS {c}" for v, c in zip(n, ("nx", "ny", "nz"), strict=True))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1.23e-8, 6) for c in ("nx", "ny", "nz")})


#: Files of points, one for each block.
for _kind in ("xyz", "vts"):
    query("SELECT block_id, x, y, z FROM surfels", "surfels", name=f"source_{_kind}")(lambda spark, sf, kind=_kind: _again(spark, surfels(spark, sf), kind, "block_id"))
query(f"SELECT block_id, x, y, z, {_units('double')} FROM surfels", "surfels", name="source_xyzn")(lambda spark, sf: _rounded(_again(spark, surfels(spark, sf), "xyzn", "block_id")))
query(f"SELECT block_id, {_f('x', 'y', 'z')}, {_units('float')} FROM surfels", "surfels", name="source_pts")(lambda spark, sf: _rounded(_again(spark, surfels(spark, sf), "pts", "block_id")))


@query(f"SELECT block_id, {_f('x', 'y', 'z')}, {_F.format('elevation')} AS value FROM surfels", "surfels")
def source_sdf(spark, sf):
    return _again(spark, surfels(spark, sf).withColumnRenamed("elevation", "value"), "sdf", "block_id")


@query(f"SELECT block_id, {_f('x', 'y', 'z', 'timestamp')}, {_units('float')}, 0.25::DOUBLE AS r, 0.5::DOUBLE AS g, 1.0::DOUBLE AS b, object_id AS category_id, flags AS instance_id, {_F.format('elevation')} AS value FROM surfels", "surfels")
def source_pset(spark, sf):
    s = surfels(spark, sf).select("*", F.lit(0.25).alias("r"), F.lit(0.5).alias("g"), F.lit(1.0).alias("b"), F.col("object_id").alias("category_id"), F.col("flags").alias("instance_id"), F.col("elevation").alias("value"))
    return _rounded(_again(spark, s, "pset", "block_id"))


@query(f"""WITH m AS (SELECT *, block_id // 4 AS part FROM surfels),
             o AS (SELECT block_id, (min(x) + max(x)) / 2 AS ox, (min(y) + max(y)) / 2 AS oy, (min(z) + max(z)) / 2 AS oz, min(timestamp) AS ot FROM m GROUP BY 1),
             n AS (SELECT part, block_id, dense_rank() OVER (PARTITION BY part ORDER BY block_id)::INTEGER - 1 AS place FROM (SELECT DISTINCT part, block_id FROM m))
           SELECT part, place AS block_id, surfel_id, {_F.format('x - ox')} + ox AS x, {_F.format('y - oy')} + oy AS y, {_F.format('z - oz')} + oz AS z, {_F.format('timestamp - ot')} + ot AS timestamp,
             {', '.join(f'greatest(-32767, least(32767, trunc(n{c} * 32767 + 0.5))) / 32767 AS n{c}' for c in 'xyz')}, greatest(-32767, least(32767, trunc(elevation * 400 + 0.5))) / 400 AS elevation, flags::INTEGER AS flags
           FROM m JOIN o USING (block_id) JOIN n USING (part, block_id) WHERE place > 0""", "surfels")
def source_surfels(spark, sf):
    """Databases of four blocks each; of every one all blocks but the first are read, by their byte ranges."""
    path = _folder(spark)
    SURFELS.write(surfels(spark, sf).withColumn("part", F.floor(F.col("block_id") / 4).cast("long")), path, "part")
    back = SURFELS.read(SURFELS.directory(spark, f"{path}/*.surfels").where("block_id > 0"))
    return back.select(_key("part"), "block_id", "surfel_id", "x", "y", "z", "timestamp", "nx", "ny", "nz", "elevation", "flags")


#: Rasters and volumes, one file each.
for _kind, _value in {"raw": _F.format("value"), "pfm": _F.format("value"), "grd2": "value", "png16": "least(65535, round_even(coalesce(value, 0), 0))", "pnm": "least(65535, round_even(coalesce(value, 0), 0))"}.items():
    query(f"SELECT grid_id::BIGINT AS grid_id, ix, iy, {_value}::DOUBLE AS value FROM cells2", "cells2", name=f"source_{_kind}")(lambda spark, sf, kind=_kind: _again(spark, cells2(spark, sf), kind, "grid_id"))
for _kind, _value in {"grd": _F.format("value"), "ccp4": _F.format("value"), "insight": _F.format("value"), "grdascii": "value", "dx": "value"}.items():
    query(f"SELECT grid_id::BIGINT AS grid_id, ix, iy, iz, {_value} AS value FROM cells3", "cells3", name=f"source_{_kind}")(lambda spark, sf, kind=_kind: _again(spark, cells3(spark, sf), kind, "grid_id"))


def _mesh_sql(place: str) -> str:
    x, y, z = (place.format(c) for c in ("ix::DOUBLE", "iy::DOUBLE", "z"))
    return f"""WITH {_MESH}, n AS (SELECT *, row_number() OVER (ORDER BY vertex_id) - 1 AS id FROM v)
        SELECT 1::BIGINT AS mesh_id, 'v' AS part, id, {x} AS x, {y} AS y, {z} AS z, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c FROM n
        UNION ALL SELECT 1, 'f', row_number() OVER (ORDER BY face_id) - 1, NULL, NULL, NULL, a.id, b.id, c.id FROM t JOIN n a ON a.vertex_id = v0 JOIN n b ON b.vertex_id = v1 JOIN n c ON c.vertex_id = v2"""


for _kind, _place in {"off": "{0}", "obj": "{0}", "ray": "{0}", "catt": "{0}", "hoppe": "{0}", "ifs": _F}.items():
    query(_mesh_sql(_place), "cells2", name=f"source_{_kind}")(lambda spark, sf, kind=_kind: _again(spark, FILES.mesh_rows(*_mesh(spark, sf)).withColumn("mesh_id", F.lit(1)), kind, "mesh_id"))


def _long(spark, sf) -> DataFrame:
    """The two properties in long form under the names that a matrix file gives its columns."""
    p = props(spark, sf).select("*", F.lit(1).alias("file_id"))
    return p.select("file_id", "vertex_id", F.explode(F.create_map(F.lit("p0"), F.col("price"), F.lit("p1"), F.col("size"))).alias("name", "value"))


for _kind, _value in {"npy": "value", "prp": _F.format("value")}.items():
    query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY vertex_id) - 1 AS place FROM props)
        SELECT 1::BIGINT AS file_id, place AS vertex_id, name, {_value} AS value FROM (SELECT place, 'p0' AS name, price AS value FROM n UNION ALL SELECT place, 'p1', size FROM n)""", "props", name=f"source_{_kind}")(lambda spark, sf, kind=_kind: _again(spark, _long(spark, sf), kind, "file_id"))


@query("SELECT n_name AS object, r_name AS label, 0.25::DOUBLE + r_regionkey AS confidence, n_nationkey::BIGINT AS identifier FROM nation JOIN region ON r_regionkey = n_regionkey")
def source_scene(spark, sf):
    """Nations as objects and regions as labels of a scene file, read again and joined through its assignments."""
    longs, doubles = F.array().cast("array<long>"), F.array().cast("array<double>")
    number = lambda *v: F.array(*(F.lit(x).cast("double") if isinstance(x, int | float) else x.cast("double") for x in v))
    rest = [longs.alias("refs"), doubles.alias("operands"), F.lit(None).cast("string").alias("path"), F.lit(1).alias("scene_id")]
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key, home = F.col("n_nationkey"), F.col("n_regionkey")
    objects = nation.select(F.lit("object").alias("kind"), key.cast("long").alias("id"), F.col("n_name").alias("name"), number(key, -1, 0, 0, 0, 0, 0).alias("numbers"), *rest)
    named = region.select(F.lit("label"), F.col("r_regionkey").cast("long"), F.col("r_name"), number(F.col("r_regionkey"), 0, 0, -1, 0, 0, 0, 0, 0), *rest)
    assigned = nation.select(F.lit("assignment"), key.cast("long"), F.lit(None).cast("string"), number(key, home, home + 0.25, 1), *rest)
    path = _folder(spark)
    FILES.write(objects.union(named).union(assigned), path, "scene", "scene_id")
    t = SCENE.tables(SCENE.read(spark, f"{path}/*.scene"))
    o, n = t["object"].select("object_id", F.col("name").alias("object"), "identifier"), t["label"].select("label_id", F.col("name").alias("label"))
    return t["assignment"].select("object_id", "label_id", "confidence").join(o, "object_id").join(n, "label_id").select("object", "label", "confidence", "identifier")
