"""Text and JSON catalogs as several tables: house files, camera lists, segment and object JSON, label and assignment lists.

All of it is Spark's own text, CSV and JSON reading with explicit schemas; rows are told apart by their tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_P, _N, _BOX = "x double, y double, z double", "nx double, ny double, nz double", "xmin double, ymin double, zmin double, xmax double, ymax double, zmax double"
_PAIR = "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"

#: Columns of a house file's rows after the tag; `_` is a field that isn't used.
HOUSE = {
    "levels": ("L", f"level_id int, _ int, label string, {_P}, {_BOX}"),
    "regions": ("R", f"region_id int, level_id int, _ int, _ int, label string, {_P}, {_BOX}, height double"),
    "portals": ("P", f"portal_id int, region0_id int, region1_id int, label string, {_PAIR}"),
    "surfaces": ("S", f"surface_id int, region_id int, _ int, label string, {_P}, {_N}, {_BOX}"),
    "vertices": ("V", f"vertex_id int, surface_id int, label string, {_P}, {_N}"),
    "panoramas": ("P", f"name string, panorama_id int, region_id int, _ int, {_P}"),
    "images": ("I", "image_id int, panorama_id int, name string, camera int, yaw int, " + ", ".join(f"e{i} double" for i in range(16)) + ", " + ", ".join(f"k{i} double" for i in range(9)) + f", width int, height int, {_P}"),
    "categories": ("C", "category_id int, label_id int, label_name string, mpcat40_id int, mpcat40_name string"),
}


def house(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each kind of row, with the `file` that it stands in. Portals and panoramas share a tag: a portal's first field is a number."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("w"))
    out = {}
    for name, (tag, schema) in HOUSE.items():
        rows = lines.where(F.col("w")[0] == tag)
        if tag == "P":
            numbered = F.get("w", F.lit(1)).rlike(r"^-?\d+$")
            rows = rows.where(numbered if name == "portals" else ~numbered)
        columns = [F.get("w", F.lit(i)).try_cast(kind).alias(c) for i, (c, kind) in enumerate((f.split() for f in schema.split(", ")), 1) if c != "_"]
        out[name] = rows.select("file", *columns)
    return out


def house_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): rows of a house file again, fields that aren't used as 0."""
    parts = []
    for name, (tag, schema) in HOUSE.items():
        if name in tables:
            fields = [F.lit("0") if c == "_" else F.coalesce(F.col(c).cast("string"), F.lit("0")) for c, _ in (f.split() for f in schema.split(", "))]
            parts.append(tables[name].select(F.concat_ws(" ", F.lit(tag), *fields).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def categories(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated category map with a header."""
    return spark.read.csv(path, sep="\t", header=True)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, face_id, segment_id) of segIndices in a JSON file."""
    j = spark.read.schema("segIndices array<int>").json(path, multiLine=True)
    return j.select(F.col("_metadata.file_path").alias("file"), F.posexplode("segIndices").alias("face_id", "segment_id"))


def segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, object_id, label, segment_id) of segGroups in a JSON file."""
    j = spark.read.schema("segGroups array<struct<id:int,objectId:int,label:string,segments:array<int>>>").json(path, multiLine=True)
    g = j.select(F.col("_metadata.file_path").alias("file"), F.explode("segGroups").alias("g"))
    return g.select("file", F.coalesce("g.objectId", "g.id").alias("object_id"), "g.label", F.explode("g.segments").alias("segment_id"))


def nerf_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, image_path, pose as 16 numbers by rows, camera_angle_x) of a transforms file."""
    j = spark.read.schema("camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>").json(path, multiLine=True)
    f = j.select(F.col("_metadata.file_path").alias("file"), "camera_angle_x", F.explode("frames").alias("f"))
    return f.select("file", F.col("f.file_path").alias("image_path"), F.flatten("f.transform_matrix").alias("pose"), "camera_angle_x")


def configuration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Intrinsics (file, line, numbers) and scans (file, line, depth, color, pose) of camera configuration files."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    words = lines.select("file", "line", F.split(F.trim("text"), r"\s+").alias("w"))
    numbers = lambda first: F.transform(F.slice("w", first, F.greatest(F.size("w") - first + 1, F.lit(0))), lambda v: v.try_cast("double"))
    intrinsics = words.where(F.col("w")[0].isin("intrinsics", "intrinsics_matrix", "intrinsics_distortion")).select("file", "line", F.col("w")[0].alias("kind"), F.filter(numbers(2), lambda v: v.isNotNull()).alias("numbers"))
    scans = words.where(F.col("w")[0].isin("scan", "image", "frame")).select("file", "line", F.get("w", F.lit(1)).alias("depth"), F.get("w", F.lit(2)).alias("color"), F.filter(numbers(4), lambda v: v.isNotNull()).alias("pose"))
    return intrinsics, scans


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, identifier, parent, r, g, b) of a label list: white-space separated, `#` begins a comment."""
    w = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    number = lambda i, kind: F.get("w", F.lit(i)).try_cast(kind)
    return w.select(F.col("w")[0].alias("name"), number(1, "int").alias("identifier"), F.get("w", F.lit(2)).alias("parent"), number(3, "double").alias("r"), number(4, "double").alias("g"), number(5, "double").alias("b"))


def assignment_list(spark: SparkSession, path: str, objects: DataFrame, named: DataFrame) -> DataFrame:
    """(object_id, label_id, confidence, originator) of rows `object label confidence originator`, by two equi-joins on names."""
    w = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"))
    rows = w.select(F.col("w")[0].alias("object_name"), F.get("w", F.lit(1)).alias("label_name"), F.get("w", F.lit(2)).try_cast("double").alias("confidence"), F.get("w", F.lit(3)).try_cast("int").alias("originator"))
    o = objects.select("object_id", F.col("name").alias("object_name"))
    n = named.select("label_id", F.col("name").alias("label_name"))
    return rows.join(o, "object_name").join(n, "label_name").select("object_id", "label_id", "confidence", "originator")
