"""Reading and writing the formats with Spark: a file is a task's unit on the way in and on the way out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import FORMATS


def kind_of(path: str) -> str:
    """The format that a file's suffix names."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no format for .{suffix}; there are {', '.join(sorted(FORMATS))}")
    return suffix


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The rows of all files at a path (a file, folder or glob of any store that Spark reads), with each row's `file`."""
    schema, decode, _ = FORMATS[kind or kind_of(path)]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                out = decode(bytes(content))[names]
                out.insert(0, "file", file)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {schema}")


def encoded(df: DataFrame, kind: str, by: str) -> DataFrame:
    """(name, content): the file that each value of `by` becomes. A file's rows meet in one task, as the file is whole."""
    encode = FORMATS[kind][2]
    return df.groupBy(by).applyInPandas(lambda key, pdf: pd.DataFrame({"name": [f"{key[0]}.{kind}"], "content": [encode(pdf)]}), "name string, content binary")


def write(df: DataFrame, folder: str, kind: str, by: str) -> int:
    """Write one file for each value of `by` into a folder that driver and executors share; the number of files.

    Each task writes under a name of its own and renames at the end, so a lost or repeated task leaves whole files only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(bytes(content))
                store.move(part, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return encoded(df, kind, by).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def mesh_rows(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices (vertex_id, x, y, z) and faces (face_id, v0, v1, v2) as the one table that mesh files are written from."""
    none = F.lit(None).cast("double")
    v = vertices.select(F.lit("v").alias("part"), F.col("vertex_id").cast("long").alias("id"), "x", "y", "z", *(none.alias(c) for c in "abc"))
    return v.union(faces.select(F.lit("f"), F.col("face_id").cast("long"), none, none, none, *(F.col(c).cast("double") for c in ("v0", "v1", "v2"))))


def vertices(mesh: DataFrame) -> DataFrame:
    return mesh.where("part = 'v'").select("file", F.col("id").alias("vertex_id"), "x", "y", "z")


def faces(mesh: DataFrame) -> DataFrame:
    return mesh.where("part = 'f'").select("file", F.col("id").alias("face_id"), *(F.col(c).cast("long").alias(n) for c, n in zip("abc", ("v0", "v1", "v2"), strict=True)))
