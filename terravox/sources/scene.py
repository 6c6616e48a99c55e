"""Scene files in text form (nodes, objects, labels, features, relationships, assignments, scans, images, properties).

A file is a stream of words whose lengths stand in the stream itself, so a file is a task's unit; files run side by side.
`read` gives one table of records, `tables` a typed table for each kind out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POSE = "px py pz tx ty tz ux uy uz timestamp"

#: Fixed values of the format: each kind's tag, whether it has a name, its numbers in order, how many unused words follow,
#: and the lists after them as (column, the number that holds its length).
KINDS = {
    "comment": ("C", True, "", 0, ()),
    "node": ("N", True, "parent parts blocks unused complexity resolution", 8, (("refs", "blocks"),)),
    "object": ("O", True, "identifier parent parts nodes values complexity flags", 7, (("operands", "values"), ("refs", "nodes"))),
    "label": ("L", True, "identifier keystroke unused parent parts r g b flags", 3, ()),
    "feature": ("F", True, "minimum maximum weight type format", 1, ()),
    "object_relationship": ("OR", False, "type objects values", 4, (("refs", "objects"), ("operands", "values"))),
    "label_relationship": ("LR", False, "type labels values", 4, (("refs", "labels"), ("operands", "values"))),
    "assignment": ("A", False, "object label confidence originator", 4, ()),
    "scan": ("S", True, f"{_POSE} node width height xfocal xcenter ycenter flags yfocal", 1, ()),
    "image": ("I", True, f"{_POSE} scan width height xfocal yfocal xcenter ycenter flags distortion shutter", 2, ()),
    "object_property": ("OP", False, "type object values", 4, (("operands", "values"),)),
    "label_property": ("LP", False, "type label values", 4, (("operands", "values"),)),
}
#: The order in which the header counts the kinds.
COUNTED = ["node", "object", "label", "feature", "object_relationship", "label_relationship", "assignment", "scan", "object_property", "label_property", "image", "comment"]
NO_NAME, GRID_FEATURE, COUNTS_AFTER = "None", 3, 3
#: Blanks of a name and what stands for them.
BLANKS = {" ": "+", "\t": "^", "\n": "&"}
#: Numbers after an image with a lens distortion, and after one with a rolling shutter.
DISTORTION, SHUTTER = 5, 20

SCHEMA = "kind string, id long, name string, numbers array<double>, refs array<long>, operands array<double>, path string"
_WHOLE = {"parent", "parts", "blocks", "nodes", "values", "objects", "labels", "identifier", "keystroke", "flags", "type", "format", "object", "label", "originator", "node", "scan", "width", "height", "distortion", "shutter"}


def _name(word: str) -> str | None:
    return None if word == NO_NAME else word.translate({ord(v): k for k, v in BLANKS.items()})


def decode(data: bytes) -> pd.DataFrame:
    """Rows of SCHEMA; kind `scene` has the file's version, its name and the 16 numbers of its transformation."""
    words = iter(data.decode("utf-8", "replace").split())
    take = lambda n: [float(next(words)) for _ in range(n)]
    try:
        if next(words) != "SSA":
            raise ValueError("not a scene file")
        version, name = next(words), _name(next(words))
        counts = dict(zip(COUNTED, map(int, take(len(COUNTED))), strict=True))
        take(COUNTS_AFTER)
        matrix = []
        if version != "1.0":
            if next(words) != "T":
                raise ValueError("no transformation")
            matrix = take(16)
        rows = [("scene", 0, name, matrix, [], [], version)]
        for kind, (tag, named, fields, unused, lists) in KINDS.items():
            fields = fields.split()
            for i in range(counts[kind]):
                found = next(words)
                if found != tag and not (kind == "image" and found == "S"):
                    raise ValueError(f"{kind} {i}: {found} where {tag} should be")
                name = _name(next(words)) if named else None
                numbers = take(len(fields))
                for _ in range(unused):
                    next(words)
                of = dict(zip(fields, numbers, strict=True))
                parts = {"refs": [], "operands": []}
                for column, length in lists:
                    parts[column] = take(int(of[length]))
                path = None
                if kind == "feature" and of["format"] != 0 and of["type"] == GRID_FEATURE:
                    path = _name(next(words))
                if kind == "image":
                    parts["operands"] = take(DISTORTION * (of["distortion"] != 0) + SHUTTER * (of["shutter"] != 0))
                rows.append((kind, i, name, numbers, [int(v) for v in parts["refs"]], parts["operands"], path))
    except StopIteration:
        raise ValueError("the scene file ends early") from None
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def encode(df: pd.DataFrame) -> bytes:
    """The file of one scene's records. Lengths are taken from the lists; an empty name is written as no name."""
    word = lambda s: s.translate({ord(k): v for k, v in BLANKS.items()}) if isinstance(s, str) and s else NO_NAME
    number = lambda v: str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))
    by = {k: g.sort_values("id") for k, g in df.groupby("kind")}
    scene = by["scene"].iloc[0] if "scene" in by else None
    matrix = list(scene["numbers"]) if scene is not None and len(scene["numbers"]) else [float(i % 5 == 0) for i in range(16)]
    counts = [str(len(by.get(k, ()))) for k in COUNTED]
    lines = ["SSA 1.1", " ".join([word(scene["name"] if scene is not None else None), *counts, *"0" * COUNTS_AFTER]), "T " + " ".join(map(number, matrix))]
    for kind, (tag, named, fields, unused, lists) in KINDS.items():
        fields = fields.split()
        for r in by[kind].itertuples(index=False) if kind in by else ():
            of = dict(zip(fields, r.numbers, strict=True))
            of |= {length: len(getattr(r, column)) for column, length in lists}
            lines.append(" ".join([tag, *([word(r.name)] if named else []), *map(number, of.values()), *"0" * unused]))
            lines += [" ".join(map(number, getattr(r, column))) for column, _ in lists]
            if kind == "feature" and of["type"] == GRID_FEATURE:
                lines.append(word(r.path))
            if kind == "image":
                lines.append(" ".join(map(number, r.operands)))
    return ("\n".join(lines) + "\n").encode()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all scene files at a path, with their `file`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                out = decode(bytes(content))
                out.insert(0, "file", file)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {SCHEMA}")


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """A typed table for each kind: file, <kind>_id, name, the kind's numbers, refs and operands."""
    out = {}
    for kind, (_, named, fields, _, _) in KINDS.items():
        columns = [F.col("numbers")[i].cast("long" if f in _WHOLE else "double").alias(f"{f}_id" if f in ("parent", "object", "label", "node", "scan") else f) for i, f in enumerate(fields.split()) if f != "unused"]
        out[kind] = records.where(F.col("kind") == kind).select("file", F.col("id").alias(f"{kind}_id"), *(["name"] if named else []), *columns, "refs", "operands", "path")
    return out
