"""Surfel files: the block database, and single blocks (binary, upc, coloured text).

A database has a directory of blocks with their byte ranges. `directory` reads headers and directories only; `read` deals
the blocks to tasks and each reads its ranges, so one large file is as parallel as its blocks and boxes or time ranges of
the directory prune whole blocks before a byte of them is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: its name, versions, sizes, and the scales of normals, radii and depths.
MAGIC, NEWEST, OLDEST = b"R3SurfelDatabase", 6, 3
NORMAL, RADIUS, DEPTH = 32767.0, 8192.0, 400.0
HEADER_END, BLOCK_END = 1004, 32
#: Records by version, in file order.
_V4 = [("position", "f4", 3), ("timestamp", "f4"), ("normal", "i2", 3), ("tangent", "i2", 3), ("radius", "u2", 2), ("identifier", "u4")]
_COLOR = [("color", "u1", 3), ("flags", "u1")]
RECORDS = {
    3: [("position", "f4", 3), ("normal", "i2", 3), ("radius", "u2"), *_COLOR],
    4: [*_V4, *_COLOR],
    5: [*_V4, ("attribute", "u4"), *_COLOR],
    6: [*_V4, ("attribute", "u4"), ("depth", "u2"), ("elevation", "i2"), *_COLOR],
}
#: A directory entry: place, room, surfels, origin, box, resolution, flags, time origin, time range, largest and smallest identifier.
ENTRY = "QIi3d6ddId2dII"
#: A upc file's header, and its points; places are scaled, and relative to an offset.
UPC_HEADER = "<4sBBHq6d"
UPC_POINT = np.dtype({"names": ["line", "x", "y", "z", "color"], "formats": ["u1", "<i4", "<i4", "<i4", ("<u2", 3)], "offsets": [9, 16, 20, 24, 29], "itemsize": 36})
UPC_ORIGIN = (444965.0, 5029450.0, 0.0)

_XYZ = ("x", "y", "z")
SURFELS = "x double, y double, z double, nx double, ny double, nz double, tx double, ty double, tz double, r0 double, r1 double, depth double, elevation double, timestamp double, surfel_id long, attribute long, r int, g int, b int, flags int"
BLOCKS = "block_id int, n long, ox double, oy double, oz double, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, resolution double, flags long, torigin double, tmin double, tmax double, min_id long, max_id long, place long, bytes long, version int, swapped boolean"
_NAMES, _BLOCK_NAMES = ([c.split()[0] for c in s.split(", ")] for s in (SURFELS, BLOCKS))


def header(data: bytes) -> dict:
    """Version, byte order, and where the directory is; data needs to hold the first 72 bytes only."""
    if data[:32].rstrip(b"\0") != MAGIC:
        raise ValueError("not a surfel database")
    order = "<" if struct.unpack_from("<I", data, 32)[0] == 1 else ">"
    ones = struct.unpack_from(f"{order}2I", data, 32)
    major, minor, place, _, blocks = struct.unpack_from(f"{order}2IQ2I", data, 40)
    if ones != (1, 1) or not OLDEST <= major <= NEWEST:
        raise ValueError(f"no surfel database of versions {OLDEST} to {NEWEST}")
    return {"version": major, "order": order, "place": place, "blocks": blocks}


def entry_size() -> int:
    return struct.calcsize(f"<{ENTRY}") + BLOCK_END


def entries(data: bytes, h: dict) -> pd.DataFrame:
    """Rows of BLOCKS from the bytes of a directory."""
    size = np.dtype(RECORDS[h["version"]]).itemsize
    rows = []
    for i in range(h["blocks"]):
        e = struct.unpack_from(h["order"] + ENTRY, data, i * entry_size())
        rows.append((i, e[2], *e[3:13], e[13], e[14], *e[15:17], e[18], e[17], e[0], e[2] * size, h["version"], h["order"] == ">"))
    return pd.DataFrame(rows, columns=_BLOCK_NAMES)


def records(data: bytes, version: int, swapped: bool = False, origin: tuple = (0.0, 0.0, 0.0), time: float = 0.0) -> pd.DataFrame:
    """Rows of SURFELS. What a version doesn't have is 0; version 5 keeps the elevation in the attribute's upper half."""
    kind = np.dtype(RECORDS[version]).newbyteorder(">" if swapped else "<")
    a = np.frombuffer(data, kind, len(data) // kind.itemsize)
    has, n = kind.names, len(a)
    zero = np.zeros(n)
    wide = lambda f, scale: a[f].astype(np.float64) / scale if f in has else np.zeros((n, 3))
    position, normal, tangent = a["position"].astype(np.float64) + np.array(origin), wide("normal", NORMAL), wide("tangent", NORMAL)
    radius = a["radius"].astype(np.float64).reshape(n, -1) / RADIUS
    attribute = a["attribute"].astype(np.int64) if "attribute" in has else zero.astype(np.int64)
    elevation = a["elevation"] / DEPTH if "elevation" in has else zero
    if version == 5:
        coded = attribute >> 16
        elevation, attribute = np.where(coded != 0, (coded - 32768.0) / DEPTH, 0.0), np.where(coded != 0, attribute & 0xFFFF, attribute)
    columns = [*position.T, *normal.T, *tangent.T, radius[:, 0], radius[:, -1], a["depth"] / DEPTH if "depth" in has else zero, elevation]
    columns += [a["timestamp"].astype(np.float64) + time if "timestamp" in has else zero + time, a["identifier"].astype(np.int64) if "identifier" in has else zero.astype(np.int64), attribute]
    return pd.DataFrame(dict(zip(_NAMES, [*columns, *(a["color"][:, i].astype(np.int32) for i in range(3)), a["flags"].astype(np.int32)], strict=True)))


def _packed(df: pd.DataFrame, origin: np.ndarray, time: float) -> bytes:
    """Records of the newest version. Fractions are cut after adding a half, places are relative to the origin."""
    a = np.zeros(len(df), np.dtype(RECORDS[NEWEST]).newbyteorder("<"))
    of = lambda c: df[c].fillna(0).to_numpy(np.float64) if c in df else np.zeros(len(df))
    cut = lambda c, scale, low, high: np.clip(np.trunc(of(c) * scale + 0.5), low, high)
    for i, c in enumerate(_XYZ):
        a["position"][:, i] = of(c) - origin[i]
        a["normal"][:, i] = cut(f"n{c}", NORMAL, -32767, 32767)
        a["tangent"][:, i] = cut(f"t{c}", NORMAL, -32767, 32767)
        a["color"][:, i] = cut("rgb"[i], 1, 0, 255)
    for i, c in enumerate(("r0", "r1")):
        a["radius"][:, i] = cut(c, RADIUS, 0, 65535)
    a["timestamp"] = of("timestamp") - time
    a["depth"], a["elevation"] = cut("depth", DEPTH, 0, 65535), cut("elevation", DEPTH, -32767, 32767)
    for name, c in (("identifier", "surfel_id"), ("attribute", "attribute"), ("flags", "flags")):
        a[name] = of(c).astype(np.int64)
    return a.tobytes()


def write_database(df: pd.DataFrame) -> bytes:
    """A database of the newest version with a block for each block_id in order; a block's origin is the middle of its box."""
    blocks = [g for _, g in df.groupby("block_id", sort=True)]
    ends = lambda c: (float(df[c].min()), float(df[c].max())) if len(df) and c in df else (0.0, 0.0)
    start = 32 + 4 * 4 + 8 + 4 * 2 + 8 + 8 * 8 + 4 + HEADER_END
    bodies, directory, place = [], [], start
    for g in blocks:
        low, high = g[list(_XYZ)].min().to_numpy(np.float64), g[list(_XYZ)].max().to_numpy(np.float64)
        origin = (low + high) / 2
        t = (float(g["timestamp"].min()), float(g["timestamp"].max())) if "timestamp" in g else (0.0, 0.0)
        ids = (int(g["surfel_id"].max()), int(g["surfel_id"].min())) if "surfel_id" in g else (0, 0)
        body = _packed(g, origin, t[0])
        directory.append(struct.pack(f"<{ENTRY}", place, len(g), len(g), *origin, *low, *high, 0.0, 0, t[0], *t, *ids) + bytes(BLOCK_END))
        bodies.append(body)
        place += len(body)
    box = [ends(c) for c in _XYZ]
    head = struct.pack("<32s4IQIIq6d2dI", MAGIC, 1, 1, NEWEST, 0, place, len(blocks), len(blocks), len(df), *(b[0] for b in box), *(b[1] for b in box), *ends("timestamp"), int(ends("surfel_id")[1]))
    return b"".join([head, bytes(HEADER_END), *bodies, *directory])


def read_database(data: bytes) -> pd.DataFrame:
    """block_id and SURFELS of a whole database."""
    h = header(data)
    parts = [records(data[b.place : b.place + b.bytes], b.version, b.swapped, (b.ox, b.oy, b.oz), b.torigin).assign(block_id=b.block_id) for b in entries(data[h["place"] :], h).itertuples()]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*_NAMES, "block_id"])


def read_upc(data: bytes) -> pd.DataFrame:
    """x, y, z, r, g, b and whether a point was taken from the air."""
    sign, *_, size, n, sx, sy, sz, ox, oy, oz = struct.unpack_from(UPC_HEADER, data)
    if sign != b"UPCf":
        raise ValueError("not a upc file")
    a = np.frombuffer(data, UPC_POINT, min(n, (len(data) - size) // UPC_POINT.itemsize), size)
    out = {c: a[c] * s + o - w for c, s, o, w in zip(_XYZ, (sx, sy, sz), (ox, oy, oz), UPC_ORIGIN, strict=True)}
    return pd.DataFrame(out | {c: np.minimum(a["color"][:, i], 255).astype(np.int32) for i, c in enumerate("rgb")} | {"aerial": a["line"] == ord("0")})


def read_text(data: bytes) -> pd.DataFrame:
    """x, y, z and, where a line goes on with three whole numbers, r, g, b; red otherwise."""
    rows = []
    for w in (line.split() for line in data.decode("utf-8", "replace").splitlines()):
        if w:
            color = tuple(map(int, w[3:6])) if len(w) >= 6 and all(c.isdigit() for c in w[3:6]) else (255, 0, 0)
            rows.append((*map(float, w[:3]), *color))
    return pd.DataFrame(rows, columns=[*_XYZ, "r", "g", "b"])


def write_text(df: pd.DataFrame) -> bytes:
    return "".join(f"{r.x!r} {r.y!r} {r.z!r} {int(r.r)} {int(r.g)} {int(r.b)} 0 0\n" for r in df.itertuples()).encode()


def _open(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])
    return store.open_input_file(root)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Rows of BLOCKS with their `file`, of all databases at a path. Only names are listed on the driver's side; a task reads a header and a directory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf["path"]:
                with _open(file) as f:
                    h = header(f.read_at(72, 0))
                    out = entries(f.read_at(h["blocks"] * entry_size(), h["place"]), h)
                out.insert(0, "file", file)
                yield out

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, f"file string, {BLOCKS}")


def read(blocks: DataFrame, partitions: int | None = None) -> DataFrame:
    """file, block_id and SURFELS of the directory's blocks (filtered as you like), by byte ranges. Rows of the directory are dealt out, not surfels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, mine in pdf.groupby("file"):
                with _open(file) as f:
                    for b in mine.itertuples():
                        out = records(f.read_at(b.bytes, b.place), b.version, b.swapped, (b.ox, b.oy, b.oz), b.torigin)
                        out.insert(0, "file", file)
                        out.insert(1, "block_id", b.block_id)
                        yield out

    dealt = blocks.repartition(partitions, "file", "block_id") if partitions else blocks.repartition("file", "block_id")
    return dealt.mapInPandas(run, f"file string, block_id int, {SURFELS}")


def write(df: DataFrame, folder: str, by: F.Column | str) -> int:
    """A database for each value of `by`; df has block_id and columns of SURFELS. The number of files."""
    from . import files

    return files.write(df, folder, "surfels", by)
