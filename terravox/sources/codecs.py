"""File formats as pure functions between bytes and pandas frames.

Points: xyz, xyzn (text), pts, sdf, pset (float32 tuples), vts (indexed text). Grids: grd (2D and 3D), vox, raw, pfm,
pnm, png16, grdascii, dx, phi, ccp4, insight. Meshes: off, obj, ply (ascii and binary), stl, ifs, ray, catt, hoppe.
Properties: arff, npy, prp, val. Molecules: pdb. Surfel blocks and scenes have modules of their own.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd

from . import mesh_text, scene, surfels, volumes

#: Fixed values of the formats: the magic number of raw rasters and the float tuples of binary point files.
RAW_MAGIC = 54321
TUPLES = {
    "pts": ["x", "y", "z", "nx", "ny", "nz"],
    "sdf": ["x", "y", "z", "value"],
    "pset": ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "timestamp", "category_id", "instance_id", "value", "_13", "_14", "_15"],
}
UNKNOWN2 = -321.0


def _points_text(data: bytes, names: list[str], skip: int = 0) -> pd.DataFrame:
    rows = [line.split() for line in data.decode("utf-8", "replace").splitlines() if line.strip() and not line.lstrip().startswith("#")]
    x = np.array([[float(v) for v in r[skip : skip + len(names)]] for r in rows if len(r) >= skip + len(names)], np.float64).reshape(-1, len(names))
    return pd.DataFrame(x, columns=names)


def _unit_normals(df: pd.DataFrame) -> pd.DataFrame:
    if "nx" in df:
        n = np.sqrt((df[["nx", "ny", "nz"]] ** 2).sum(axis=1))
        df[["nx", "ny", "nz"]] = df[["nx", "ny", "nz"]].div(n.where(n > 0, 1), axis=0)
    return df


def read_tuples(data: bytes, kind: str) -> pd.DataFrame:
    names = TUPLES[kind]
    whole = len(data) // (4 * len(names)) * len(names)
    df = pd.DataFrame(np.frombuffer(data, "<f4", whole).reshape(-1, len(names)).astype(np.float64), columns=names)
    df = _unit_normals(df[[c for c in names if c[0] != "_"]].copy())
    for c in ("category_id", "instance_id"):
        if c in df:
            df[c] = (df[c] + 0.5).astype("int64")
    return df


def write_tuples(df: pd.DataFrame, kind: str) -> bytes:
    columns = [df[c].to_numpy(np.float32) if c in df else np.zeros(len(df), np.float32) for c in TUPLES[kind]]
    return np.stack(columns, axis=1).astype("<f4").tobytes() if len(df) else b""


def _cells(values: np.ndarray, unknown: float | None = None) -> pd.DataFrame:
    """values indexed [z][y][x] or [y][x]."""
    at = np.indices(values.shape).reshape(values.ndim, -1)[::-1]
    out = pd.DataFrame({a: i.astype(np.int32) for a, i in zip(("ix", "iy", "iz"), at, strict=False)})
    v = values.reshape(-1).astype(np.float64)
    out["value"] = np.where(np.abs(v - unknown) <= 1e-6, np.nan, v) if unknown is not None else v
    return out


def _dense(df: pd.DataFrame, unknown: float = 0.0) -> np.ndarray:
    axes = [a for a in ("iz", "iy", "ix") if a in df]
    shape = [int(df[a].max()) + 1 if len(df) else 0 for a in axes]
    out = np.full(shape, unknown, np.float64)
    known = df["value"].notna()
    out[tuple(df.loc[known, a].to_numpy() for a in axes)] = df.loc[known, "value"].to_numpy()
    return out


def read_grd3(data: bytes) -> pd.DataFrame:
    nx, ny, nz = struct.unpack_from("<3i", data)
    return _cells(np.frombuffer(data, "<f4", nx * ny * nz, 12 + 64).reshape(nz, ny, nx))


def write_grd3(df: pd.DataFrame) -> bytes:
    v = _dense(df)
    return struct.pack("<3i", *v.shape[::-1]) + np.eye(4, dtype="<f4").tobytes() + v.astype("<f4").tobytes()


def read_grd2(data: bytes) -> pd.DataFrame:
    nx, ny = struct.unpack_from("<2i", data)
    return _cells(np.frombuffer(data, "<f8", nx * ny, 8 + 72).reshape(ny, nx), UNKNOWN2)


def write_grd2(df: pd.DataFrame) -> bytes:
    v = _dense(df, UNKNOWN2)
    return struct.pack("<2i", *v.shape[::-1]) + np.eye(3, dtype="<f8").tobytes() + v.astype("<f8").tobytes()


def read_vox(data: bytes) -> pd.DataFrame:
    (n,) = struct.unpack_from("<i", data)
    return _cells(np.frombuffer(data, "<f4", n**3, 4).reshape(n, n, n))


def write_vox(df: pd.DataFrame) -> bytes:
    v = _dense(df)
    if len(set(v.shape)) != 1:
        raise ValueError("a voxel file's grid has equal sides")
    return struct.pack("<i", v.shape[0]) + v.astype("<f4").tobytes()


def read_raw(data: bytes) -> pd.DataFrame:
    magic, nx, ny, channels = struct.unpack_from("<4I", data)
    if magic != RAW_MAGIC or channels != 1:
        raise ValueError("not a raw raster of one channel")
    return _cells(np.frombuffer(data, "<f4", nx * ny, 16).reshape(ny, nx), UNKNOWN2)


def write_raw(df: pd.DataFrame) -> bytes:
    v = _dense(df, UNKNOWN2)
    return struct.pack("<4I", RAW_MAGIC, *v.shape[::-1], 1) + v.astype("<f4").tobytes()


def _header(data: bytes, n: int) -> tuple[list[str], int]:
    """n white-space separated words of a text header, comments aside, and where the body begins."""
    found, at = [], 0
    while len(found) < n:
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\S+)").match(data, at)
        if not m:
            raise ValueError("header ends early")
        found.append(m[1].decode())
        at = m.end()
    return found, at + 1


def read_pfm(data: bytes) -> pd.DataFrame:
    (kind, w, h, scale), at = _header(data, 4)
    if kind != "Pf":
        raise ValueError("not a float map of one channel")
    return _cells(np.frombuffer(data, "<f4" if float(scale) < 0 else ">f4", int(w) * int(h), at).reshape(int(h), int(w)), UNKNOWN2)


def write_pfm(df: pd.DataFrame) -> bytes:
    v = _dense(df, UNKNOWN2)
    return f"Pf\n{v.shape[1]} {v.shape[0]}\n-1.0\n".encode() + v.astype("<f4").tobytes()


def read_pnm(data: bytes) -> pd.DataFrame:
    """Grey maps, text or binary; the file's first row is the raster's top one."""
    (kind, w, h, most), at = _header(data, 4)
    w, h = int(w), int(h)
    if kind == "P2":
        v = np.array(data[at - 1 :].split()[: w * h], np.float64)
    elif kind == "P5":
        v = np.frombuffer(data, ">u2" if int(most) > 255 else "u1", w * h, at).astype(np.float64)
    else:
        raise ValueError(f"{kind} isn't a grey map")
    return _cells(v.reshape(h, w)[::-1])


def write_pnm(df: pd.DataFrame) -> bytes:
    v = np.clip(np.rint(_dense(df)), 0, 65535).astype(">u2")[::-1]
    return f"P5\n{v.shape[1]} {v.shape[0]}\n65535\n".encode() + v.tobytes()


def read_grdascii(data: bytes) -> pd.DataFrame:
    v = np.array(data.split(), np.float64)
    nx, ny, nz = v[:3].astype(int)
    return _cells(v[19 : 19 + nx * ny * nz].reshape(nz, ny, nx))


def write_grdascii(df: pd.DataFrame) -> bytes:
    v = _dense(df)
    lines = [" ".join(map(str, v.shape[::-1])), *(" ".join(map(repr, r)) for r in np.eye(4).tolist()), " ".join(map(repr, v.reshape(-1).tolist()))]
    return ("\n".join(lines) + "\n").encode()


def read_dx(data: bytes) -> pd.DataFrame:
    """z runs fastest in the file."""
    lines = [x for x in data.decode().splitlines() if not x.startswith("#")]
    nx, ny, nz = map(int, lines[0].split()[-3:])
    first = next(i for i, x in enumerate(lines) if "data follows" in x) + 1
    v = np.array(" ".join(lines[first:]).split()[: nx * ny * nz], np.float64)
    return _cells(v.reshape(nx, ny, nz).transpose(2, 1, 0))


def write_dx(df: pd.DataFrame) -> bytes:
    v = _dense(df)
    nz, ny, nx = v.shape
    flat = v.transpose(2, 1, 0).reshape(-1)
    head = [f"object 1 class gridpositions counts {nx} {ny} {nz}", "origin 0 0 0", "delta 1 0 0", "delta 0 1 0", "delta 0 0 1", f"object 2 class gridconnections counts {nx} {ny} {nz}", f"object 3 class array type double rank 0 items {len(flat)} data follows"]
    return ("\n".join([*head, *(" ".join(map(repr, flat[i : i + 3].tolist())) for i in range(0, len(flat), 3))]) + "\n").encode()


def mesh_frame(vertices: np.ndarray, faces: list[list[int]]) -> pd.DataFrame:
    """One table of both: part `v` (x, y, z) and part `f` (a, b, c), polygons as fans of triangles."""
    v = pd.DataFrame(np.asarray(vertices, np.float64).reshape(-1, 3), columns=["x", "y", "z"])
    v.insert(0, "part", "v")
    v.insert(1, "id", np.arange(len(v)))
    fans = [(f[0], f[i], f[i + 1]) for f in faces for i in range(1, len(f) - 1)]
    t = pd.DataFrame(fans, columns=["a", "b", "c"]).astype("float64")
    t.insert(0, "part", "f")
    t.insert(1, "id", np.arange(len(t)))
    return pd.concat([v, t], ignore_index=True)[["part", "id", "x", "y", "z", "a", "b", "c"]]


def mesh_arrays(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places by vertex id, and corners as places in that order, so that ids may have gaps."""
    v = df[df["part"] == "v"].sort_values("id")
    corners = df[df["part"] == "f"].sort_values("id")[["a", "b", "c"]].to_numpy().astype(np.int64)
    ids = v["id"].to_numpy(np.int64)
    if len(corners) and not np.isin(corners, ids).all():
        raise ValueError("a face has a corner that is no vertex")
    return v[["x", "y", "z"]].to_numpy(np.float64), np.searchsorted(ids, corners)


def read_off(data: bytes) -> pd.DataFrame:
    words = [w for line in data.decode().splitlines() for w in line.split("#")[0].split()]
    if words[0].upper().startswith("OFF"):
        words = words[1:]
    nv, nf = int(words[0]), int(words[1])
    v = np.array(words[3 : 3 + 3 * nv], np.float64).reshape(nv, 3)
    faces, at = [], 3 + 3 * nv
    for _ in range(nf):
        n = int(words[at])
        faces.append([int(w) for w in words[at + 1 : at + 1 + n]])
        at += n + 1
    return mesh_frame(v, faces)


def write_off(df: pd.DataFrame) -> bytes:
    v, f = mesh_arrays(df)
    lines = ["OFF", f"{len(v)} {len(f)} 0", *(" ".join(map(repr, p)) for p in v.tolist()), *(f"3 {a} {b} {c}" for a, b, c in f.tolist())]
    return ("\n".join(lines) + "\n").encode()


def read_obj(data: bytes) -> pd.DataFrame:
    """Faces may name vertices from the end by negative numbers, and texture and normal indices after slashes."""
    v, faces = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            v.append([float(c) for c in w[1:4]])
        elif w[:1] == ["f"]:
            ids = [int(c.split("/")[0]) for c in w[1:]]
            faces.append([i - 1 if i > 0 else len(v) + i for i in ids])
    return mesh_frame(np.array(v), faces)


def write_obj(df: pd.DataFrame) -> bytes:
    v, f = mesh_arrays(df)
    return ("\n".join([*("v " + " ".join(map(repr, p)) for p in v.tolist()), *(f"f {a + 1} {b + 1} {c + 1}" for a, b, c in f.tolist())]) + "\n").encode()


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_ply(data: bytes) -> pd.DataFrame:
    """ASCII or binary of either byte order; properties beyond positions and vertex lists are passed over."""
    end = data.index(b"end_header") + len(b"end_header")
    lines = data[:end].decode().split("\n")
    body = data[data.index(b"\n", end) + 1 :]
    style = next(x.split()[1] for x in lines if x.startswith("format"))
    elements: list[tuple[str, int, list[list[str]]]] = []
    for line in lines:
        w = line.split()
        if w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    words = iter(body.split()) if style == "ascii" else None
    order, at = (">" if "big" in style else "<"), 0

    def one(kind: str) -> float:
        nonlocal at
        if words is not None:
            return float(next(words))
        t = np.dtype(order + _PLY[kind])
        out = np.frombuffer(body, t, 1, at)[0]
        at += t.itemsize
        return float(out)

    v, faces = [], []
    for name, n, properties in elements:
        for _ in range(n):
            row: dict[str, float | list[float]] = {}
            for p in properties:
                row[p[-1]] = [one(p[2]) for _ in range(int(one(p[1])))] if p[0] == "list" else one(p[0])
            if name == "vertex":
                v.append([row["x"], row["y"], row["z"]])
            elif name == "face":
                faces.append([int(i) for i in next(x for x in row.values() if isinstance(x, list))])
    return mesh_frame(np.array(v), faces)


def write_ply(df: pd.DataFrame) -> bytes:
    v, f = mesh_arrays(df)
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(len(f), [("n", "u1"), ("i", "<i4", 3)])
    rows["n"], rows["i"] = 3, f
    return head.encode() + v.astype("<f8").tobytes() + rows.tobytes()


def read_stl(data: bytes) -> pd.DataFrame:
    """ASCII; equal corners become one vertex."""
    corners = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data), dtype="S32").astype(np.float64).reshape(-1, 3)
    v, back = np.unique(corners, axis=0, return_inverse=True)
    return mesh_frame(v, back.reshape(-1, 3).tolist())


def write_stl(df: pd.DataFrame) -> bytes:
    v, f = mesh_arrays(df)
    out = io.StringIO()
    out.write("solid mesh\n")
    for t in f.tolist():
        n = np.cross(v[t[1]] - v[t[0]], v[t[2]] - v[t[0]])
        n = n / (np.linalg.norm(n) or 1)
        out.write("facet normal " + " ".join(map(repr, n.tolist())) + "\nouter loop\n" + "".join("vertex " + " ".join(map(repr, v[i].tolist())) + "\n" for i in t) + "endloop\nendfacet\n")
    out.write("endsolid mesh\n")
    return out.getvalue().encode()


def read_arff(data: bytes) -> pd.DataFrame:
    """Properties in long form: vertex_id, name, value; `?` and -1 are unknown."""
    names, rows, body = [], [], False
    for line in data.decode().splitlines():
        line = line.strip()
        if line.lower().startswith("@attribute"):
            names.append(line.split()[1])
        elif line.lower().startswith("@data"):
            body = True
        elif body and line and line[0] not in "%@":
            rows.append([np.nan if w in ("?", "-1", "-1.0") else float(w) for w in re.split(r"[,\s]+", line) if w])
    wide = pd.DataFrame(rows, columns=names)
    return wide.reset_index(names="vertex_id").melt("vertex_id", var_name="name", value_name="value").astype({"vertex_id": "int64", "value": "float64"})


def write_arff(df: pd.DataFrame) -> bytes:
    wide = df.pivot(index="vertex_id", columns="name", values="value")
    lines = ["@relation properties", "", *(f"@attribute {c} real" for c in wide.columns), "", "@data"]
    lines += [" ".join("-1" if np.isnan(v) else repr(float(v)) for v in row) for row in wide.to_numpy()]
    return ("\n".join(lines) + "\n").encode()


def read_pdb(data: bytes) -> pd.DataFrame:
    """ATOM and HETATM records, with the number of the model they stand in."""
    rows, model = [], 1
    for line in data.decode("ascii", "replace").splitlines():
        if line.startswith("MODEL"):
            model = int(line[10:14] or model)
        elif line.startswith(("ATOM", "HETATM")):
            number = lambda a, b, d=0.0: float(line[a:b]) if line[a:b].strip() else d  # noqa: B023, E731
            rows.append((int(line[6:11]), line[12:16].strip(), line[16].strip(), line[17:20].strip(), line[21].strip(), int(line[22:26]), model, number(30, 38), number(38, 46), number(46, 54), number(54, 60, 1.0), number(60, 66), line.startswith("HETATM")))
    return pd.DataFrame(rows, columns=["serial", "name", "alt_loc", "residue", "chain", "sequence", "model", "x", "y", "z", "occupancy", "temp_factor", "hetatm"])


def write_pdb(df: pd.DataFrame) -> bytes:
    line = lambda r: f"{'HETATM' if r.hetatm else 'ATOM  '}{r.serial:5d} {r.name_:<4s}{r.alt_loc or ' ':1s}{r.residue:>3s} {r.chain or ' ':1s}{r.sequence:4d}    {r.x:8.3f}{r.y:8.3f}{r.z:8.3f}{r.occupancy:6.2f}{r.temp_factor:6.2f}"
    return ("\n".join([*(line(r) for r in df.rename(columns={"name": "name_"}).itertuples(index=False)), "END"]) + "\n").encode()


def read_npy(data: bytes) -> pd.DataFrame:
    """A matrix of vertices by properties, in long form; columns are named p0, p1, ..."""
    m = np.load(io.BytesIO(data), allow_pickle=False)
    m = m.reshape(len(m), -1).astype(np.float64)
    return pd.DataFrame({"vertex_id": np.tile(np.arange(len(m)), m.shape[1]), "name": np.repeat([f"p{i}" for i in range(m.shape[1])], len(m)), "value": m.T.reshape(-1)})


def write_npy(df: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    wide = df.pivot(index="vertex_id", columns="name", values="value")
    np.save(out, wide.to_numpy(np.float64), allow_pickle=False)
    return out.getvalue()


#: Bytes of a property's name in a binary property file.
PROPERTY_NAME = 128


def read_prp(data: bytes) -> pd.DataFrame:
    """int32 counts, fixed-width names, float32 values by vertex; -1 is unknown."""
    vertices, many = struct.unpack_from("<2i", data)
    names = [data[8 + i * PROPERTY_NAME :][:PROPERTY_NAME].split(b"\0")[0].decode() for i in range(many)]
    v = np.frombuffer(data, "<f4", vertices * many, 8 + many * PROPERTY_NAME).reshape(vertices, many).astype(np.float64)
    return pd.DataFrame({"vertex_id": np.tile(np.arange(vertices), many), "name": np.repeat(names, vertices), "value": np.where(v == -1, np.nan, v).T.reshape(-1)})


def write_prp(df: pd.DataFrame) -> bytes:
    wide = df.pivot(index="vertex_id", columns="name", values="value")
    names = b"".join(c.encode()[: PROPERTY_NAME - 1].ljust(PROPERTY_NAME, b"\0") for c in wide.columns)
    return struct.pack("<2i", *wide.shape) + names + wide.fillna(-1).to_numpy("<f4").tobytes()


def read_val(data: bytes) -> pd.DataFrame:
    """One number a vertex, in order."""
    v = np.array(data.split(), np.float64)
    return pd.DataFrame({"vertex_id": np.arange(len(v)), "name": "value", "value": v})


def write_val(df: pd.DataFrame) -> bytes:
    """Vertices without a value, or missing between others, are written as zeros."""
    known = df[df["value"].notna()]
    v = np.zeros(int(df["vertex_id"].max()) + 1 if len(df) else 0)
    v[known["vertex_id"]] = known["value"]
    return "".join(f"{x!r}\n" for x in v.tolist()).encode()


def read_ifs(data: bytes) -> pd.DataFrame:
    """Length-prefixed strings, float32 vertices, int32 triangles; triangles with a repeated corner are left out."""
    at = 0

    def text() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from("<I", data, at)
        at += 4 + n
        return data[at - n : at].rstrip(b"\0")

    def rows(kind: str) -> np.ndarray:
        nonlocal at
        (n,) = struct.unpack_from("<I", data, at)
        out = np.frombuffer(data, kind, 3 * n, at + 4).reshape(n, 3)
        at += 4 + 12 * n
        return out

    if text() != b"IFS" or struct.unpack_from("<f", data, at)[0] != 1.0:
        raise ValueError("not an indexed face set")
    at += 4
    text()
    if text() != b"VERTICES":
        raise ValueError("no vertices")
    v = rows("<f4")
    if text() != b"TRIANGLES":
        raise ValueError("no triangles")
    return mesh_frame(v, [t for t in rows("<i4").tolist() if len(set(t)) == 3])


def write_ifs(df: pd.DataFrame) -> bytes:
    v, f = mesh_arrays(df)
    text = lambda s: struct.pack("<I", len(s) + 1) + s + b"\0"
    return text(b"IFS") + struct.pack("<f", 1.0) + text(b"mesh") + text(b"VERTICES") + struct.pack("<I", len(v)) + v.astype("<f4").tobytes() + text(b"TRIANGLES") + struct.pack("<I", len(f)) + f.astype("<i4").tobytes()


def read_png16(data: bytes) -> pd.DataFrame:
    """A grey PNG of 8 or 16 bits as a raster; the file's first row is the top one. Depth images divide by their scale afterwards."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, [], b""
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        head, body = (part, body) if kind == b"IHDR" else (head, body + [part] if kind == b"IDAT" else body)
        at += 12 + n
    w, h, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if color != 0 or bits not in (8, 16) or interlaced:
        raise ValueError("only plain grey images of 8 or 16 bits are read")
    size = bits // 8
    raw, line = zlib.decompress(b"".join(body)), w * size
    rows, before = np.zeros((h, line), np.uint8), np.zeros(line, np.int32)
    for y in range(h):
        kind, now = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1).astype(np.int32)
        if kind == 2:
            now = now + before
        elif kind in (1, 3, 4):
            for x in range(line):
                a, b, c = (now[x - size], before[x], before[x - size]) if x >= size else (0, before[x], 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x] = (now[x] + guess) & 255
        before = now & 255
        rows[y] = before
    return _cells((rows if size == 1 else rows.view(">u2")).astype(np.float64).reshape(h, w)[::-1])


def write_png16(df: pd.DataFrame) -> bytes:
    v = np.clip(np.rint(_dense(df)), 0, 65535).astype(">u2")[::-1]
    h, w = v.shape
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    lines = b"".join(b"\0" + r.tobytes() for r in v)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


_POINTS, _NORMALS = "x double, y double, z double", ", nx double, ny double, nz double"
_GRID2, _GRID3 = "ix int, iy int, value double", "ix int, iy int, iz int, value double"
_MESH = "part string, id long, x double, y double, z double, a double, b double, c double"
_ATOMS = "serial long, name string, alt_loc string, residue string, chain string, sequence long, model long, x double, y double, z double, occupancy double, temp_factor double, hetatm boolean"


def _rows_text(names: list[str], numbered: bool = False) -> Callable[[pd.DataFrame], bytes]:
    return lambda df: "".join((f"{i} " if numbered else "") + " ".join(map(repr, r)) + "\n" for i, r in enumerate(df[names].to_numpy(np.float64).tolist())).encode()


def _volume(read: Callable[[bytes], np.ndarray], write: Callable[[np.ndarray], bytes]) -> tuple[Callable[[bytes], pd.DataFrame], Callable[[pd.DataFrame], bytes]]:
    return lambda d: _cells(read(d)), lambda f: write(_dense(f))


def _text_mesh(read: Callable[[bytes], mesh_text.Mesh], write: Callable[[np.ndarray, np.ndarray], bytes]) -> tuple[Callable[[bytes], pd.DataFrame], Callable[[pd.DataFrame], bytes]]:
    return lambda d: mesh_frame(*read(d)), lambda f: write(*mesh_arrays(f))


#: kind: (schema, reader, writer)
FORMATS: dict[str, tuple[str, Callable[[bytes], pd.DataFrame], Callable[[pd.DataFrame], bytes]]] = {
    "xyz": (_POINTS, lambda d: _points_text(d, ["x", "y", "z"]), _rows_text(["x", "y", "z"])),
    "xyzn": (_POINTS + _NORMALS, lambda d: _unit_normals(_points_text(d, TUPLES["pts"])), _rows_text(TUPLES["pts"])),
    "vts": (_POINTS, lambda d: _points_text(d, ["x", "y", "z"], 1), _rows_text(["x", "y", "z"], True)),
    "pts": (_POINTS + _NORMALS, lambda d: read_tuples(d, "pts"), lambda f: write_tuples(f, "pts")),
    "sdf": (_POINTS + ", value double", lambda d: read_tuples(d, "sdf"), lambda f: write_tuples(f, "sdf")),
    "pset": (_POINTS + _NORMALS + ", r double, g double, b double, timestamp double, category_id long, instance_id long, value double", lambda d: read_tuples(d, "pset"), lambda f: write_tuples(f, "pset")),
    "grd": (_GRID3, read_grd3, write_grd3), "grd2": (_GRID2, read_grd2, write_grd2), "vox": (_GRID3, read_vox, write_vox), "raw": (_GRID2, read_raw, write_raw), "pfm": (_GRID2, read_pfm, write_pfm),
    "pnm": (_GRID2, read_pnm, write_pnm), "grdascii": (_GRID3, read_grdascii, write_grdascii), "dx": (_GRID3, read_dx, write_dx),
    "off": (_MESH, read_off, write_off), "obj": (_MESH, read_obj, write_obj), "ply": (_MESH, read_ply, write_ply), "stl": (_MESH, read_stl, write_stl),
    "ifs": (_MESH, read_ifs, write_ifs), "png16": (_GRID2, read_png16, write_png16), "npy": ("vertex_id long, name string, value double", read_npy, write_npy), "prp": ("vertex_id long, name string, value double", read_prp, write_prp),
    "arff": ("vertex_id long, name string, value double", read_arff, write_arff), "pdb": (_ATOMS, read_pdb, write_pdb), "val": ("vertex_id long, name string, value double", read_val, write_val),
    "phi": (_GRID3, *_volume(volumes.read_phi, volumes.write_phi)), "ccp4": (_GRID3, *_volume(volumes.read_ccp4, volumes.write_ccp4)), "insight": (_GRID3, *_volume(volumes.read_insight, volumes.write_insight)),
    "ray": (_MESH, *_text_mesh(mesh_text.read_ray, mesh_text.write_ray)), "catt": (_MESH, *_text_mesh(mesh_text.read_catt, mesh_text.write_catt)), "hoppe": (_MESH, *_text_mesh(mesh_text.read_hoppe, mesh_text.write_hoppe)),
    "surfels": ("block_id int, " + surfels.SURFELS, surfels.read_database, surfels.write_database), "xyzrgb": (_POINTS + ", r int, g int, b int", surfels.read_text, surfels.write_text), "scene": (scene.SCHEMA, scene.decode, scene.encode),
}
