"""Volume formats with binary headers, as functions between bytes and arrays indexed [z][y][x].

phi and insight are sequences of Fortran records (a length before and after each), ccp4 has a header of 1,024 bytes and
raw3 is bare numbers, their type and grid in a side file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np

#: Fixed values of the formats: sides of a phi grid, its labels, and bytes of an insight and a ccp4 header.
PHI_SIDE = 65
PHI_FIRST, PHI_LAST = b"now starting phimap ", b" end of phimap  "
INSIGHT_HEADER, CCP4_HEADER = 72, 1024
#: Names of number types in a side file.
RAW_TYPES = {"double64": "<f8", "float64": "<f8", "float32": "<f4", "uint64": "<u8", "int64": "<i8", "uint32": "<u4", "int32": "<i4", "uint16": "<u2", "int16": "<i2", "uchar8": "u1", "char8": "i1"}


def _records(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<i", data, at)
        if n < 0 or at + 8 + n > len(data) or struct.unpack_from("<i", data, at + 4 + n)[0] != n:
            raise ValueError("lengths before and after a record differ")
        yield data[at + 4 : at + 4 + n]
        at += 8 + n


def _record(part: bytes) -> bytes:
    n = struct.pack("<i", len(part))
    return n + part + n


def read_phi(data: bytes) -> np.ndarray:
    sizes = (len(PHI_FIRST), 70, 4 * PHI_SIDE**3, len(PHI_LAST), 20)
    parts = list(_records(data))
    if tuple(map(len, parts)) != sizes or struct.unpack_from("<i", parts[4], 16)[0] != PHI_SIDE:
        raise ValueError("not a phi map")
    return np.frombuffer(parts[2], "<f4").reshape((PHI_SIDE,) * 3)


def write_phi(values: np.ndarray) -> bytes:
    """A smaller grid is filled up with zeros."""
    if max(values.shape, default=0) > PHI_SIDE:
        raise ValueError(f"a phi map has {PHI_SIDE} cells a side")
    whole = np.zeros((PHI_SIDE,) * 3, "<f4")
    whole[tuple(map(slice, values.shape))] = values
    return b"".join(map(_record, (PHI_FIRST, b" " * 70, whole.tobytes(), PHI_LAST, struct.pack("<4fi", 1, 0, 0, 0, PHI_SIDE))))


def read_insight(data: bytes) -> np.ndarray:
    title, header, *rows = _records(data)
    if len(title) != 60 or len(header) != INSIGHT_HEADER:
        raise ValueError("not an insight map")
    order, width, whole = struct.unpack_from("<3i", header)
    angles = struct.unpack_from("<3f", header, 24)
    if (order, width, whole) != (0, 4, 0) or angles != (90.0, 90.0, 90.0):
        raise ValueError("only float maps with x fastest and right angles")
    nx, ny, nz = (n + 1 for n in struct.unpack_from("<3i", header, 60))
    if len(rows) != ny * nz:
        raise ValueError("rows are missing")
    return np.frombuffer(b"".join(rows), "<f4").reshape(nz, ny, nx)


def write_insight(values: np.ndarray) -> bytes:
    nz, ny, nx = values.shape
    header = struct.pack("<3i12f3i", 0, 4, 0, nx - 1, ny - 1, nz - 1, 90, 90, 90, 0, 1, 0, 1, 0, 1, nx - 1, ny - 1, nz - 1)
    rows = values.astype("<f4").reshape(ny * nz, nx)
    return b"".join([_record(b" " * 60), _record(header), *(_record(r.tobytes()) for r in rows)])


def read_ccp4(data: bytes) -> np.ndarray:
    """Columns, rows and sections go to the axes that the header names; symmetry records between header and map are passed over."""
    counts, mode = struct.unpack_from("<3i", data), struct.unpack_from("<i", data, 12)[0]
    axes, symmetry = struct.unpack_from("<3i", data, 64), struct.unpack_from("<i", data, 92)[0]
    if min(counts) <= 0 or mode != 2 or sorted(axes) != [1, 2, 3] or symmetry < 0:
        raise ValueError("not a map of floats")
    v = np.frombuffer(data, "<f4", int(np.prod(counts)), CCP4_HEADER + symmetry).reshape(counts[::-1])
    return v.transpose([2 - axes.index(a) for a in (3, 2, 1)])


def write_ccp4(values: np.ndarray) -> bytes:
    n = values.shape[::-1]
    known = values if values.size else np.zeros(1)
    header = struct.pack("<10i6f3i3f2i", *n, 2, 0, 0, 0, *n, *map(float, n), 90, 90, 90, 1, 2, 3, known.min(), known.max(), known.mean(), 1, 0)
    return header.ljust(CCP4_HEADER, b"\0") + values.astype("<f4").tobytes()


def read_raw3(data: bytes, size: str) -> np.ndarray:
    """size: the text of the side file, `Type(xres,yres,zres)`."""
    m = re.match(r"\s*(\w+)\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", size)
    if not m or m[1].lower() not in RAW_TYPES:
        raise ValueError(f"no number type and grid in {size!r}")
    nx, ny, nz = map(int, m.groups()[1:])
    return np.frombuffer(data, RAW_TYPES[m[1].lower()], nx * ny * nz).reshape(nz, ny, nx)


def write_raw3(values: np.ndarray, kind: str = "Float32") -> tuple[bytes, str]:
    return values.astype(RAW_TYPES[kind.lower()]).tobytes(), "{}({},{},{})\n".format(kind, *values.shape[::-1])


def as_atoms(values: np.ndarray, world: Sequence[Sequence[float]] = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0))) -> bytes:
    """Cells above zero as records of a molecule file, x fastest; `world` takes cells to places."""
    iz, iy, ix = np.nonzero(values > 0)
    at = np.stack([ix, iy, iz, np.ones(len(ix))]).T @ np.asarray(world, np.float64).T
    lines = [f"HETATM{n:5d} H    POC 1{n:4d}    {p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}{v:6.2f}{v:6.2f}            \n" for n, (p, v) in enumerate(zip(at.tolist(), values[iz, iy, ix].tolist(), strict=True))]
    return "".join(lines).encode()
