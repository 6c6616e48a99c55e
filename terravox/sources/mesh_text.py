"""Line-based mesh formats as functions between bytes and (vertices, faces): ray, catt, hoppe."""

from __future__ import annotations

import numpy as np

Mesh = tuple[np.ndarray, list[list[int]]]


def _places(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, np.float64).reshape(-1, 3)


def _proper(faces: list[list[int]]) -> list[list[int]]:
    """Triangles without a repeated corner."""
    return [f for f in faces if len(set(f)) == 3]


def _lines(data: bytes) -> list[list[str]]:
    return [w for w in (line.split() for line in data.decode("utf-8", "replace").splitlines()) if w]


def read_ray(data: bytes) -> Mesh:
    """`#vertex` with place, normal and texture, `#shape_triangle` with material and three corners from 0."""
    words = data.decode("utf-8", "replace").split()
    v, faces = [], []
    for i, w in enumerate(words):
        if w == "#vertex":
            v.append([float(c) for c in words[i + 1 : i + 4]])
        elif w == "#shape_triangle":
            faces.append([int(c) for c in words[i + 2 : i + 5]])
    return _places(v), _proper(faces)


def write_ray(v: np.ndarray, f: np.ndarray) -> bytes:
    """Normals are written as zeros, so that a reader works them out."""
    lines = [*("#vertex " + " ".join(map(repr, p)) + " 0 0 0 0 0" for p in v.tolist()), *(f"#shape_triangle 0 {a} {b} {c}" for a, b, c in f.tolist())]
    return "".join(x + "\n" for x in lines).encode()


def read_catt(data: bytes) -> Mesh:
    """Corners by number from 1; a plane is a line with its name and a line of corners, a fan of triangles."""
    part, v, faces, named = "", [], [], False
    for w in _lines(data):
        if w[0].startswith("%"):
            part, named = w[0], False
            if part == "%EOF":
                break
        elif part == "%CORNERS":
            v.append([float(c) for c in w[1:4]])
        elif part == "%PLANES":
            if named:
                faces += [[int(w[0]) - 1, int(w[i]) - 1, int(w[i + 1]) - 1] for i in range(1, len(w) - 1)]
            elif w[1:3] != ["/", "/RIGID"]:
                raise ValueError(f"no plane: {' '.join(w)}")
            named = not named
    return _places(v), _proper(faces)


def write_catt(v: np.ndarray, f: np.ndarray) -> bytes:
    corners = "".join(f"{i} {x!r} {y!r} {z!r}\n" for i, (x, y, z) in enumerate(v.tolist(), 1))
    planes = "".join(f"{i} / /RIGID\n{a + 1} {b + 1} {c + 1}\n\n" for i, (a, b, c) in enumerate(f.tolist()))
    return f"%CORNERS\n\n{corners}\n%PLANES\n\n{planes}%EOF\n".encode()


def read_hoppe(data: bytes) -> Mesh:
    """`Vertex number x y z` and `Face number a b c`, corners by place from 1; what follows in braces isn't used."""
    rows = _lines(data)
    v = [[float(c) for c in w[2:5]] for w in rows if w[0] == "Vertex"]
    return _places(v), _proper([[int(c) - 1 for c in w[2:5]] for w in rows if w[0] == "Face"])


def write_hoppe(v: np.ndarray, f: np.ndarray) -> bytes:
    lines = [*(f"Vertex {i} {x!r} {y!r} {z!r}" for i, (x, y, z) in enumerate(v.tolist(), 1)), *(f"Face {i} {a + 1} {b + 1} {c + 1}" for i, (a, b, c) in enumerate(f.tolist(), 1))]
    return "".join(x + "\n" for x in lines).encode()
