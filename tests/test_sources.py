"""Round trips of every format, and literals whose bytes are known."""

import struct

import numpy as np
import pandas as pd
import pytest

from terravox.sources import files
from terravox.sources.codecs import FORMATS, read_obj, read_off, read_ply, read_raw, read_tuples

CELLS3 = pd.DataFrame([(x, y, z, float(x + 10 * y + 100 * z)) for z in range(2) for y in range(2) for x in range(2)], columns=["ix", "iy", "iz", "value"]).astype({"ix": "int32", "iy": "int32", "iz": "int32"})
CELLS2 = CELLS3[CELLS3.iz == 0].drop(columns="iz").reset_index(drop=True)
POINTS = pd.DataFrame({"x": [0.5, -1.25], "y": [2.0, 0.0], "z": [1.0, 3.5], "nx": [0.0, 1.0], "ny": [1.0, 0.0], "nz": [0.0, 0.0], "value": [0.25, -2.0], "r": 0.5, "g": 0.25, "b": 1.0, "timestamp": 7.0, "category_id": [3, 4], "instance_id": [1, 0]})
_LISTS = {"object": ([0], [1.5, -2.0]), "node": ([3], []), "image": ([], [0.125] * 25), "object_relationship": ([0, 0], [7.0])}
_NUMBERS = {"scene": [float(i) for i in range(16)], "comment": [], "node": [-1, 0, 1, 0, 2.5, 0.5], "object": [9, -1, 0, 1, 2, 1.25, 4], "label": [5, 65, 0, -1, 0, 0.5, 0.25, 1, 2], "feature": [0, 1, 0.5, 3, 1], "object_relationship": [2, 2, 1], "assignment": [0, 0, 0.75, 1], "scan": [*range(10), 0, 4, 3, 2.5, 2, 1.5, 0, 2.5], "image": [*range(10), 0, 4, 3, 2.5, 2.5, 2, 1.5, 0, 1, 1]}
_NAMED = {"scene": "a scene", "comment": "one\ttwo\nthree", "object": "big chair", "feature": "height"}
SCENE = pd.DataFrame([(k, 0, _NAMED.get(k), [float(v) for v in n], *_LISTS.get(k, ([], [])), {"scene": "1.1", "feature": "a.grd"}.get(k)) for k, n in _NUMBERS.items()], columns=["kind", "id", "name", "numbers", "refs", "operands", "path"])
OFF = b"OFF\n4 1 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"


@pytest.mark.parametrize("kind", sorted(FORMATS))
def test_round_trip(kind):
    schema, read, write = FORMATS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    if kind == "phi":  # it is always as large
        rows = pd.DataFrame([(x, y, z, float(x == 3 and y == z)) for z in range(65) for y in range(65) for x in range(65)], columns=names)
    elif "ix" in names:
        rows = CELLS3 if "iz" in names else CELLS2
    elif "part" in names:
        rows = read_off(OFF)
    elif kind == "val":
        rows = pd.DataFrame({"vertex_id": [0, 1, 2], "name": "value", "value": [1.5, 0.0, -2.25]})
    elif kind == "surfels":
        rows = pd.DataFrame({c: 0.5 if "double" in t else 3 for c, t in (f.split() for f in schema.split(", "))}, index=[0, 1]).assign(block_id=[0, 1], nx=[0.0, 1.0], ny=0.0, nz=[1.0, 0.0], tx=1.0, ty=0.0, tz=0.0)
    elif kind == "xyzrgb":
        rows = POINTS[["x", "y", "z"]].assign(r=[1, 0], g=[2, 255], b=[3, 9])
    elif kind == "scene":
        rows = SCENE
    elif kind in ("arff", "npy", "prp"):
        rows = pd.DataFrame({"vertex_id": [0, 1, 0, 1], "name": ["p0", "p0", "p1", "p1"], "value": [1.5, np.nan, 2.0, 3.0]})
    elif kind == "pdb":
        rows = pd.DataFrame([(1, "CA", "", "GLY", "A", 5, 1, 1.5, -2.25, 3.125, 1.0, 20.5, False)], columns=names)
    else:
        rows = POINTS[names]
    back = read(write(rows))[names]
    if kind == "stl":  # it has no vertex numbers: the same corners in the same order
        from terravox.sources.codecs import mesh_arrays

        (v, f), (w, g) = mesh_arrays(rows), mesh_arrays(back)
        assert np.array_equal(v[f], w[g])
        return
    pd.testing.assert_frame_equal(back.reset_index(drop=True), rows[names].reset_index(drop=True), check_dtype=False)


def test_binary_layouts():
    assert read_tuples(struct.pack("<4f", 1, 2, 3, -0.5), "sdf").iloc[0].tolist() == [1, 2, 3, -0.5]
    pset = read_tuples(struct.pack("<16f", 1, 2, 3, 0, 0, 2, 0, 0, 1, 9, 4, 5, 6, 0, 0, 0), "pset").iloc[0]
    assert (pset.nz, pset.timestamp, pset.category_id, pset.instance_id, pset.value) == (1, 9, 4, 5, 6)
    raw = read_raw(struct.pack("<4I2f", 54321, 2, 1, 1, 7.0, -321.0))
    assert raw.value.iloc[0] == 7 and np.isnan(raw.value.iloc[1])
    with pytest.raises(ValueError):
        read_raw(struct.pack("<4I", 1, 2, 1, 1))


def test_polygons_become_fans_and_negative_indices_count_back():
    assert read_off(OFF).query("part == 'f'")[["a", "b", "c"]].values.tolist() == [[0, 1, 2], [0, 2, 3]]
    obj = read_obj(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf -3/1 2//4 3\n")
    assert obj.query("part == 'f'")[["a", "b", "c"]].values.tolist() == [[0, 1, 2]]
    ply = read_ply(b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 9\n1 0 0 9\n0 1 0 9\n3 0 1 2\n")
    assert len(ply) == 4


def test_spark_reads_what_it_wrote(spark, tmp_path):
    rows = spark.createDataFrame(pd.concat([CELLS3.assign(grid_id=g) for g in (1, 2)]))
    assert files.write(rows, str(tmp_path / "grids"), "grd", "grid_id") == 2
    back = files.read(spark, f"file://{tmp_path}/grids/*.grd")
    assert back.count() == 16 and back.agg({"value": "sum"}).first()[0] == 2 * CELLS3.value.sum()
    from terravox.sources.datasource import FormatSource

    spark.dataSource.register(FormatSource)
    assert spark.read.format("terravox").option("kind", "grd").option("path", str(tmp_path / "grids")).load().count() == 16


def test_png_filters():
    import zlib

    v = np.array([[10, 20, 30], [12, 25, 250], [13, 5, 7], [1, 2, 3]], np.uint8)
    up = lambda y: (v[y].astype(int) - v[y - 1]) & 255
    sub = [int(v[1][0]), *((int(v[1][x]) - int(v[1][x - 1])) & 255 for x in (1, 2))]
    mean = [(int(v[3][x]) - (((int(v[3][x - 1]) if x else 0) + int(v[2][x])) // 2)) & 255 for x in range(3)]
    lines = bytes([0, *v[0]]) + bytes([1, *sub]) + bytes([2, *up(2)]) + bytes([3, *mean])
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + b"crc."
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    out = FORMATS["png16"][1](data)
    assert out.value.tolist() == v[::-1].reshape(-1).astype(float).tolist()


def test_catalogs(spark, tmp_path):
    from terravox.sources import catalogs

    text = ["ASCII 1.1", "L 0 3 ground 0 0 0 -1 -1 -1 1 1 1 0 0 0 0 0", "R 0 0 0 0 k 1 2 3 0 0 0 2 4 6 2.5 0 0 0 0", "P 0 0 1 door 0 0 0 1 1 1 0 0 0 0", "P pano 0 0 0 7 8 9 0 0 0 0 0", "C 0 5 chair 3 seat 0 0 0 0 0"]
    (tmp_path / "a.house").write_text("\n".join(text))
    t = catalogs.house(spark, f"file://{tmp_path}/a.house")
    r = t["regions"].first()
    assert (r.label, r.z, r.ymax, r.height) == ("k", 3, 4, 2.5) and t["portals"].first().x1 == 1 and t["panoramas"].first()["name"] == "pano" and t["categories"].first().mpcat40_name == "seat"
    catalogs.house_lines(t).write.text(f"file://{tmp_path}/again")
    again = catalogs.house(spark, f"file://{tmp_path}/again")
    assert all(again[n].drop("file").collect() == t[n].drop("file").collect() for n in t)
    (tmp_path / "s.json").write_text('{"segIndices": [4, 4, 9]}')
    (tmp_path / "g.json").write_text('{"segGroups": [{"id": 1, "label": "chair", "segments": [4, 9]}]}')
    (tmp_path / "n.json").write_text('{"camera_angle_x": 0.5, "frames": [{"file_path": "a.png", "transform_matrix": [[1,0,0,0],[0,1,0,0],[0,0,1,2],[0,0,0,1]]}]}')
    (tmp_path / "c.conf").write_text("dataset x\nintrinsics 500 500 320 240\nscan d.png c.png 1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1\n")
    f = lambda n: f"file://{tmp_path}/{n}"
    assert [tuple(x)[1:] for x in catalogs.segments(spark, f("s.json")).collect()] == [(0, 4), (1, 4), (2, 9)]
    assert [tuple(x)[1:] for x in catalogs.segment_groups(spark, f("g.json")).collect()] == [(1, "chair", 4), (1, "chair", 9)]
    assert catalogs.nerf_frames(spark, f("n.json")).first().pose[11] == 2
    intrinsics, scans = catalogs.configuration(spark, f("c.conf"))
    assert intrinsics.first().numbers == [500, 500, 320, 240] and len(scans.first().pose) == 16


def test_volume_layouts():
    from terravox.sources import volumes

    v = np.arange(24.0).reshape(2, 3, 4)
    flipped = volumes.write_ccp4(v.transpose(2, 0, 1))  # columns run along y, rows along z, sections along x
    header = bytearray(flipped[:1024])
    header[64:76] = struct.pack("<3i", 2, 3, 1)
    header[92:96] = struct.pack("<i", 80)
    assert np.array_equal(volumes.read_ccp4(bytes(header) + b"s" * 80 + flipped[1024:]), v)
    data, size = volumes.write_raw3(v, "Int16")
    assert size == "Int16(4,3,2)\n" and np.array_equal(volumes.read_raw3(data, size), v) and len(data) == 48
    insight = volumes.write_insight(v)
    for broken in (insight[:-1], insight[:-20], b"", insight[:64] + struct.pack("<i", 71) + insight[68:]):
        with pytest.raises((ValueError, struct.error)):
            volumes.read_insight(broken)
    line = volumes.as_atoms(v, [[2, 0, 0, 10], [0, 2, 0, 0], [0, 0, 2, 0]]).decode().splitlines()[0]
    assert line.startswith("HETATM    0 H    POC 1   0") and line[30:54].split() == ["12.000", "0.000", "0.000"]


def test_text_meshes():
    from terravox.sources import mesh_text

    v, f = mesh_text.read_catt(b"%CORNERS\n\n1 0 0 0\n2 1 0 0\n3 1 1 0\n4 0 1 0\n%PLANES\n\n0 / /RIGID\n1 2 3 4\n\n1 / /RIGID\n1 1 2\n%EOF\n9 9 9 9\n")
    assert v.shape == (4, 3) and f == [[0, 1, 2], [0, 2, 3]]
    v, f = mesh_text.read_hoppe(b"# c\nVertex 1  0 0 0 {normal=(0 0 1)}\nVertex 2 1 0 0\nVertex 3 0 1 0\nFace 1  1 2 3\nFace 2 1 1 3\n")
    assert v[1].tolist() == [1, 0, 0] and f == [[0, 1, 2]]
    v, f = mesh_text.read_ray(b"#vertex 0 0 0 0 0 1 0 0\n#vertex 1 0 0 0 0 1 0 0 #vertex 0 1 0 0 0 1 0 0\n#camera 1 2 3\n#shape_triangle -1 0 1 2\n")
    assert len(v) == 3 and f == [[0, 1, 2]]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("version", [3, 4, 5, 6])
def test_surfel_databases_of_all_versions(version, order):
    from terravox.sources import surfels

    a = np.zeros(2, np.dtype(surfels.RECORDS[version]).newbyteorder(order))
    a["position"], a["normal"], a["radius"], a["color"], a["flags"] = [[1, 2, 3], [4, 5, 6]], [[32767, 0, 0]] * 2, 8192, [[1, 2, 3]] * 2, 64
    if version == 5:
        a["attribute"] = (33168 << 16) | 7
    if version == 6:
        a["elevation"], a["attribute"] = 400, 7
    count = struct.pack(f"{order}i", 2) if version < 4 else struct.pack(f"{order}q", 2)
    head = struct.pack(f"{order}32s4I", surfels.MAGIC, 1, 1, version, 0)
    tail = count + struct.pack(f"{order}8dI", *[0.0] * 8, 0) + bytes(surfels.HEADER_END)
    start = len(head) + 16 + len(tail)
    entry = struct.pack(order + surfels.ENTRY, start, 2, 2, 10, 20, 30, *[0.0] * 6, 0.5, 0, 100.0, 0, 0, 0, 0) + bytes(surfels.BLOCK_END)
    back = surfels.read_database(head + struct.pack(f"{order}Q2I", start + a.nbytes, 1, 1) + tail + a.tobytes() + entry)
    assert back[["x", "y", "z"]].values.tolist() == [[11, 22, 33], [14, 25, 36]] and back.nx.tolist() == [1, 1] and back.r1.tolist() == [1, 1] and back.timestamp.tolist() == [100, 100]
    assert (back.elevation.iloc[0], back.attribute.iloc[0]) == {3: (0, 0), 4: (0, 0), 5: (1, 7), 6: (1, 7)}[version] and (back.b.iloc[0], back["flags"].iloc[0]) == (3, 64)


def test_upc_and_scene_literals():
    from terravox.sources import scene, surfels

    point = bytearray(36)
    point[9] = ord("0")
    struct.pack_into("<3i", point, 16, 100, -200, 50)
    struct.pack_into("<3H", point, 29, 300, 20, 0)
    upc = surfels.read_upc(struct.pack(surfels.UPC_HEADER, b"UPCf", 1, 0, 64, 1, 0.01, 0.01, 0.02, 444966, 5029450, 5) + bytes(point))
    assert upc.iloc[0].tolist() == [2.0, -2.0, 6.0, 255, 20, 0, True]
    text = "SSA 1.0 None 1 1 1 0 0 0 1 0 0 0 0 0 0 0 0 N root+node -1 0 2 0 1 0 0 0 0 0 0 0 0 0 4 5 O None 0 -1 0 1 2 0 0 0 0 0 0 0 0 0 1.5 2 0 L None 0 0 0 -1 0 1 0 0 0 0 0 0 A 0 0 0.5 1 0 0 0 0"
    rows = scene.decode(text.encode()).set_index("kind")
    assert rows.loc["node", "name"] == "root node" and rows.loc["node", "refs"] == [4, 5] and rows.loc["object", "operands"] == [1.5, 2] and rows.loc["object", "refs"] == [0] and rows.loc["assignment", "numbers"] == [0, 0, 0.5, 1]
    for broken in ("SSB 1.0", text[:-10], text.replace(" O None", " Q None")):
        with pytest.raises(ValueError):
            scene.decode(broken.encode())


def test_meshes_with_gaps_in_their_ids():
    rows = read_off(OFF)
    gaps = rows.assign(id=rows["id"].where(rows["part"] == "f", rows["id"] * 3 + 1), **{c: rows[c] * 3 + 1 for c in "abc"})
    assert FORMATS["off"][2](gaps) == FORMATS["off"][2](rows)
    with pytest.raises(ValueError):
        FORMATS["off"][2](gaps.assign(a=2.0))
