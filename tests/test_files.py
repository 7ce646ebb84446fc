"""Readers on small files written by hand."""

from __future__ import annotations

import numpy as np
import pytest

from meshspark.sources import binary as B
from meshspark.sources import meshes as S
from meshspark.sources.lines import numbered


def test_lines_follow_each_other_over_splits(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "t" / "b.txt").write_text("".join(f"line {i}\n" for i in range(500, 507)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = numbered(spark, f"file://{tmp_path}/t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line"], r["value"]) for r in rows) == [(i, f"line {i}") for i in range(507)]


def test_obj_with_comments_and_index_forms(spark, tmp_path):
    p = tmp_path / "m.obj"
    p.write_text("# c\nv 0 0 0\nv  1 0 0.5\nv 0 1 0\n# d\nf 1/2/3 2//1 3\n")
    v, f = S.read_obj(spark, f"file://{p}")
    assert sorted(map(tuple, v.collect())) == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.5), (2, 0.0, 1.0, 0.0)]
    assert list(map(tuple, f.collect())) == [(0, 0, 1, 2)]


@pytest.mark.parametrize("order,kind", [("<", "binary_little_endian"), (">", "binary_big_endian")])
def test_binary_ply(spark, tmp_path, order, kind):
    p = tmp_path / "m.ply"
    head = f"ply\nformat {kind} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    v = np.array([(0, 0, 0, 1, 2, 3), (1, 0, 0, 4, 5, 6), (0, 1, 0.5, 7, 8, 255)], [("x", order + "f4"), ("y", order + "f4"), ("z", order + "f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
    f = np.array([(3, (2, 0, 1))], [("n", "u1"), ("v", order + "i4", 3)])
    p.write_bytes(head.encode() + v.tobytes() + f.tobytes())
    vertices, faces = S.read_ply_binary(spark, f"file://{p}")
    assert sorted(tuple(r)[1:] for r in vertices.collect()) == [(0, 0.0, 0.0, 0.0, 1, 2, 3, 255), (1, 1.0, 0.0, 0.0, 4, 5, 6, 255), (2, 0.0, 1.0, 0.5, 7, 8, 255, 255)]
    assert [tuple(r)[1:] for r in faces.collect()] == [(0, 2, 0, 1)]


def test_binary_ply_of_quads_is_refused(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "q.ply").write_bytes(head.encode() + bytes([4]) + np.arange(4, dtype="<i4").tobytes())
    with pytest.raises(Exception, match="other lengths"):
        S.read_ply_binary(spark, f"file://{tmp_path}/q.ply")[1].collect()


@pytest.mark.parametrize("text, error", [("ply\nformat ascii 1.0\nend_header\n", "no binary PLY"), ("ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n", "lack"), ("solid", "no PLY header"), ("ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n", "ends before")])
def test_damaged_ply_is_refused(spark, tmp_path, text, error):
    (tmp_path / "q.ply").write_text(text)
    with pytest.raises(Exception, match=error):
        B.read_binary(spark, f"file://{tmp_path}/q.ply", "ply", "vertices").collect()


@pytest.mark.parametrize("order, kind", [("<", "little"), (">", "big")])
def test_binary_ply_in_ranges(spark, tmp_path, order, kind):
    """Many ranges of two unlike files: all columns that the headers name, places by header order, extra elements skipped."""
    n = 40
    v = np.zeros(n, [("x", f"{order}f8"), ("y", f"{order}f4"), ("z", f"{order}f8"), ("nx", f"{order}f4"), ("ny", f"{order}f4"), ("nz", f"{order}f4"), ("diffuse_red", "u1"), ("diffuse_green", "u1"), ("diffuse_blue", "u1"), ("alpha", "u1")])
    v["x"], v["y"], v["nz"], v["diffuse_red"], v["alpha"] = np.arange(n) / 7, np.arange(n), 1, np.arange(n), 9
    f = np.zeros(n, [("a", "u1"), ("v", f"{order}u4", 3), ("b", "u1"), ("t", f"{order}f4", 6), ("k", f"{order}i4")])
    f["a"], f["v"], f["b"], f["t"], f["k"] = 3, np.arange(3 * n).reshape(n, 3) % n, 6, np.arange(6 * n).reshape(n, 6), np.arange(n) % 2
    names = [("double", "x"), ("float", "y"), ("float64", "z"), ("float", "nx"), ("float", "ny"), ("float", "nz"), ("uchar", "diffuse_red"), ("uchar", "diffuse_green"), ("uchar", "diffuse_blue"), ("uchar", "alpha")]
    head = ["ply", f"format binary_{kind}_endian 1.0", "comment TextureFile one two.png", "comment TextureFile b.png", "element camera 1", "property short k", f"element vertex {n}", *(f"property {t} {c}" for t, c in names), f"element face {n}", "property list uchar uint vertex_index", "property list uchar float texcoord", "property int texnumber", "end_header", ""]
    (tmp_path / "a.ply").write_bytes("\n".join(head).encode() + b"\0\0" + v.tobytes() + f.tobytes())
    (tmp_path / "b.ply").write_bytes(B.ply_bytes(np.arange(9.0).reshape(1, 9), order))
    path = f"file://{tmp_path}"
    got = B.read_binary(spark, path, "ply", "vertices", records=7)
    assert got.rdd.getNumPartitions() == 7 and got.columns == ["file", "vid", *"xyz", *"rgba", "nx", "ny", "nz"]
    rows = sorted(tuple(r)[1:] for r in got.collect() if r["file"].endswith("a.ply"))
    assert rows == [(k, k / 7, float(k), 0.0, k, 0, 0, 9, 0.0, 0.0, 1.0) for k in range(n)]
    faces = B.read_binary(spark, path, "ply", "faces", records=11).where("file LIKE '%a.ply'").orderBy("fid").collect()
    assert [tuple(r)[1:] for r in faces] == [(k, *(int(x) for x in f["v"][k]), *map(float, range(6 * k, 6 * k + 6)), k % 2) for k in range(n)]
    other = [tuple(r)[1:] for r in B.read_binary(spark, path, "ply", "faces").where("file LIKE '%b.ply'").collect()]
    assert other == [(0, 0, 1, 2, *[None] * 7)]
    assert sorted(tuple(r)[1:] for r in B.read_binary(spark, path, "ply", "textures").collect()) == [(0, "one two.png"), (1, "b.png")]


def test_binary_soups(spark, tmp_path):
    stl, raw = tmp_path / "m.stl", tmp_path / "m.tsp"
    rows = np.zeros(2, B.STL)
    rows["corners"] = np.arange(18).reshape(2, 9)
    stl.write_bytes(bytes(80) + (2).to_bytes(4, "little") + rows.tobytes())
    got = sorted(tuple(r)[1:] for r in S.read_stl_binary(spark, f"file://{stl}").collect())
    assert got == [(0, *map(float, range(9))), (1, *map(float, range(9, 18)))]
    raw.write_bytes(np.concatenate([np.arange(9), np.zeros(9), np.ones(9)]).astype("<f4").tobytes())
    r = tuple(S.read_raw_triangles(spark, f"file://{raw}").first())[1:]
    assert r == (0, *map(float, range(9)), *[255.0] * 9)


def test_ply_points_have_no_faces(spark, tmp_path):
    p = tmp_path / "m.ply"
    p.write_text("ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 0\n1 2 3\n")
    v, f = S.read_ply_text(spark, f"file://{p}")
    assert sorted(map(tuple, v.collect())) == [(0, 0.0, 0.0, 0.0), (1, 1.0, 2.0, 3.0)]
    assert f.count() == 0


@pytest.mark.parametrize("body", ["v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n", "v 0 0\nv 1 0 0\nv 1 1 0\nf 1 2 3\n", "v 0 x 0\nv 1 0 0\nv 1 1 0\nf 1 2 3\n"])
def test_obj_of_polygons_or_bad_numbers_is_refused(spark, tmp_path, body):
    p = tmp_path / "m.obj"
    p.write_text(body)
    v, f = S.read_obj(spark, f"file://{p}")
    with pytest.raises(Exception, match="not a triangle|no coordinate"):
        v.collect(), f.collect()
