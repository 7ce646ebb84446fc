"""The simplifier, node spheres, saturation, distances and the container on small meshes."""

from __future__ import annotations

import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions import intersect as X
from meshspark.operators import nodes as N
from meshspark.plans import build as B
from meshspark.sources import container as S


def height_field(n):
    x, y = np.meshgrid(np.arange(n), np.arange(n))
    v = np.stack([x.ravel(), y.ravel(), (np.sin(x / 6) + np.cos(y / 5)).ravel()], 1).astype(float)
    i = np.arange(n * n).reshape(n, n)
    a, b, c, d = (q.ravel() for q in (i[:-1, :-1], i[:-1, 1:], i[1:, :-1], i[1:, 1:]))
    border = np.zeros(n * n, bool)
    border[np.r_[i[0], i[-1], i[:, 0], i[:, -1]]] = True
    return v, np.concatenate([np.stack([a, b, c], 1), np.stack([b, d, c], 1)]), border


def test_simplified_surface_stays_whole():
    v, f, border = height_field(40)
    w, g = B.simplify(v, f, border, len(f) // 3)
    assert len(g) <= len(f) // 3 + 1
    half = np.sort(np.concatenate([g[:, [0, 1]], g[:, [1, 2]], g[:, [2, 0]]]), axis=1)
    edges, sides = np.unique(half, axis=0, return_counts=True)
    assert sides.max() == 2 and len(np.unique(g)) - len(edges) + len(g) == 1
    p = w[g]
    up = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])[:, 2]
    assert (up > 0).all() and up.sum() / 2 == pytest.approx(39 * 39)
    assert (w[border] == v[border]).all() and set(np.flatnonzero(border)) <= set(np.unique(g).tolist())


def test_nothing_moves_where_all_is_locked():
    v, f, _ = height_field(6)
    w, g = B.simplify(v, f, np.ones(len(v), bool), 2)
    assert (w == v).all() and (g == f).all()


def test_welding_drops_faces_of_two_corners():
    p = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 0], [0, 0, 0], [1, 1, 1]]], float)
    v, f = B.weld(p)
    assert len(v) == 4 and len(f) == 1


def test_partition_of_equal_and_no_triangles(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)] * 9, ", ".join(f"{c} double" for c in B.CORNERS))
    at, _ = B.partition(rows, 4)
    assert at.count() == 9
    assert B.partition(rows.limit(0), 4)[0].count() == 0


def test_tight_spheres_hold_all_points():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50):
        p = rng.normal(size=(n, 3))
        center, radius = N.tight_sphere(p)
        reach = np.linalg.norm(p - center, axis=1).max()
        assert reach <= radius <= 1.05 * max(np.linalg.norm(p[:, None] - p[None], axis=2).max(), 1e-12)


def test_saturation_folds_over_children_in_order(spark):
    nodes = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (1, 2.0, 3.0, 1.0), (2, 3.0, 0.0, 5.0), (3, 0.5, 9.0, 1.0)], "node long, error double, cx double, radius double").withColumns({"cy": F.lit(0.0), "cz": F.lit(0.0)})
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (3, 0, 99)], "src long, ordinal int, dst long")
    got = {r["node"]: (r["error"], r["radius"]) for r in N.saturated(nodes, edges).collect()}
    assert got[3] == (0.5, 1.0) and got[2] == (3.0, 5.0)
    assert got[1] == (2.0, pytest.approx(7 * 1.01))
    assert got[0] == (pytest.approx(3.0 * 1.01), pytest.approx((3 + 7 * 1.01) * 1.01))


def test_distances_against_samples(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, rng.normal(size=18).round(3))) for _ in range(20)]
    names = [f"{p}{c}" for p in "abcdef" for c in "xyz"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    a, b, c, d, e, f = (tuple(F.col(f"{p}{x}") for x in "xyz") for p in "abcdef")
    got = df.select(X.segment_segment(a, b, c, d), X.triangle_point((a, b, c), d), X.triangle_segment((a, b, c), d, e), X.triangle_triangle_distance((a, b, c), (d, e, f)), X.segment_triangle(d, e, (a, b, c)).isNotNull()).collect()
    t = np.linspace(0, 1, 61)
    u = np.array([(x, y) for x in t for y in t if x + y <= 1 + 1e-9])
    for row, r in zip(rows, got, strict=True):
        p = np.array(row).reshape(6, 3)
        seg = lambda i, j: p[i] + t[:, None] * (p[j] - p[i])
        tri = lambda i: p[i] + u[:, :1] * (p[i + 1] - p[i]) + u[:, 1:] * (p[i + 2] - p[i])
        least = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(2).min())
        near = [least(seg(0, 1), seg(2, 3)), least(tri(0), p[3:4]), least(tri(0), seg(3, 4)), least(tri(0)[::3], tri(3)[::3])]
        for k, (g, w) in enumerate(zip(r[:4], near, strict=True)):
            assert w - 0.2 <= g <= w + 1e-6, k
        assert not r[4] or r[2] == 0


class Ranges(http.server.SimpleHTTPRequestHandler):
    data = b""

    def do_GET(self):  # noqa: N802
        first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        self.send_response(206)
        self.end_headers()
        self.wfile.write(self.data[first : last + 1])

    def log_message(self, *args):
        pass


def test_container_over_http_and_wrong_magic(spark, tmp_path):
    path = f"{tmp_path}/m.bin"
    nodes = spark.createDataFrame([(0, 2.0, 1, 2, 3, 4, 0.5, 0.0, 0.0, 3.0, 1.0)], "node long, error double, n0 int, n1 int, n2 int, n3 int, cx double, cy double, cz double, radius double, tight_radius double")
    patches = spark.createDataFrame([(0, 0, 1, 1, None)], "src long, ordinal int, dst long, tri_end long, texture long")
    v = spark.createDataFrame([(0, k, float(k), 0.5, 0.25 * k, 0.5, 1.0) for k in range(3)], "node long, vid long, x double, y double, z double, u double, v double")
    f = spark.createDataFrame([(0, 0, 2, 1, 0)], "node long, fid long, v0 long, v1 long, v2 long")
    S.write_container(f"file://{path}", nodes, patches, v, f)
    Ranges.data = open(path, "rb").read()
    assert len(Ranges.data) % 256 == 0
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for where in (f"file://{path}", f"http://127.0.0.1:{server.server_port}/m.bin"):
            got = [tuple(r) for r in S.read_container(spark, where, "vertices").select("vid", *"xyzuv", "nx", "r").collect()]
            assert sorted(got) == [(k, float(k), 0.5, 0.25 * k, 0.5, 1.0, None, None) for k in range(3)]
            assert tuple(S.read_container(spark, where, "faces").first()) == (0, 0, 2, 1, 0)
            assert tuple(S.read_container(spark, where, "patches").first()) == (0, 0, 0, 1, 0, 1, None)
            assert tuple(S.read_container(spark, where, "header").select("uv", "normals", "n_nodes", "radius").first()) == (True, False, 2, 3.0)
            assert S.read_container(spark, where, "vertices").where("node = 5").count() == 0
    finally:
        server.shutdown()
    with open(path, "r+b") as file:
        file.write(b"\0\0\0\0")
    with pytest.raises(ValueError, match="no container"):
        S.Header.read(path)
