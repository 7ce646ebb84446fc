"""Eigenvectors, point-cloud normals and outliers, clipping and curvature against brute force and known shapes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog import QUERIES
from meshspark.functions import eigen
from meshspark.operators import clip as C
from meshspark.operators import cloud as P
from meshspark.operators import curvature as V
from meshspark.operators.points import nearest
from meshspark.queries.cloud import HIGH, LOW
from meshspark.queries.surfaces import octahedra

from .test_unexpressed import clipped

SF = "/root/testdata/sf0.001"
FACES, POINTS, IDS = "fid long, v0 long, v1 long, v2 long", "vid long, x double, y double, z double", "id long, x double, y double, z double"


def area(poly):
    return sum(np.linalg.norm(np.cross(poly[i] - poly[0], poly[i + 1] - poly[0])) / 2 for i in range(1, len(poly) - 1))


def sphere(n):
    """Points spread evenly over the unit sphere."""
    k = np.arange(n) + 0.5
    high, turn = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    return np.stack([np.cos(turn) * np.sin(high), np.sin(turn) * np.sin(high), np.cos(high)], 1)


def test_eigenvectors(spark):
    rng = np.random.default_rng(7)
    made = [m + m.T for m in rng.normal(size=(40, 3, 3))] + [np.outer(v, v) for v in rng.normal(size=(10, 3))]
    made += [np.zeros((3, 3)), np.eye(3) * 5, np.diag([1.0, 1, 3]), np.diag([3.0, 1, 3]), np.diag([-2.0, 0, 0]), np.diag([1e-12, 2e-12, 5e-12]), np.full((3, 3), 1e9)]
    rows = [(i, *(float(m["xyz".index(k[0]), "xyz".index(k[1])]) for k in eigen.CELLS)) for i, m in enumerate(made)]
    df = spark.createDataFrame([*rows, (-1, None, *[1.0] * 5)], "i int, " + ", ".join(f"{k} double" for k in eigen.CELLS))
    got = {r["i"]: r["e"] for r in df.select("i", eigen.symmetric(*(F.col(k) for k in eigen.CELLS)).alias("e")).collect()}
    assert got.pop(-1) is None
    for i, m in enumerate(made):
        size = max(np.abs(m).max(), 1e-300)
        values, vectors = np.array([p["value"] for p in got[i]]), np.array([list(p["vector"]) for p in got[i]])
        assert np.allclose(values / size, np.linalg.eigvalsh(m) / size, atol=1e-9)
        assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-12)
        assert np.allclose(m @ vectors.T / size, vectors.T * values / size, atol=1e-7)


def test_normals_of_a_plane_and_a_sphere(spark):
    rng = np.random.default_rng(3)
    flat = np.column_stack([rng.uniform(0, 5, (150, 2)), np.zeros(150)])
    flat[:, 2] = 0.5 * flat[:, 0] - 2 * flat[:, 1]
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(flat)] + [(999, None, 0.0, 0.0)], IDS)
    n = np.array([-0.5, 2, 1]) / np.linalg.norm([-0.5, 2, 1])
    got = P.normals(p, 10, 1.0).collect()
    assert len(got) == 150 and all(abs(abs(np.dot(n, [r["nx"], r["ny"], r["nz"]])) - 1) < 1e-9 and r["variation"] < 1e-12 for r in got)
    ball = sphere(400)
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(ball)], IDS)
    near = nearest(q, q, 9, 0.3)
    rows = P.coherent(P.normals(q, 10, 0.3), near).collect()
    sides = [np.dot(ball[r["id"]], [r["nx"], r["ny"], r["nz"]]) for r in rows]
    assert len(rows) == 400 and len({r["root"] for r in rows}) == 1
    assert all(s > 0.95 for s in sides) or all(s < -0.95 for s in sides)
    seen = P.towards(q, P.normals(q, 10, 0.3), (0.0, 0.0, 0.0)).collect()
    assert all(np.dot(ball[r["id"]], [r["nx"], r["ny"], r["nz"]]) < -0.95 for r in seen)


def test_few_points(spark):
    none = spark.createDataFrame([], IDS)
    assert P.normals(none).count() == 0 and P.outlier_scores(none, 3).count() == 0
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], IDS)
    got = P.normals(one).collect()
    assert all(abs(np.linalg.norm([r["nx"], r["ny"], r["nz"]]) - 1) < 1e-12 and r["variation"] == 0 for r in got) and len(got) == 2
    assert [r["score"] for r in P.outlier_scores(one, 3).collect()] == [0.0, 0.0]


def test_spanning_forest(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b), float(w), int(t)) for a, b, w, t in zip(*rng.integers(0, 60, (2, 150)), np.round(rng.uniform(0, 1, 150), 2), rng.integers(0, 2, 150), strict=True)]
    links += [(100 + i, 101 + i, 0.5, 1) for i in range(7)]  # a path of equal weights
    ids = sorted({v for a, b, *_ in links for v in (a, b)} | {500})
    label, tree = P.spanning_forest(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "a long, b long, weight double, turn int"))
    lightest = {}
    for a, b, w, t in links:
        if a != b:
            lightest[min(a, b), max(a, b)] = min(lightest.get((min(a, b), max(a, b)), (9, 9)), (w, t))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    want = set()
    for (a, b), _ in sorted(lightest.items(), key=lambda x: (x[1][0], x[0])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b))
    got = [tuple(r) for r in tree.collect()]
    assert set(got) == want and len(got) == len(want)
    rows = {r["id"]: r for r in label.collect()}
    assert sorted(rows) == ids and all(rows[r["root"]]["turn"] == 0 for r in rows.values())
    assert all(rows[a]["root"] == rows[b]["root"] and rows[a]["turn"] ^ rows[b]["turn"] == lightest[a, b][1] for a, b in want)
    assert len({r["root"] for r in rows.values()}) == len({root(i) for i in ids})


def test_a_far_point_is_an_outlier(spark):
    p = [(i, float(i % 8), float(i // 8), 0.0) for i in range(64)] + [(64, 30.0, 30.0, 5.0)]
    df = spark.createDataFrame(p, IDS)
    score = {r["id"]: r["score"] for r in P.outlier_scores(df, 8, 2.0).collect()}
    assert max(score, key=score.get) == 64 and score[64] > 0.8 and max(v for k, v in score.items() if k != 64) < 0.3
    assert sorted(r["id"] for r in P.without_outliers(df, 8, 0.5, 2.0).select("id").collect()) == list(range(64))


@pytest.fixture(scope="module")
def triangles(spark):
    cols = [f"{c}{k}" for k in range(3) for c in "xyz"]
    return {r[0]: np.array(r[1:], float).reshape(3, 3) for r in fixtures.table(spark, SF, "node_faces").select("fid", *cols).collect()}


def test_box_clipped(spark, triangles):
    got = {r["of"]: r["area"] for r in QUERIES["vcl_02_box_clipped"](spark, SF).collect()}
    want = {f: area(clipped(t, LOW, HIGH)) for f, t in triangles.items()}
    assert {f for f, a in want.items() if a > 1e-6} <= set(got)
    assert all(abs(a - want[f]) < 1e-5 for f, a in got.items())


def test_both_sides_of_a_cut_make_the_whole_and_fit(spark):
    v, f = octahedra(lambda n: fixtures.table(spark, SF, n).where("vid <= 30"))
    total, borders = 0.0, []
    for s in (1.0, -1.0):
        faces, vertices = C.by_planes(f, v, [((0.2 * s, 0.3 * s, s), 2.4 * s)])
        at = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in vertices.collect()}
        rows = faces.collect()
        assert len({r["fid"] for r in rows}) == len(rows)
        total += sum(area([at[r[f"v{k}"]] for k in range(3)]) for r in rows)
        e = [(r[f"v{k}"], r[f"v{(k + 1) % 3}"]) for r in rows for k in range(3)]
        assert len(set(e)) == len(e)
        single = [x for x in e if x[::-1] not in set(e)]
        assert single and all(abs(at[i] @ [0.2, 0.3, 1.0] - 2.4) < 1e-9 for x in single for i in x)  # open on the plane only
        borders.append({tuple(np.round(at[i], 9)) for x in single for i in x})
    at = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in v.collect()}
    assert abs(total - sum(area([at[r[f"v{k}"]] for k in range(3)]) for r in f.collect())) < 1e-6
    assert borders[0] == borders[1]


def test_clipping_odd_faces(spark):
    points = [(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, None, 0.0, 0.0), (4, 2.0, 0.0, 4.0), (5, 2.0, 4.0, 4.0)]
    v = spark.createDataFrame([(*p, float(10 * p[0])) for p in points], POINTS + ", r double")
    f = spark.createDataFrame([(7, 0, 1, 2), (8, 0, 1, 3), (9, 0, 1, 77), (10, 4, 5, 1)], FACES)
    faces, vertices = C.by_planes(f, v, [((1.0, 0.0, 0.0), 2.0)], ("r",))
    at = {r["vid"]: r for r in vertices.collect()}
    rows = faces.collect()
    assert [r["of"] for r in rows] == [7, 7]  # face 10 only touches the plane
    cut = [at[r[f"v{k}"]] for r in rows for k in range(3) if r[f"v{k}"] > 5]
    assert {(r["x"], r["y"], r["r"]) for r in cut} == {(2.0, 0.0, 5.0), (2.0, 2.0, 15.0)}
    none, _ = C.box(spark.createDataFrame([], FACES), v, (0, 0, 0), (1, 1, 1))
    assert none.count() == 0
    whole, _ = C.box(f, v, (-1, -1, -1), (9, 9, 9))
    assert sorted(r["of"] for r in whole.collect()) == [7, 10]


def test_curvature_of_a_cylinder_and_a_plane(spark):
    n, m = 24, 9
    v = [(i * n + k, float(np.cos(2 * np.pi * k / n)), float(np.sin(2 * np.pi * k / n)), i * 0.25) for i in range(m) for k in range(n)]
    f = []
    for i in range(m - 1):
        for k in range(n):
            a, b, c, d = i * n + k, i * n + (k + 1) % n, (i + 1) * n + k, (i + 1) * n + (k + 1) % n
            f += [(2 * a, a, b, d), (2 * a + 1, a, d, c)]
    at = {p[0]: np.array(p[1:]) for p in v}
    got = {r["vid"]: r for r in V.principal(spark.createDataFrame(f, FACES), spark.createDataFrame(v, POINTS)).collect()}
    assert len(got) == n * m
    for i, r in got.items():
        if n <= i < n * (m - 1):
            # Bends of 2 pi / n along two edges of 0.25 each, none across.
            assert abs(r["k1"] - 2 * 0.25 * 2 * np.pi / n) < 1e-9 and abs(r["k2"]) < 1e-9
            assert abs(abs(r["d1"]["z"]) - 1) < 1e-9 and abs(r["d2"]["z"]) < 1e-9
            assert abs(np.dot([r["d2"]["x"], r["d2"]["y"]], at[i][:2])) < 0.2
    flat = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 1.0, 1.0, 0.0)], POINTS)
    rows = V.principal(spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2), (2, 3, 3, 4)], FACES), flat).collect()
    assert {r["vid"] for r in rows} == {1, 2} and all(r["k1"] == r["k2"] == 0 for r in rows)
    assert V.principal(spark.createDataFrame([], FACES), flat).count() == 0
