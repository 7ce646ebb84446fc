"""Queries without SQL: each runs on the small tables and equals brute force; shapes without area or length."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog import ORACLE_SQL, QUERIES
from meshspark.functions import intersect as X
from meshspark.operators import nodes as N
from meshspark.plans import build as B

SF = "/root/testdata/sf0.001"
POINTS = [f"{c}{k}" for k in range(3) for c in "xyz"]


def rows(spark, name, *cols):
    return [tuple(r) for r in fixtures.table(spark, SF, name).select(*cols).orderBy(*cols).collect()]


@pytest.fixture(scope="module")
def triangles(spark):
    got = rows(spark, "node_faces", "fid", *POINTS)
    return {r[0]: np.array(r[1:], float).reshape(3, 3) for r in got}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def meeting(o, d, t):
    """Parameter of a line's meeting with a triangle, by solving for it."""
    m = np.stack([-d, t[1] - t[0], t[2] - t[0]], 1)
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    k, u, v = np.linalg.solve(m, o - t[0])
    return k if u >= 0 and v >= 0 and u + v <= 1 else None


def clipped(t, low, high):
    """What a box leaves of a triangle: corners of a polygon."""
    poly = list(t)
    for i in range(3):
        for sign, k in ((1, low[i]), (-1, -high[i])):
            out = []
            for a, b in zip(poly, poly[1:] + poly[:1], strict=True):
                s, e = sign * a[i] - k, sign * b[i] - k
                if s >= 0:
                    out.append(a)
                if (s > 0 > e) or (s < 0 < e):
                    out.append(a + (b - a) * s / (s - e))
            poly = out
            if not poly:
                return poly
    return poly


def grid(n=40):
    s = np.linspace(0, 1, n)
    return s, np.array([(a, b) for a in s for b in s if a + b <= 1 + 1e-9])


def apart(p, q):
    return float(np.sqrt(((p[:, None] - q[None]) ** 2).sum(2).min()))


def near(got, want):
    return got == want or (got is not None and want is not None and abs(got - want) < 2e-4)


def test_triangle_meetings(spark, triangles):
    o, d = np.array([3.3, 4.4, -1]), np.array([0.01, 0.02, 1])
    low, high = np.array([4, 5, 1.0]), np.array([6.5, 9.5, 2.2])
    _, u = grid()
    hits = 0
    for r in QUERIES["vo_10_triangle_meetings"](spark, SF).collect():
        t = triangles[r["fid"]]
        k = meeting(o, d, t)
        hits += k is not None
        assert near(r["line"], k) and near(r["ray"], k if k is not None and k >= 0 else None) and near(r["segment"], k / 2.5 if k is not None and 0 <= k <= 2.5 else None)
        assert r["box"] == bool(clipped(t, low, high))
        other = t[[0, 2, 1]] + np.array([0.35, 0.2, 0.1])
        ks = [meeting(x[i], x[(i + 1) % 3] - x[i], y) for x, y in ((t, other), (other, t)) for i in range(3)]
        assert r["triangle"] == any(k is not None and 0 <= k <= 1 for k in ks)
        inner = t[0] + u[:, :1] * (t[1] - t[0]) + u[:, 1:] * (t[2] - t[0])
        away = apart(inner, np.array([[5, 6, 2.0]]))
        assert not r["sphere"] or away <= 2.5 + 0.2
        assert r["sphere"] or away >= 2.5
    assert hits


def test_box_meetings(spark):
    o, d = np.array([-2, -3, 1.0]), np.array([0.6, 0.8, 0.05])
    for r, (node, *center) in zip(QUERIES["vo_12_box_meetings"](spark, SF).orderBy("node").collect(), rows(spark, "dag_nodes", "node", "cx", "cy", "cz"), strict=True):
        c = np.array(center)
        spans = np.sort(np.stack([(c - 1 - o) / d, (c + 1 - o) / d]), axis=0)
        first, last = spans[0].max(), spans[1].min()
        hit = first <= last
        assert r["node"] == node and near(r["first"], first if hit else None) and near(r["last"], last if hit else None)
        assert near(r["ray"], max(first, 0) if hit and last >= 0 else None) and bool(r["segment"]) == (hit and last >= 0 and first <= 20)


def test_edge_distances(spark, triangles):
    a, b, e = np.array([2, 3, 6.0]), np.array([9, 12, 0.5]), np.array([4, 8, 7.0])
    s, u = grid()
    seg, tri = a + s[:, None] * (b - a), a + u[:, :1] * (b - a) + u[:, 1:] * (e - a)
    for r in QUERIES["vo_25_edge_distances"](spark, SF).collect():
        t = triangles[r["fid"]]
        inner = t[0] + u[:, :1] * (t[1] - t[0]) + u[:, 1:] * (t[2] - t[0])
        n = np.cross(t[1] - t[0], b - a)
        assert near(r["lines"], abs((a - t[0]) @ n) / np.linalg.norm(n))
        edge = t[0] + s[:, None] * (t[1] - t[0])
        for name, want in (("segments", apart(edge, seg)), ("point", apart(inner, a[None])), ("segment", apart(inner, seg)), ("triangle", apart(inner, tri[::2]))):
            assert want - 0.45 <= r[name] <= want + 1e-3, name


SHAPES = {
    "point": [[1, 1, 1]] * 3,
    "line": [[0, 0, 0], [1, 0, 0], [2, 0, 0]],
    "flat": [[0, 0, 0], [1, 0, 0], [0, 1, 0]],
    "far": [[50, 50, 50], [51, 50, 50], [50, 51, 50]],
}


def test_shapes_without_area(spark):
    """Every function gives a value or a null, none divides by zero; distances to points and lines are right."""
    data = [(f"{m} {n}", *np.ravel(a).astype(float).tolist(), *np.ravel(b).astype(float).tolist()) for m, a in SHAPES.items() for n, b in SHAPES.items()]
    cols = [f"{p}{c}" for p in "abcdef" for c in "xyz"]
    df = spark.createDataFrame(data, "name string, " + ", ".join(f"{c} double" for c in cols))
    a, b, c, d, e, f = (tuple(F.col(f"{p}{x}") for x in "xyz") for p in "abcdef")
    s, t = (a, b, c), (d, e, f)
    step = X.G.sub(e, d)
    first, last = X.line_box(d, step, a, b)
    got = df.select(
        "name", X.triangle_triangle_distance(s, t).alias("dist"), X.triangle_triangle(s, t).alias("meet"), X.line_triangle(d, step, s).alias("line"), first.alias("first"), last.alias("last"),
        X.line_point2(d, step, a).alias("to_line"), X.line_line(a, X.G.sub(b, a), d, step).alias("lines"), X.plane_point2(step, F.lit(0.0), a).alias("plane"), X.segment_segment(a, b, d, e).alias("segments"),
        X.quality(s).alias("q"), X.quality_radii(s).alias("qr"), X.quality_mean_ratio(s).alias("qm"), X.triangle_box(s, d, e).alias("box"), X.coplanar(s, t).alias("coplanar"), X.coplanar_overlap(s, t).alias("overlap"), X.plane_segment_within((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(0.0), a, d, 1e-6).alias("end"),
    ).collect()
    by = {r["name"]: r for r in got}
    inner = {n: np.array(v, float) for n, v in SHAPES.items()}
    s1, u = grid(21)
    for m, p in inner.items():
        for n, q in inner.items():
            x, y = (z[0] + u[:, :1] * (z[1] - z[0]) + u[:, 1:] * (z[2] - z[0]) for z in (p, q))
            assert by[f"{m} {n}"]["dist"] == pytest.approx(apart(x, y), abs=0.05)
    assert by["point point"]["to_line"] == 0 and by["line point"]["to_line"] == 3 and by["line point"]["lines"] == pytest.approx(2**0.5)
    assert by["point line"]["plane"] == 1 and by["flat point"]["plane"] is None
    assert by["flat flat"]["coplanar"] and by["flat flat"]["overlap"] and not by["flat far"]["coplanar"]
    assert by["point flat"]["end"] == 1.0 and by["line line"]["end"] == 0.0


def test_coplanar_neighbours_do_not_overlap(spark):
    quad = [(0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 0, 0, 1, 1, 0, 0, 1, 0), (0, 0, 0, 2, 0, 0, 0, 2, 0, 0.5, 0.5, 0, 3, 0.5, 0, 3, 1, 0), (0, 0, 0, 0, 2, 0, 0, 0, 2, 0, 0.5, 0.5, 0, 0.6, 0.5, 0, 0.5, 0.6)]
    df = spark.createDataFrame([tuple(map(float, q)) for q in quad], ", ".join(f"{p}{c} double" for p in "abcdef" for c in "xyz"))
    a, b, c, d, e, f = (tuple(F.col(f"{p}{x}") for x in "xyz") for p in "abcdef")
    assert [tuple(r) for r in df.select(X.coplanar((a, b, c), (d, e, f)), X.coplanar_overlap((a, b, c), (d, e, f))).collect()] == [(True, False), (True, True), (True, True)]


# ---- spheres


def smallest(p):
    """Of all spheres through up to four points, the smallest that holds all."""
    best = np.inf
    for k in range(1, min(4, len(p)) + 1):
        for some in combinations(range(len(p)), k):
            got = N._through(p[list(some)])
            if got is not None and got[1] < best and (np.linalg.norm(p - got[0], axis=1) <= got[1] * (1 + 1e-9) + 1e-12).all():
                best = got[1]
    return best


def test_smallest_spheres(spark):
    r = np.random.default_rng(0)
    for k in range(60):
        p = r.normal(size=(r.integers(1, 9), 3))
        p = p.round(0) if k % 3 == 0 else p
        p[:, 2] *= k % 5 > 0
        center, radius = N.tight_sphere(p)
        assert radius == pytest.approx(smallest(p), rel=1e-7, abs=1e-9) and np.linalg.norm(p - center, axis=1).max() <= radius * (1 + 1e-9)
        if k % 12 == 0:
            df = spark.createDataFrame(p.tolist() + [[None, 0.0, 0.0]], "x double, y double, z double")
            (row,) = N.enclosing_sphere(df).collect()
            assert row["radius"] == pytest.approx(radius, rel=1e-7, abs=1e-9)
    assert N.enclosing_sphere(spark.createDataFrame([], "x double, y double, z double")).count() == 0


def test_sphere_queries(spark):
    at = {}
    for node, *p in rows(spark, "node_vertices", "node", "x", "y", "z"):
        at.setdefault(node, []).append(p)
    got = {r["node"]: r for r in QUERIES["agg_10_bounding_sphere"](spark, SF).collect()}
    described = {r["node"]: r for r in QUERIES["prj_18_node_descriptor"](spark, SF).collect()}
    assert set(got) == set(at) == set(described)
    for node, p in at.items():
        p, r = np.array(p, float), got[node]
        away = np.linalg.norm(p - [r["cx"], r["cy"], r["cz"]], axis=1)
        on = p[away >= r["radius"] * (1 - 1e-6)]
        # The smallest: it holds all, and its center is a mean of points it touches.
        assert away.max() <= r["radius"] * (1 + 1e-9) and smallest(on[:12]) == pytest.approx(r["radius"], rel=1e-6)
        assert described[node]["radius"] == pytest.approx(r["radius"]) and described[node]["nvert"] == len(p)
    (scene,) = QUERIES["agg_41_scene_sphere"](spark, SF).collect()
    p = np.array(rows(spark, "mesh_vertices", "x", "y", "z"), float)
    assert scene["radius"] == pytest.approx(N.tight_sphere(p)[1], rel=1e-7)


# ---- partition and build


@pytest.mark.parametrize("bound", [None, 4])
def test_partition_in_several_passes(spark, monkeypatch, bound):
    """With a sample of a few triangles a pass the cells still hold all triangles and no more than they may."""
    if bound:
        monkeypatch.setattr(B, "PASS_LEAVES", bound)
        monkeypatch.setattr(B, "SAMPLES", 32)
    tri = fixtures.table(spark, "/root/testdata/sf0.01", "node_faces").select("fid", *POINTS)
    at, boxes = B.partition(tri, 100)
    sizes = [r["count"] for r in at.groupBy("cell").count().collect()]
    assert sum(sizes) == tri.count() == at.select("fid").distinct().count() and max(sizes) <= 100
    met = at.join(boxes, "cell")
    assert met.count() == at.count() and met.where(~(B._inside(0) | B._inside(1) | B._inside(2))).count() == 0
    b = np.array([tuple(r) for r in boxes.select("cell", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z").collect()])[:, 1:].reshape(-1, 3, 2)
    for i, j in combinations(range(min(len(b), 40)), 2):
        assert (np.minimum(b[i, :, 1], b[j, :, 1]) <= np.maximum(b[i, :, 0], b[j, :, 0])).any()


def test_built_graph(spark):
    nodes = {r["node"]: r for r in QUERIES["msh_10_build_nodes"](spark, SF).collect()}
    patches = QUERIES["msh_11_build_patches"](spark, SF).collect()
    assert all(p["src"] in nodes and p["dst"] in nodes and nodes[p["src"]]["level"] == nodes[p["dst"]]["level"] + 1 for p in patches)
    counts = {r["cell"]: r for r in QUERIES["msh_13_simplified_counts"](spark, SF).collect()}
    finest = {r["cell"]: r for r in nodes.values() if r["level"] == 0}
    assert set(counts) == set(finest) and all(counts[c]["nface"] <= finest[c]["nface"] for c in counts)
    assert sum(r["nface"] for r in finest.values()) == fixtures.table(spark, SF, "node_faces").count()


def test_saturated_graph(spark):
    """agg_27: from the leaves up, every node folds over its children."""
    s = {r["node"]: r for r in QUERIES["agg_27_saturate"](spark, SF).collect()}
    raw = {n: [n * 7919 % 1000 / 10, np.array(p), 1.0 + n % 5] for n, *p in rows(spark, "dag_nodes", "node", "cx", "cy", "cz")}
    kids = {}
    for src, ordinal, dst in rows(spark, "dag_patches", "src", "ordinal", "dst"):
        if src in raw and dst in raw:
            kids.setdefault(src, []).append((ordinal, dst))
    for n in sorted(raw, reverse=True):
        error, center, radius = raw[n]
        mine = sorted(kids.get(n, []))
        for _, k in mine:
            error = raw[k][0] * 1.01 if error <= raw[k][0] else error
        if mine:
            radius = max(radius, *(np.linalg.norm(raw[k][1] - center) + raw[k][2] for _, k in mine)) * 1.01
        raw[n] = [error, center, radius]
        assert s[n]["error"] == pytest.approx(error) and s[n]["radius"] == pytest.approx(radius)


def test_quadric_minimum(spark):
    q = {}
    for r in fixtures.table(spark, SF, "node_faces").select("v0", "v1", "v2", *POINTS).collect():
        p = np.array(r[3:], float).reshape(3, 3)
        n = np.cross(p[1] - p[0], p[2] - p[0])
        n = n / np.linalg.norm(n)
        plane = np.append(n, -n @ p[0])
        for v in r[:3]:
            q[v] = q.get(v, np.zeros((4, 4))) + np.outer(plane, plane)
    got = QUERIES["fn_m22_quadric_minimum"](spark, SF).collect()
    assert got
    for r in got:
        m = q[r["vid"]]
        x = [r["x"], r["y"], r["z"]] if "x" in r else [r[1], r[2], r[3]]
        if None in x:
            assert abs(np.linalg.det(m[:3, :3])) < 1e-5
        else:
            want = np.linalg.solve(m[:3, :3], -m[:3, 3])
            assert np.allclose(x, want, atol=1e-3 * (1 + np.abs(want).max()))


# ---- borders


def test_holes_and_steps_from_border(spark):
    faces = rows(spark, "mesh_faces", "v0", "v1", "v2")
    count = {}
    for f in faces:
        for i in range(3):
            e = tuple(sorted((f[i], f[(i + 1) % 3])))
            count[e] = count.get(e, 0) + 1
    border = [e for e, n in count.items() if n == 1]
    assert sorted(r["edges"] for r in QUERIES["vc_33_holes"](spark, SF).collect()) == [len(border)]
    near = {}
    for a, b in count:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    front, steps, k = {v for e in border for v in e}, {}, 0
    while front:
        steps |= dict.fromkeys(front, k)
        front, k = {w for v in front for w in near[v]} - set(steps), k + 1
    assert {r["vid"]: r["steps"] for r in QUERIES["vg_05_steps_from_border"](spark, SF).collect()} == steps
