"""Orientation, geodesic distances, Poisson disks, self-intersections and rays against brute force."""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog import QUERIES
from meshspark.operators import crossing as K
from meshspark.operators import geodesic as Q
from meshspark.operators import orient as O
from meshspark.operators import sampling as S

SF = "/root/testdata/sf0.001"
FACES = "fid long, v0 long, v1 long, v2 long"
POINTS = "vid long, x double, y double, z double"


@pytest.fixture(scope="module")
def mesh(spark):
    v = {r[0]: np.array(r[1:], float) for r in fixtures.table(spark, SF, "mesh_vertices").select("vid", "x", "y", "z").collect()}
    return v, [tuple(r) for r in fixtures.table(spark, SF, "mesh_faces").select("fid", "v0", "v1", "v2").collect()]


def directed(faces):
    return [(f[k], f[(k + 1) % 3]) for _, *f in faces for k in range(3)]


# ---- orientation


def test_oriented_components(spark):
    strip = [(0, 0, 1, 2), (1, 1, 2, 3), (2, 2, 4, 3), (10, 20, 21, 22), (11, 21, 23, 22), (30, 40, 41, 42)]
    got = {r["fid"]: r for r in O.orient(spark.createDataFrame(strip, FACES)).collect()}
    assert [got[k]["component"] for k in sorted(got)] == [0, 0, 0, 10, 10, 30] and all(r["orientable"] for r in got.values())
    assert not got[0]["flipped"] and not got[10]["flipped"] and not got[30]["flipped"]
    e = directed([(r["fid"], r["v0"], r["v1"], r["v2"]) for r in got.values()])
    assert len(set(e)) == len(e)
    assert O.orient(spark.createDataFrame([], FACES)).count() == 0


def test_a_moebius_strip_is_refused(spark):
    n = 7  # quads, the last of which joins the first upside down
    low, high = list(range(n)) + [n], list(range(n, 2 * n)) + [0]
    faces = []
    for k in range(n):
        faces += [(2 * k, low[k], low[k + 1], high[k]), (2 * k + 1, low[k + 1], high[k + 1], high[k])]
    flat = [(100 + 2 * k, a + 100, b + 100, c + 100) for k, a, b, c in faces[:2]]
    got = O.orient(spark.createDataFrame(faces + flat, FACES)).collect()
    assert all(r["orientable"] == (r["fid"] >= 100) for r in got) and not any(r["flipped"] for r in got if not r["orientable"])


def test_outward(spark, mesh):
    v, _ = mesh
    at = {vid * 6 + i: v[vid] + 0.45 * np.array(e) for vid in v for i, e in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])}
    rows = QUERIES["vc_43_outward"](spark, SF).collect()
    assert len(rows) == 8 * len(v) and any(r["flipped"] for r in rows)
    for r in rows:
        p = [at[r[f"v{k}"]] for k in range(3)]
        assert np.cross(p[1] - p[0], p[2] - p[0]) @ (p[0] + p[1] + p[2] - 3 * v[r["fid"] // 8]) > 0


# ---- distances


def lengths(v, faces):
    return {(a, b): float(np.sqrt(((v[a] - v[b]) ** 2).sum())) for x, y in directed(faces) for a, b in ((x, y), (y, x))}


def dijkstra(links, sources):
    near = {}
    for (a, b), w in links.items():
        near.setdefault(a, []).append((b, w))
    done, heap = {}, [(0.0, s) for s in sources]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in done:
            done[a] = d
            for b, w in near.get(a, []):
                heapq.heappush(heap, (d + w, b))
    return done


@pytest.mark.parametrize("delta", [0.5, 3.0, 1e9])
def test_paths_equal_dijkstra(spark, mesh, delta):
    v, faces = mesh
    some = [f for f in faces if f[1] < 100]
    links = lengths(v, some)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()] + [(900, 901, 1.0)], "a long, b long, w double")
    paths, rounds = Q.shortest_paths(df, spark.createDataFrame([(0,), (77,), (0,), (5000,)], "id long"), delta)
    got = {r["id"]: r for r in paths.collect()}
    want = dijkstra(links, [0, 77]) | {5000: 0.0}
    assert {k: r["distance"] for k, r in got.items()} == pytest.approx(want) and rounds > 1
    for k, r in got.items():
        assert (r["parent"] is None) == (k in (0, 77, 5000)) and (r["parent"] is None or got[r["parent"]]["source"] == r["source"])
        assert r["parent"] is None or got[r["parent"]]["distance"] + links[r["parent"], k] == pytest.approx(r["distance"])
    assert Q.shortest_paths(df, spark.createDataFrame([], "id long"), 1.0)[0].count() == 0


def test_border_distances(spark, mesh):
    v, faces = mesh
    count = {}
    for a, b in directed(faces):
        count[min(a, b), max(a, b)] = count.get((min(a, b), max(a, b)), 0) + 1
    border = {x for e, n in count.items() if n == 1 for x in e}
    along = dijkstra(lengths(v, faces), border)
    assert {r["id"]: r["distance"] for r in QUERIES["vg_10_paths_from_border"](spark, SF).collect()} == pytest.approx(along)
    across = {r["vid"]: r["distance"] for r in QUERIES["vg_04_surface_distances"](spark, SF).collect()}
    assert set(across) == set(along) and all(across[k] <= along[k] + 1e-9 for k in along) and sum(along.values()) - sum(across.values()) > 1


def test_distances_across_a_plane(spark):
    """On a flat grid the way across faces is the straight one, where edges alone take steps."""
    n = 7
    v = [(y * n + x, float(x), float(y), 0.0) for y in range(n) for x in range(n)]
    faces = [f for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for f in ((2 * i, i, i + 1, i + n), (2 * i + 1, i + 1, i + n + 1, i + n))]
    vertices, cells = spark.createDataFrame(v, POINTS), spark.createDataFrame(faces, FACES)
    got = {r["vid"]: r["distance"] for r in Q.surface_distances(cells, vertices, spark.createDataFrame([(0,)], "id long"), 2.0)[0].collect()}
    for i, x, y, _ in v:
        assert np.hypot(x, y) - 1e-9 <= got[i] <= 1.08 * np.hypot(x, y)
    paths = {r["id"]: r["distance"] for r in Q.shortest_paths(Q.edge_lengths(cells, vertices), spark.createDataFrame([(0,)], "id long"), 2.0)[0].collect()}
    assert paths[n * n - 1] == 2 * (n - 1) and got[n * n - 1] < 0.8 * paths[n * n - 1]


# ---- samples


@pytest.mark.parametrize("parts", [1, 7])
def test_poisson_disks(spark, parts):
    r = np.random.default_rng(4)
    p = np.concatenate([r.random((800, 3)) * [10, 10, 2], np.repeat([[5.0, 5.0, 1.0]], 300, 0)])
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(7, *map(float, p[7])), (9999, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(parts)
    got, rounds = S.poisson_disk(df, 1.1)
    kept = sorted(x["id"] for x in got.collect())
    d = np.sqrt(((p[:, None] - p[None, kept]) ** 2).sum(2))
    assert (d.min(1) < 1.1).all() and rounds < 20
    assert all(np.linalg.norm(p[a] - p[b]) >= 1.1 for a, b in combinations(kept, 2))
    test_poisson_disks.seen = getattr(test_poisson_disks, "seen", kept)
    assert kept == test_poisson_disks.seen  # whatever the partitions
    assert S.poisson_disk(df.limit(0), 1.0)[0].count() == 0


def test_poisson_disks_of_a_number(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, x), 0.0) for i, x in enumerate(r.random((3000, 2)) * 10)], "id long, x double, y double, z double")
    kept, radius = S.poisson_disk_of(df, 60, 100.0, slack=0.1)
    assert abs(kept.count() - 60) <= 6 and 0.3 < radius / S.disk_radius(100.0, 60) < 2 and S.disk_samples(100.0, S.disk_radius(100.0, 60)) in (59, 60)


def test_poisson_query(spark, mesh):
    v, _ = mesh
    kept = [v[r["id"]] for r in QUERIES["vps_47_poisson_disk"](spark, SF).collect()]
    d = np.sqrt(((np.array(list(v.values()))[:, None] - np.array(kept)[None]) ** 2).sum(2))
    assert (d.min(1) < 2.5).all() and all(np.linalg.norm(a - b) >= 2.5 for a, b in combinations(kept, 2))


# ---- what meets


def passes(a, b, t):
    m = np.stack([a - b, t[1] - t[0], t[2] - t[0]], 1)
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    return np.linalg.solve(m, a - t[0])


def meet(f, g, p):
    shared = set(f) & set(g)
    x, y = (np.array([p[k] for k in s]) for s in (f, g))
    if len(shared) == 3:
        return True
    if len(shared) == 2:
        return False
    if len(shared) == 1:
        (s,) = shared
        for own, other in ((f, y), (g, x)):
            a, b = (p[k] * 0.5 + p[s] * 0.5 for k in own if k != s)
            k = passes(a, b, other)
            if k is not None and 0 <= k[0] <= 1 and k[1] > 1e-12 and k[2] > 1e-12 and k[1] + k[2] < 1:
                return True
        return False
    for u, w in ((x, y), (y, x)):
        for i in range(3):
            k = passes(u[i], u[(i + 1) % 3], w)
            if k is not None and 0 <= k[0] <= 1 and k[1] >= 0 and k[2] >= 0 and k[1] + k[2] <= 1:
                return True
    return False


def test_self_intersections(spark, mesh):
    v, faces = mesh
    p = v | {k + (1 << 40): x + [0.37, 0.21, 0.53] for k, x in v.items()}
    every = faces + [tuple(i + (1 << 40) for i in f) for f in faces]
    got = [tuple(r) for r in QUERIES["vc_47_self_intersections"](spark, SF).collect()]
    box = {f: (np.min([p[k] for k in c], 0), np.max([p[k] for k in c], 0)) for f, *c in every}
    want = {(min(a, b), max(a, b)) for (a, *x), (b, *y) in combinations(every, 2) if (box[a][0] <= box[b][1]).all() and (box[b][0] <= box[a][1]).all() and meet(x, y, p)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("most", [2, 40, 1000])
def test_self_intersections_of_shared_corners_and_hot_cells(spark, most):
    r = np.random.default_rng(9)
    p = {i: x for i, x in enumerate(r.random((60, 3)))}
    p |= {100 + i: x for i, x in enumerate(r.random((30, 3)) * 0.02)}
    some = [tuple(map(int, r.choice(60, 3, replace=False))) for _ in range(60)] + [tuple(map(int, 100 + r.choice(30, 3, replace=False))) for _ in range(60)]
    some += [some[0], some[0][::-1], (1, 1, 2)]
    faces = [(i, *f) for i, f in enumerate(some)]
    got = [tuple(x) for x in K.self_intersections(spark.createDataFrame(faces, FACES), spark.createDataFrame([(i, *map(float, x)) for i, x in p.items()], POINTS), most=most).collect()]
    want = {(a, b) for (a, *x), (b, *y) in combinations(faces, 2) if 122 not in (a, b) and meet(x, y, p)}
    assert len(got) == len(set(got)) and set(got) == want


def test_faces_of_one_plane(spark):
    v = [(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.5, 0.5, 0.0), (4, 3.0, 0.5, 0.0), (5, 3.0, 1.0, 0.0), (6, 2.0, 2.0, 0.0)]
    faces = [(0, 0, 1, 2), (1, 3, 4, 5), (2, 1, 6, 2)]
    got = {tuple(x) for x in K.self_intersections(spark.createDataFrame(faces, FACES), spark.createDataFrame(v, POINTS)).collect()}
    assert got == {(0, 1), (1, 2)}


@pytest.mark.parametrize("most", [3, 10_000])
def test_overlapping_boxes(spark, most):
    r = np.random.default_rng(1)
    low = np.concatenate([r.random((150, 3)) * 20, 10 + r.random((60, 3)) * 0.1])
    high = low + np.concatenate([r.random((150, 3)) * 3, r.random((60, 3)) * 0.2]) + np.array([[12.0, 0, 0]] + [[0, 0, 0]] * 209)
    rows = [(i, *(float(x[a]) for a in range(3) for x in (m, n))) for i, (m, n) in enumerate(zip(low, high, strict=True))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{m}_{a} double" for a in "xyz" for m in ("min", "max")))
    got = [tuple(x) for x in K.overlapping(df, most=most).collect()]
    want = {(a, b) for a, b in combinations(range(len(low)), 2) if (low[a] <= high[b]).all() and (low[b] <= high[a]).all()}
    assert len(got) == len(set(got)) and set(got) == want


def test_rays(spark, mesh):
    v, faces = mesh
    r = np.random.default_rng(2)
    o = r.random((60, 3)) * [22, 12, 8] - [1, 1, 2]
    d = r.normal(size=(60, 3))
    d[:6] = np.concatenate([np.eye(3), -np.eye(3)])
    rays = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(o, d, strict=True))] + [(99, None, 0.0, 0.0, 0.0, 0.0, 1.0)], "id long, " + ", ".join(f"{s}{a} double" for s in "od" for a in "xyz"))
    soup = spark.createDataFrame([(f, *(float(x) for k in c for x in v[k])) for f, *c in faces], "fid long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    want = {}
    for i in range(60):
        for f, *c in faces:
            k = passes(o[i], o[i] + d[i], np.array([v[x] for x in c]))
            if k is not None and k[0] >= 0 and k[1] >= 0 and k[2] >= 0 and k[1] + k[2] <= 1:
                want[i, f] = k[0]
    got = {(x["id"], x["fid"]): x["t"] for x in K.ray_triangles(rays, soup).collect()}
    assert got == pytest.approx(want) and len(want) > 30
    first = {x["id"]: x["fid"] for x in K.first_hits(rays, soup, 0.7).collect()}
    assert first == {i: min((t, f) for (j, f), t in want.items() if j == i)[1] for i in {j for j, _ in want}}
    assert K.first_hits(rays, soup.limit(0)).count() == 0


def test_inside_a_tetrahedron(spark):
    v = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]
    faces = [(0, 0, 2, 1), (1, 0, 1, 3), (2, 0, 3, 2), (3, 1, 2, 3)]
    p = np.random.default_rng(3).random((200, 3)) * 1.2 - 0.1
    soup = spark.createDataFrame([(f, *(x for k in c for x in v[k][1:])) for f, *c in faces], "fid long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    got = {x["id"]: x["inside"] for x in K.inside(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double"), soup).collect()}
    assert got == {i: bool((x > 0).all() and x.sum() < 1) for i, x in enumerate(p)}
