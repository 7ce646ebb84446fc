"""Border loops and filled holes: order, no border edge left, least area by trying all triangulations."""

from __future__ import annotations

import itertools
from collections import Counter
from functools import cache

import numpy as np
import pytest

from meshspark import fixtures
from meshspark.catalog import QUERIES
from meshspark.operators import holes as H

SF = "/root/testdata/sf0.001"
FACES, POINTS = "fid long, v0 long, v1 long, v2 long", "vid long, x double, y double, z double"


def half_edges(faces):
    return [(f[k], f[(k + 1) % 3]) for f in faces for k in range(3)]


def open_edges(faces):
    n = Counter(tuple(sorted(e)) for e in half_edges(faces))
    return {e for e in half_edges(faces) if n[tuple(sorted(e))] == 1}


def check_closed(faces, new, left=frozenset()):
    """With the new faces no edge has more than two, every edge is run along both ways, and only `left` stays open."""
    every = half_edges(faces) + half_edges(new)
    assert len(every) == len(set(every))
    assert open_edges(faces + new) == set(left)


@pytest.fixture(scope="module")
def pierced(spark):
    faces = [tuple(r) for r in fixtures.table(spark, SF, "mesh_faces").select("v0", "v1", "v2").collect()]
    return [f for f in faces if not any(v % 47 == 23 for v in f)]


def loops_of(spark):
    got = {}
    for r in QUERIES["vh_06_border_loops"](spark, SF).collect():
        got.setdefault(r["loop"], {})[r["place"]] = r["v"]
    return {k: [v[i] for i in range(len(v))] for k, v in got.items()}


def test_loops_in_order(spark, pierced):
    loops, edges = loops_of(spark), open_edges(pierced)
    assert len(loops) > 2
    for k, v in loops.items():
        assert v[0] == k == min(v) and all(e in edges for e in zip(v, v[1:] + v[:1], strict=True))
    assert sum(map(len, loops.values())) == len(edges)


def test_filled_holes(spark, pierced):
    new = [tuple(r)[1:] for r in QUERIES["vh_12_filled_holes"](spark, SF).collect()]
    loops = loops_of(spark)
    outer = {e for v in loops.values() if len(v) > 40 for e in zip(v, v[1:] + v[:1], strict=True)}
    check_closed(pierced, new, outer)
    assert len(new) == sum(len(v) - 2 for v in loops.values() if len(v) <= 40)


def test_filled_by_ears(spark, pierced):
    new = [tuple(r)[1:] for r in QUERIES["vh_03_filled_by_ears"](spark, SF).collect()]
    check_closed(pierced, new)
    assert len(new) == sum(len(v) - 2 for v in loops_of(spark).values())


@pytest.mark.parametrize("n", [3, 4, 6, 9, 10])
def test_least_area(n):
    r = np.random.default_rng(n)
    p = r.random((n, 3))
    barred = {(0, 2), (1, n - 2)} if n > 5 else set()

    @cache
    def least(i, k):
        if k - i == 1:
            return 0.0
        if (i, k) in barred and k - i < n - 1:
            return float("inf")
        return min(least(i, j) + least(j, k) + float(np.linalg.norm(np.cross(p[j] - p[i], p[k] - p[i]))) / 2 for j in range(i + 1, k))

    def every(i, k):
        """All triangulations of places i .. k, as sets of triangles."""
        if k - i == 1:
            return [[]]
        return [[(i, j, k), *a, *b] for j in range(i + 1, k) for a, b in itertools.product(every(i, j), every(j, k))]

    area, tri = H.triangulation(p, barred)
    size = lambda t: sum(float(np.linalg.norm(np.cross(p[j] - p[i], p[k] - p[i]))) / 2 for i, j, k in t)
    allowed = [t for t in every(0, n - 1) if not any((i, j) in barred or (j, k) in barred or ((i, k) in barred and k - i < n - 1) for i, j, k in t)]
    assert area == pytest.approx(min(map(size, allowed))) == pytest.approx(least(0, n - 1)) and size(tri) == pytest.approx(area) and len(tri) == n - 2


def test_odd_borders(spark):
    """A lone triangle, two that touch in a point, and no faces: what closes, and what is left out."""
    v = spark.createDataFrame([(i, float(i % 3), float(i // 3), 0.0) for i in range(12)], POINTS)
    lone = H.fill_holes(spark.createDataFrame([(0, 0, 1, 4)], FACES), v).collect()
    assert [tuple(sorted(tuple(r)[1:])) for r in lone] == [(0, 1, 4)] and half_edges([tuple(lone[0])[1:]]) != half_edges([(0, 1, 4)])
    assert H.fill_holes(spark.createDataFrame([(0, 0, 1, 4), (1, 4, 8, 7)], FACES), v).count() == 0
    assert H.fill_holes(spark.createDataFrame([], FACES), v).count() == 0
