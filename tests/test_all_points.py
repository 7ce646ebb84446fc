"""Neighbours of every point and children of every node, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from meshspark import fixtures
from meshspark.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, k, shift", [("jon_11_all_nearest", 4, 0.0), ("jon_13_all_closest", 1, 0.3)])
def test_neighbours_of_all_points(spark, name, k, shift):
    pts = np.array(sorted(tuple(map(float, r)) for r in fixtures.table(spark, SF, "mesh_vertices").select("vid", "x", "y", "z").collect()))
    want = []
    for i, x, y, z in pts:
        d = np.array([x + shift, y, z]) - pts[:, 1:]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        want += [(int(i), int(pts[j, 0])) for j in np.lexsort((pts[:, 0], d2))[:k]]
    assert sorted((r["q"], r["p"]) for r in QUERIES[name](spark, SF).collect()) == sorted(want)


def test_children_of_all_nodes(spark):
    nodes = {r["node"] for r in fixtures.table(spark, SF, "dag_nodes").collect()}
    want = sorted((r["src"], r["dst"]) for r in fixtures.table(spark, SF, "dag_patches").collect() if {r["src"], r["dst"]} <= nodes)
    assert max(want)[0] >= 50
    assert sorted((r["src"], r["dst"]) for r in QUERIES["dag_03_all_children"](spark, SF).collect()) == want


def test_neighbours_end_without_points_and_with_nulls(spark):
    from meshspark.operators.points import nearest

    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0)], "id long, x double, y double, z double")
    p = spark.createDataFrame([(7, 3.0, 4.0, 0.0), (8, None, 1.0, 1.0)], "id long, x double, y double, z double")
    assert nearest(q, p.limit(0), 2, 1.0).count() == 0
    assert [tuple(r) for r in nearest(q, p, 2, 0.5).collect()] == [(1, 7, 25.0, 1)]
