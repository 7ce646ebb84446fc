"""Plans of joins whose tables grow beyond the driver, while Spark takes their files for small ones, and of repeated rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meshspark.catalog import QUERIES
from meshspark.operators import geodesic as Q
from meshspark.operators import nodes as N
from meshspark.operators import orient as O
from meshspark.operators import sampling as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch, module) -> list[tuple[str, str]]:
    """(name, plan) of each table that an operator writes from now on."""
    seen, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: (seen.append((name, plan(df))), write(df, name))[1])
    return seen


def test_disks_without_broadcasts(spark, monkeypatch):
    """Points beside cells, 125 to a point at most, met the candidates by a broadcast."""
    seen = written(monkeypatch, S)
    r = np.random.default_rng(3)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r.random((300, 3)) * 8)], "id long, x double, y double, z double")
    assert S.poisson_disk(points, 1.5)[1] > 1
    assert any("Join" in p for _, p in seen) and not any("Broadcast" in p for _, p in seen)


def test_surface_rounds_are_short(spark, monkeypatch):
    """What stays from round to round isn't worked out in each: such rounds were too long to be compiled."""
    seen = written(monkeypatch, Q)
    n = 5
    v = spark.range(n * n).select(F.col("id").alias("vid"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"), F.lit(0.0).alias("z"))
    faces = spark.createDataFrame([f for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for f in ((2 * i, i, i + 1, i + n), (2 * i + 1, i + 1, i + n + 1, i + n))], "fid long, v0 long, v1 long, v2 long")
    Q.surface_distances(faces, v, spark.createDataFrame([(0,)], "id long"), 2.0)
    rounds = [p for name, p in seen if name == "distances"][1:]
    assert rounds and all("SQRT" in p and len(p) < 30_000 and p.count("SQRT") < 100 for p in rounds)


def test_cell_members_without_broadcasts(spark):
    assert "Broadcast" not in plan(QUERIES["flt_04_cell_members"](spark, SF))


def test_inside_without_broadcasts(spark):
    """Six corners and eight faces come from each row of the vertices' file."""
    assert "Broadcast" not in plan(QUERIES["vin_01_inside"](spark, SF))


def test_outward_without_broadcasts(spark, monkeypatch):
    """Oriented faces are worked out once, not at each of their uses, and octahedra meet their corners without a broadcast."""
    seen = written(monkeypatch, O)
    last = plan(QUERIES["vc_43_outward"](spark, SF))
    assert [name for name, _ in seen] == ["oriented"] and not any("Broadcast" in p for p in (seen[0][1], last))


def test_edge_distances_in_batches(spark):
    """Distances come from batches of rows, equal to those of the columns of single rows, null ones too."""
    from meshspark.functions import distances as D
    from meshspark.functions import geometry as G
    from meshspark.functions import intersect as X

    assert "MapInArrow" in plan(QUERIES["vo_25_edge_distances"](spark, SF))
    r = np.random.default_rng(9)
    p = r.random((60, 6, 3)) * 3
    p[0], p[1, 1], p[2, 3:], p[3, 2], p[4, 3:5], p[5, 2, 2] = p[0, 0], p[1, 0], p[2, :3], (p[3, 0] + p[3, 1]) / 2, p[4, :2], np.nan
    names = [f"{x}{k}" for k in range(6) for x in "xyz"]
    df = spark.createDataFrame([(i, *(None if v != v else float(v) for v in q.ravel())) for i, q in enumerate(p)], "id long, " + ", ".join(f"{n} double" for n in names))
    v, w = [G.vec(suffix=str(k)) for k in range(6)], [tuple(p[:, k, i] for i in range(3)) for k in range(6)]
    made = {"lines": X.line_line(v[0], G.sub(v[1], v[0]), v[2], G.sub(v[3], v[2])), "segments": X.segment_segment(*v[:4]), "point": X.triangle_point(v[:3], v[3]), "segment": X.triangle_segment(v[:3], v[3], v[4]), "triangle": X.triangle_triangle_distance(v[:3], v[3:])}
    with np.errstate(all="ignore"):
        got = {"lines": D.line_line(w[0], G.sub(w[1], w[0]), w[2], G.sub(w[3], w[2])), "segments": D.segment_segment(*w[:4]), "point": D.triangle_point(w[:3], w[3]), "segment": D.triangle_segment(w[:3], w[3], w[4]), "triangle": D.triangle_triangle(w[:3], w[3:])}
    for i, row in enumerate(df.select("id", *(x.alias(n) for n, x in made.items())).orderBy("id").collect()):
        for n in made:
            assert (row[n] is None and np.isnan(got[n][i])) or row[n] == got[n][i], (n, i, row[n], got[n][i])


def test_build_saturates_from_tables(spark, monkeypatch):
    """Levels read nodes and edges that are written once: spheres were worked out anew for each, in plans as long as the whole build."""
    seen = written(monkeypatch, N)
    QUERIES["agg_27_build_saturates"](spark, SF)
    levels = [p for name, p in seen if name in ("heights", "saturate")]
    assert levels and not any("FlatMapGroupsInArrow" in p for p in levels)
