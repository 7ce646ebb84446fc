"""Points: boxes, order statistics, neighbours, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import points as P
from . import query

PTS = "p AS (SELECT CAST(vid AS BIGINT) AS id, x, y, z FROM mesh_vertices)"
pts = lambda t: t("mesh_vertices").select(F.col("vid").alias("id"), "x", "y", "z")
BOX = ", ".join(f"{m}({c}) AS {m}_{c}" for c in "xyz" for m in ("min", "max"))
D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"


@query("agg_01_bounds", f"SELECT {BOX} FROM splats")
def _(t):
    return P.bounds(t("splats"))


@query("agg_02_cell_bounds", f"SELECT node, {BOX} FROM splats GROUP BY node")
def _(t):
    return P.bounds(t("splats"), ["node"])


@query("agg_03_order_statistic", "SELECT x AS split FROM (SELECT x, row_number() OVER (ORDER BY x, pid) AS n, count(*) OVER () AS total FROM splats) WHERE n = CAST(floor(total * 0.3333) AS BIGINT) + 1")
def _(t):
    return P.order_statistic(t("splats"), "x", ["pid"], 0.3333)


@query("agg_05_counts", "SELECT node, count(*) AS n FROM splats GROUP BY node")
def _(t):
    return t("splats").groupBy("node").agg(F.count("*").alias("n"))


@query("agg_17_spacing", "SELECT node, round(8 * sqrt(power((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 2.0::DOUBLE / 3) / count(*)), 4) AS spacing FROM splats GROUP BY node")
def _(t):
    return P.spacing(t("splats"), ["node"]).select("node", F.round("spacing", 4).alias("spacing"))


@query("flt_03_in_box", "SELECT pid FROM splats WHERE x >= 5 AND x < 20 AND y >= 1 AND y < 6 AND z >= 0 AND z < 4")
def _(t):
    return t("splats").where(G.in_box(G.vec(), (5, 1, 0), (20, 6, 4))).select("pid")


@query("jon_12_within", f"WITH {PTS}, q AS (SELECT * FROM p) SELECT q.id AS q, p.id AS p, round({D2}, 4) AS d2 FROM q, p WHERE {D2} < 2.25")
def _(t):
    p = pts(t)
    return P.within(p, p, 1.5).select("q", "p", F.round("d2", 4).alias("d2"))


# All points are queries; SQL would compare every pair.
@query("jon_11_all_nearest", None)
def _(t):
    p = pts(t)
    return P.nearest(p, p, 4, 2.0).select("q", "p", F.round("d2", 4).alias("d2"), "rank")


@query("jon_13_all_closest", None)
def _(t):
    p = pts(t)
    return P.nearest(p.withColumn("x", F.col("x") + 0.3), p, 1, 1.0).select("q", "p")


@query("jon_07_box_overlap", """WITH b AS (SELECT node AS id, cx - 0.6 AS min_x, cx + 0.6 AS max_x, cy - 0.6 AS min_y, cy + 0.6 AS max_y, cz - 0.6 AS min_z, cz + 0.6 AS max_z FROM dag_nodes)
SELECT a.id AS a, b.id AS b FROM b a, b b WHERE a.id < b.id AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y AND a.min_z <= b.max_z AND b.min_z <= a.max_z""")
def _(t):
    boxes = t("dag_nodes").select(F.col("node").alias("id"), *(e.alias(f"{m}_{c}") for c in "xyz" for m, e in (("min", F.col(f"c{c}") - 0.6), ("max", F.col(f"c{c}") + 0.6))))
    return P.overlaps(boxes, 2.0)


@query("jon_08_route_points", "SELECT pid, CAST(CASE WHEN x < 25 THEN CASE WHEN y < 5 THEN 3 ELSE 4 END ELSE CASE WHEN z < 4 THEN 5 ELSE 6 END END AS BIGINT) AS cell FROM splats")
def _(t):
    s = t("splats")
    rows = [(0, 1, 0, 25.0, 1, 2), (1, 2, 1, 5.0, 3, 4), (2, 2, 2, 4.0, 5, 6)]
    cells = s.sparkSession.createDataFrame(rows, "cell long, level int, axis int, mid double, child0 long, child1 long")
    return P.route(cells, s.select("pid", "x", "y", "z")).select("pid", "cell")


@query("udx_11_attributes", "SELECT vid, r + g + b AS brightness FROM mesh_vertices")
def _(t):
    return t("mesh_vertices").withColumn("brightness", F.col("r") + F.col("g") + F.col("b")).select("vid", "brightness")
