"""Meshes: gathering corners, cleaning, adjacency, measures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import mesh as M
from . import TRI, query

LOW, HIGH = (3.0, 2.0, 0.0), (12.0, 30.0, 4.5)
_in = lambda k: " AND ".join(f"{c}{k} >= {a} AND {c}{k} < {b}" for c, a, b in zip("xyz", LOW, HIGH, strict=True))
E_SQL = "e AS (SELECT fid, v0 AS a, v1 AS b FROM mesh_faces UNION ALL SELECT fid, v1, v2 FROM mesh_faces UNION ALL SELECT fid, v2, v0 FROM mesh_faces)"
U_SQL = E_SQL + ", u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(fid) AS f, max(fid) AS g, count(*) AS n FROM e GROUP BY 1, 2)"
tri = lambda t: M.gather(t("mesh_faces"), t("mesh_vertices"))
COORDS = [f"{c}{k}" for k in range(3) for c in "xyz"]


@query("jon_01_gather", f"WITH {TRI} SELECT * FROM tri")
def _(t):
    return tri(t)


@query("src_04_face_scan", f"WITH {TRI} SELECT fid, x0, y0, z0, x2, y2, z2 FROM tri WHERE NOT (x0 = x1 AND y0 = y1 AND z0 = z1)")
def _(t):
    return M.drop_degenerate(tri(t)).select("fid", "x0", "y0", "z0", "x2", "y2", "z2")


@query("prj_01_soup_to_mesh", "SELECT fid, 0 AS k, v0 AS vid FROM mesh_faces UNION ALL SELECT fid, 1, v1 FROM mesh_faces UNION ALL SELECT fid, 2, v2 FROM mesh_faces")
def _(t):
    return M.corners(t("mesh_faces"))


@query("prj_04_tagged_triangles", f"WITH {TRI} SELECT fid, x0, y1, z2, 7 AS node FROM tri")
def _(t):
    return tri(t).select("fid", "x0", "y1", "z2", F.lit(7).alias("node"))


@query("flt_01_degenerate", f"WITH {TRI} SELECT fid FROM tri WHERE NOT ((x0 = x1 AND y0 = y1 AND z0 = z1) OR (x0 = x2 AND y0 = y2 AND z0 = z2) OR (x1 = x2 AND y1 = y2 AND z1 = z2))")
def _(t):
    return M.drop_degenerate(tri(t)).select("fid")


@query("flt_06_border_vertices", f"WITH {TRI}, o AS (SELECT * FROM tri WHERE NOT ({_in(0)} AND {_in(1)} AND {_in(2)})) SELECT v0 AS vid FROM o UNION SELECT v1 FROM o UNION SELECT v2 FROM o")
def _(t):
    return M.border_vertices(tri(t), LOW, HIGH)


@query("flt_07_lock", f"WITH {TRI} SELECT fid, NOT ({_in(0)} AND {_in(1)} AND {_in(2)}) AS locked FROM tri")
def _(t):
    return M.lock(tri(t), LOW, HIGH)


@query("flt_08_lock_mask", "SELECT fid FROM mesh_faces WHERE v0 IN (SELECT vid FROM mesh_vertices WHERE r > 200)")
def _(t):
    mask = t("mesh_vertices").where("r > 200").select(F.col("vid").alias("v0"))
    return t("mesh_faces").join(mask, "v0", "left_semi").select("fid")


@query("jon_10_edge_adjacency", f"WITH {U_SQL} SELECT f, g, a, b FROM u WHERE n = 2")
def _(t):
    return M.adjacency(t("mesh_faces"))


@query("agg_06_merge_vertices", "SELECT pid AS vid, min(pid) OVER (PARTITION BY x, y, z) AS \"to\" FROM splats")
def _(t):
    return M.merge_vertices(t("splats").withColumnRenamed("pid", "vid"))


@query("agg_07_vertex_normals", f"""WITH {TRI}, n AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM tri),
c AS (SELECT v0 AS vid, nx, ny, nz FROM n UNION ALL SELECT v1, nx, ny, nz FROM n UNION ALL SELECT v2, nx, ny, nz FROM n) SELECT vid, round(sum(nx), 4) + 0.0 AS nx, round(sum(ny), 4) + 0.0 AS ny, round(sum(nz), 4) + 0.0 AS nz FROM c GROUP BY vid""")
def _(t):
    n = M.vertex_normals(tri(t))
    return n.select("vid", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")))


@query("agg_08_boundary_vertices", f"WITH {E_SQL}, s AS (SELECT a AS vid, b AS s FROM e UNION ALL SELECT b, -a FROM e) SELECT vid FROM s GROUP BY vid HAVING sum(s) <> 0")
def _(t):
    return M.boundary_vertices(t("mesh_faces"))


@query("agg_16_edge_error", f"WITH {TRI}, e AS (SELECT (x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1) + (z0 - z1) * (z0 - z1) AS e2 FROM tri UNION ALL SELECT (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2) FROM tri UNION ALL SELECT (x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0) + (z2 - z0) * (z2 - z0) FROM tri) SELECT round(sqrt(avg(e2)), 4) AS error FROM e")
def _(t):
    return M.edge_error(tri(t)).select(F.round("error", 4).alias("error"))


@query("vc_boundary_edges", f"WITH {U_SQL} SELECT a, b FROM u WHERE n = 1")
def _(t):
    return M.boundary_edges(t("mesh_faces"))


@query("vc_measures", f"WITH {TRI} SELECT round(sum(sqrt(power((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + power((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + power((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2), 3) AS area FROM tri")
def _(t):
    return M.measures(tri(t)).select(F.round("area", 3).alias("area"))


@query("vc_euler_number", f"WITH {U_SQL} SELECT (SELECT count(*) FROM mesh_vertices) - (SELECT count(*) FROM u) + (SELECT count(*) FROM mesh_faces) AS euler")
def _(t):
    u = M.undirected(M.edges(t("mesh_faces"))).select("a", "b").distinct().agg(F.count("*").alias("e"))
    v, f = (t(n).agg(F.count("*").alias(c)) for n, c in (("mesh_vertices", "v"), ("mesh_faces", "f")))
    return v.crossJoin(u).crossJoin(f).select((F.col("v") - F.col("e") + F.col("f")).alias("euler"))  # one row each


@query("vc_valence", f"WITH {U_SQL} SELECT vid, count(*) AS valence FROM (SELECT a AS vid FROM u UNION ALL SELECT b FROM u) GROUP BY vid")
def _(t):
    u = M.undirected(M.edges(t("mesh_faces"))).select("a", "b").distinct()
    return u.select(F.explode(F.array("a", "b")).alias("vid")).groupBy("vid").agg(F.count("*").alias("valence"))


@query("vc_isolated_vertices", "SELECT vid FROM mesh_vertices WHERE vid NOT IN (SELECT v0 FROM mesh_faces UNION SELECT v1 FROM mesh_faces UNION SELECT v2 FROM mesh_faces)")
def _(t):
    return t("mesh_vertices").join(M.corners(t("mesh_faces")).select("vid"), "vid", "left_anti").select("vid")


@query("vc_barycentres", f"WITH {TRI} SELECT fid, round((x0 + x1 + x2) / 3, 4) AS bx, round((y0 + y1 + y2) / 3, 4) AS byy, round((z0 + z1 + z2) / 3, 4) AS bz FROM tri")
def _(t):
    mean = lambda a: F.round((F.col(a + "0") + F.col(a + "1") + F.col(a + "2")) / 3, 4)
    return tri(t).select("fid", mean("x").alias("bx"), mean("y").alias("byy"), mean("z").alias("bz"))


@query("set_06_cluster", f"WITH {TRI}, k AS (SELECT list_sort([{', '.join(' || chr(58) || '.join(f'CAST(CAST(floor({c}{k} / 4.0) AS BIGINT) AS VARCHAR)' for c in 'xyz') for k in range(3))}]) AS c FROM tri) SELECT DISTINCT c[1] AS c0, c[2] AS c1, c[3] AS c2 FROM k WHERE c[1] <> c[2] AND c[2] <> c[3]")
def _(t):
    return M.cluster(tri(t), 4.0)


@query("msh_24_candidate_edges", f"WITH {TRI}, ok AS (SELECT fid FROM tri WHERE {_in(0)} AND {_in(1)} AND {_in(2)}), {E_SQL} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE fid IN (SELECT fid FROM ok)")
def _(t):
    free = M.lock(tri(t), LOW, HIGH).where("NOT locked").select("fid")
    return M.undirected(M.edges(t("mesh_faces")).join(free, "fid", "left_semi")).select("a", "b").distinct()


@query("msh_03_route_triangles", f"WITH {TRI} SELECT fid, CASE WHEN (CASE WHEN x0 >= 9 THEN 1 ELSE 0 END) + (CASE WHEN x1 >= 9 THEN 1 ELSE 0 END) + (CASE WHEN x2 >= 9 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS child FROM tri")
def _(t):
    right = sum((F.when(F.col(f"x{k}") >= 9, 1).otherwise(0) for k in range(3)), F.lit(0))
    return tri(t).select("fid", F.when(right >= 3 - right, 1).otherwise(0).alias("child"))


@query("agg_22_totals", "SELECT CAST(sum(nvert) AS BIGINT) AS nvert, CAST(sum(nface) AS BIGINT) AS nface FROM dag_nodes")
def _(t):
    return t("dag_nodes").agg(F.sum("nvert").alias("nvert"), F.sum("nface").alias("nface"))


@query("prj_15_rotated_box", "SELECT round(min(x * 0.6 + y * 0.8), 4) AS low, round(max(x * 0.6 + y * 0.8), 4) AS high FROM (SELECT x, y FROM (SELECT min(x) AS x FROM mesh_vertices UNION ALL SELECT max(x) FROM mesh_vertices), (SELECT min(y) AS y FROM mesh_vertices UNION ALL SELECT max(y) FROM mesh_vertices))")
def _(t):
    b = t("mesh_vertices").agg(F.array(F.min("x"), F.max("x")).alias("xs"), F.array(F.min("y"), F.max("y")).alias("ys"))
    p = b.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    v = G.dot((F.col("x"), F.col("y"), F.lit(0.0)), (F.lit(0.6), F.lit(0.8), F.lit(0.0)))
    return p.agg(F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"))
