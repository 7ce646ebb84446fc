"""Normals and outliers of point clouds, clipping by planes and boxes, curvature, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clip as C
from ..operators import cloud as P
from ..operators import curvature as V
from ..operators import mesh as M
from ..operators.points import nearest
from . import TRI, query

c = F.col
START, LOW, HIGH = 2.0, (2.5, 1.5, 0.7), (14.3, 60.25, 3.1)
points = lambda t: t("mesh_vertices").select(c("vid").alias("id"), *"xyz")

# The k nearest of every vertex, itself included.
NEAR = """near AS (SELECT q, p, d2, px - qx AS x, py - qy AS y, pz - qz AS z FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS k FROM
(SELECT a.vid AS q, b.vid AS p, a.x AS qx, a.y AS qy, a.z AS qz, b.x AS px, b.y AS py, b.z AS pz, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM mesh_vertices a, mesh_vertices b) w) v WHERE k <= {k})"""

VARIATION = f"""WITH {NEAR.format(k=10)},
s AS (SELECT q, avg(x*x) - avg(x)*avg(x) AS xx, avg(x*y) - avg(x)*avg(y) AS xy, avg(x*z) - avg(x)*avg(z) AS xz, avg(y*y) - avg(y)*avg(y) AS yy, avg(y*z) - avg(y)*avg(z) AS yz, avg(z*z) - avg(z)*avg(z) AS zz FROM near GROUP BY q),
m AS (SELECT *, (xx + yy + zz) / 3 AS m FROM s),
p AS (SELECT *, sqrt(((xx-m)*(xx-m) + (yy-m)*(yy-m) + (zz-m)*(zz-m) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM m),
d AS (SELECT *, ((xx-m)*((yy-m)*(zz-m) - yz*yz) - xy*(xy*(zz-m) - yz*xz) + xz*(xy*yz - (yy-m)*xz)) / (2*p*p*p) AS d FROM p)
SELECT q AS id, round((m + 2*p*cos(acos(least(1, greatest(-1, d)))/3 + 2*pi()/3)) / (3*m), 4) + 0.0 AS variation FROM d"""


@query("vpn_01_surface_variation", VARIATION)
def _(t):
    return P.normals(points(t), 10, START).select("id", (F.round("variation", 4) + F.lit(0.0)).alias("variation"))


@query("vpn_03_oriented_normals", None)
def _(t):
    """Normals of 10 neighbours, made to agree over 8."""
    p = points(t)
    near = nearest(p, p, 9, START)  # a point is its own first neighbour
    return P.coherent(P.normals(p, 10, START), near)


@query("vpn_03_viewed_normals", None)
def _(t):
    """The same, turned towards a viewpoint."""
    p = points(t)
    return P.towards(p, P.normals(p, 10, START), (10.0, 10.0, 1000.0))


SCORES = f"""WITH {NEAR.format(k=8)}, s AS (SELECT q, sqrt(avg(d2)) AS sigma FROM near GROUP BY q),
e AS (SELECT n.q AS id, max(o.sigma) / avg(s.sigma) - 1 AS e FROM near n JOIN s ON s.q = n.p JOIN s o ON o.q = n.q GROUP BY n.q),
v AS (SELECT id, e / ((SELECT sqrt(avg(e * e)) FROM e) * sqrt(2)) AS v FROM e),
r AS (SELECT id, greatest(0.0, 1 - 1 / (1 + 0.278393*v + 0.230389*v*v + 0.000972*v*v*v + 0.078108*v*v*v*v)) AS score FROM v)"""


@query("vpo_01_outlier_scores", f"{SCORES} SELECT id, round(score, 6) + 0.0 AS score FROM r")
def _(t):
    return P.outlier_scores(points(t), 8, START).select("id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("vpo_02_outliers", f"{SCORES} SELECT id FROM r WHERE score > 0.31")
def _(t):
    return P.outlier_scores(points(t), 8, START).where("score > 0.31").select("id")


@query("vpo_03_without_outliers", f"{SCORES} SELECT vid AS id, x, y, z FROM mesh_vertices JOIN r ON id = vid WHERE score <= 0.31")
def _(t):
    return P.without_outliers(points(t), 8, 0.31, START)


@query("vcl_04_outcodes", f"""SELECT vid, {' + '.join(f'CASE WHEN {a} < {lo} THEN {1 << 2 * i} WHEN {a} > {hi} THEN {2 << 2 * i} ELSE 0 END' for i, (a, lo, hi) in enumerate(zip('xyz', LOW, HIGH, strict=True)))} AS code FROM mesh_vertices""")
def _(t):
    return t("mesh_vertices").select("vid", C.outcode(G.vec(), LOW, HIGH).alias("code"))


def areas(faces, vertices):
    """Pieces and area of every face's part."""
    p = [G.vec(suffix=str(k)) for k in range(3)]
    area = G.norm(G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0]))) / 2
    return M.gather(faces, vertices).groupBy("of").agg(F.count("*").alias("pieces"), (F.round(F.sum(area), 6) + F.lit(0.0)).alias("area"))


# With one corner on its own side of a plane, its triangle has d0 * d0 / ((d0 - d1) * (d0 - d2)) of the area.
HALF = f"""WITH {TRI}, d AS (SELECT *, 0.6*x0 - 0.3*y0 + 1.7*z0 - 2.123 AS d0, 0.6*x1 - 0.3*y1 + 1.7*z1 - 2.123 AS d1, 0.6*x2 - 0.3*y2 + 1.7*z2 - 2.123 AS d2,
(y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS nz FROM tri),
s AS (SELECT fid, sqrt(nx*nx + ny*ny + nz*nz) / 2 AS area, CASE WHEN d0 < 0 THEN 1 ELSE 0 END + CASE WHEN d1 < 0 THEN 1 ELSE 0 END + CASE WHEN d2 < 0 THEN 1 ELSE 0 END AS n,
CASE WHEN (d0 < 0) <> (d1 < 0) AND (d0 < 0) <> (d2 < 0) THEN d0*d0/((d0-d1)*(d0-d2)) WHEN (d1 < 0) <> (d0 < 0) AND (d1 < 0) <> (d2 < 0) THEN d1*d1/((d1-d0)*(d1-d2)) ELSE d2*d2/((d2-d0)*(d2-d1)) END AS part
FROM d WHERE d0 < 0 OR d1 < 0 OR d2 < 0)
SELECT fid AS "of", CASE n WHEN 2 THEN 2 ELSE 1 END AS pieces, round(area * CASE n WHEN 3 THEN 1 WHEN 1 THEN part ELSE 1 - part END, 6) + 0.0 AS area FROM s"""


@query("vcl_07_half_space_areas", HALF)
def _(t):
    return areas(*C.by_planes(t("mesh_faces"), t("mesh_vertices"), [((0.6, -0.3, 1.7), 2.123)]))


@query("vcl_02_box_clipped", None)
def _(t):
    """Area of every face inside a box."""
    return areas(*C.box(t("mesh_faces"), t("mesh_vertices"), LOW, HIGH)).select("of", "area")


@query("vcl_06_carried_colours", None)
def _(t):
    """Places and interpolated colours of the vertices that the pieces use."""
    faces, vertices = C.box(t("mesh_faces"), t("mesh_vertices"), LOW, HIGH, ("r", "g", "b"))
    used = M.corners(faces).select("vid").distinct()
    return vertices.join(used, "vid", "left_semi").select(*(F.round(k, 6).alias(k) for k in (*"xyz", *"rgb")))


CURVATURES = f"""WITH {TRI}, c AS (SELECT *, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS ux, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS uy, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS uz FROM tri),
n AS (SELECT *, ux / sqrt(ux*ux + uy*uy + uz*uz) AS nx, uy / sqrt(ux*ux + uy*uy + uz*uz) AS ny, uz / sqrt(ux*ux + uy*uy + uz*uz) AS nz FROM c),
h AS (SELECT v0 AS a, v1 AS b, nx, ny, nz FROM n UNION ALL SELECT v1, v2, nx, ny, nz FROM n UNION ALL SELECT v2, v0, nx, ny, nz FROM n),
j AS (SELECT p.a, p.b, p.ny*q.nz - p.nz*q.ny AS cx, p.nz*q.nx - p.nx*q.nz AS cy, p.nx*q.ny - p.ny*q.nx AS cz, w.x - v.x AS dx, w.y - v.y AS dy, w.z - v.z AS dz
  FROM h p JOIN h q ON q.a = p.b AND q.b = p.a JOIN mesh_vertices v ON v.vid = p.a JOIN mesh_vertices w ON w.vid = p.b),
l AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM j),
t AS (SELECT a AS vid, asin(least(1, greatest(-1, (cx*dx + cy*dy + cz*dz) / len))) / len AS f, dx, dy, dz FROM l),
s AS (SELECT vid, sum(f*dx*dx) AS xx, sum(f*dx*dy) AS xy, sum(f*dx*dz) AS xz, sum(f*dy*dy) AS yy, sum(f*dy*dz) AS yz, sum(f*dz*dz) AS zz FROM t GROUP BY vid),
m AS (SELECT *, (xx + yy + zz) / 3 AS m FROM s),
p AS (SELECT *, sqrt(((xx-m)*(xx-m) + (yy-m)*(yy-m) + (zz-m)*(zz-m) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM m),
d AS (SELECT *, acos(least(1, greatest(-1, ((xx-m)*((yy-m)*(zz-m) - yz*yz) - xy*(xy*(zz-m) - yz*xz) + xz*(xy*yz - (yy-m)*xz)) / (2*p*p*p)))) / 3 AS d FROM p)
SELECT vid, round(m + 2*p*cos(d), 4) + 0.0 AS k1, round(m + 2*p*cos(d - 2*pi()/3), 4) + 0.0 AS k2 FROM d"""


@query("vu_06_principal_curvatures", CURVATURES)
def _(t):
    k = V.principal(t("mesh_faces"), t("mesh_vertices"))
    return k.select("vid", *((F.round(v, 4) + F.lit(0.0)).alias(v) for v in ("k1", "k2")))


@query("vu_06_principal_directions", None)
def _(t):
    return V.principal(t("mesh_faces"), t("mesh_vertices")).select("vid", "d1", "d2")
