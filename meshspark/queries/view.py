"""View-dependent predicates and metrics, for one camera: 90 degrees wide, 800 pixels, looking down from (10, 15, 30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import view as V
from ..plans import dag as D
from . import query, rowwise

c = F.col
NEAR, FAR = 0.1, 100.0
PROJECTION = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, -(FAR + NEAR) / (FAR - NEAR), -1, 0, 0, -2 * FAR * NEAR / (FAR - NEAR), 0]
MODEL = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, -10, -15, -30, 1]
CAMERA = V.Frustum.of(PROJECTION, MODEL, 800)
VIEW = (10.0, 15.0, 30.0)
center = lambda: (c("cx"), c("cy"), c("cz"))
cone = lambda: (c("n0"), c("n1"), c("n2"))

# The same camera by hand, for SQL: eye, side planes and pixel size.
H = "0.7071067811865476::DOUBLE"
DIST = "sqrt((cx - 10) * (cx - 10) + (cy - 15) * (cy - 15) + (cz - 30) * (cz - 30))"
INSIDE = f"least(45 - cy - cz, 40 - cx - cz, 15 + cy - cz, 20 + cx - cz) * {H}"
ERROR = f"SELECT node, error / greatest(0.0025::DOUBLE * greatest({DIST} - radius, 0.1), 1e-6) AS e, {INSIDE} + radius AS d, radius, nvert, size_bytes FROM dag_nodes"
SCREEN = f"SELECT node, nvert, size_bytes, CASE WHEN d < 0 THEN e * power(least(radius / (radius - d), 1.0), 2) * 0.001 ELSE e END AS e FROM ({ERROR})"


def _looks(sign: int, scale: str) -> str:
    """SQL of the packed cone tests: d is the moved centre seen from the eye, n the normal by its width."""
    d = [f"(c{a} + ({sign}) * n{i} / 32766.0::DOUBLE * tight_radius - {v})" for i, (a, v) in enumerate(zip("xyz", VIEW, strict=True))]
    dn = " + ".join(f"{x} * (n{i} / 32766.0::DOUBLE)" for i, x in enumerate(d))
    f, dd = f"({-sign}) * ({dn}) * (n3 / {scale}::DOUBLE)", " + ".join(f"{x} * {x}" for x in d)
    return f"NOT ({f} < 0.001 OR ({f}) * ({f}) < {dd})"


rowwise(
    "flt_12_backface", "cones", "node",
    lambda: {"back": V.backface(cone(), c("n3"), center(), c("tight_radius"), VIEW), "literal": V.backface(cone(), c("n3"), center(), c("tight_radius"), VIEW, V.LITERAL_WIDTH_SCALE)},
    {"back": _looks(-1, "3276.0"), "literal": _looks(-1, "32766.0")},
)
rowwise("flt_13_frontface", "cones", "node", lambda: {"front": V.frontface(cone(), c("n3"), center(), c("tight_radius"), VIEW)}, {"front": _looks(1, "3276.0")})


@query("flt_14_anchored_cone", f"""WITH a AS (SELECT node, n0 / 32766.0::DOUBLE * n3 / 3276 AS nx, n1 / 32766.0::DOUBLE * n3 / 3276 AS ny, n2 / 32766.0::DOUBLE * n3 / 3276 AS nz, cx - 10 AS dx, cy - 15 AS dy, cz + tight_radius - 30 AS fz, cz - tight_radius - 30 AS bz FROM cones),
f AS (SELECT node, -(dx * nx + dy * ny + fz * nz) AS f, dx * dx + dy * dy + fz * fz AS ff, dx * nx + dy * ny + bz * nz AS b, dx * dx + dy * dy + bz * bz AS bb FROM a)
SELECT node, NOT (f < 0.001 OR f * f < ff) AS front, NOT (b < 0.001 OR b * b < bb) AS back FROM f""")
def _(t):
    n = tuple(x / V.NORMAL_SCALE * c("n3") / V.WIDTH_SCALE for x in cone())
    up, down = ((c("cx"), c("cy"), c("cz") + s * c("tight_radius")) for s in (1, -1))
    return t("cones").select("node", V.anchored_frontface(n, up, VIEW).alias("front"), V.anchored_backface(n, down, VIEW).alias("back"))


@query("flt_21_visible", f"SELECT node FROM dag_nodes WHERE NOT ({INSIDE} + tight_radius < 0)")
def _(t):
    return t("dag_nodes").where(~CAMERA.outside(center(), c("tight_radius"))).select("node")


@query("fn_m08_screen_error", f"SELECT node, round(e, 4) AS v FROM ({SCREEN})")
def _(t):
    return t("dag_nodes").select("node", F.round(CAMERA.error(center(), c("radius"), c("error")), 4).alias("v"))


@query("dag_10_view_metric", f"SELECT node, round(e, 3) AS e, e >= 2 AS expand FROM ({SCREEN})")
def _(t):
    e = CAMERA.error(center(), c("radius"), c("error"))
    return t("dag_nodes").select("node", F.round(e, 3).alias("e"), (e >= 2).alias("expand"))


@query("fn_m14_distance_error", f"SELECT node, round(CASE WHEN {INSIDE} + radius < 0 THEN error / (0.0025::DOUBLE * greatest({DIST} - radius, 0.1)) / 1000 ELSE error / (0.0025::DOUBLE * greatest({DIST} - radius, 0.1)) END, 4) AS v FROM dag_nodes")
def _(t):
    return t("dag_nodes").select("node", F.round(CAMERA.simple_error(center(), c("radius"), c("error")), 4).alias("v"))


@query("fn_m09_resolution", "SELECT node, round(CASE WHEN -cz - tight_radius <= 0 THEN -1.0::DOUBLE ELSE 0.0025::DOUBLE * (-cz - tight_radius) END, 6) AS at_center, round(0.0025::DOUBLE * (30 - cz), 6) AS at_distance FROM dag_nodes")
def _(t):
    pixel = CAMERA.pixel(center(), c("tight_radius"))
    return t("dag_nodes").select("node", F.round(pixel, 6).alias("at_center"), F.round(CAMERA.resolution * CAMERA.along(center()), 6).alias("at_distance"))


@query("fn_m11_frustum", f"SELECT * FROM (VALUES (0, 0.0, -1.0, -1.0, 45.0), (1, -1.0, 0.0, -1.0, 40.0), (2, 0.0, 1.0, -1.0, 15.0), (3, 1.0, 0.0, -1.0, 20.0)) p(plane, a, b, k, d)".replace("SELECT *", f"SELECT plane, round(a * {H}, 6) + 0.0 AS a, round(b * {H}, 6) + 0.0 AS b, round(k * {H}, 6) AS k, round(d * {H}, 6) AS d"))
def _(t):
    rows = [(i, *map(float, p)) for i, p in enumerate(CAMERA.planes[:4])]
    planes = t("region").sparkSession.createDataFrame(rows, "plane int, a double, b double, k double, d double")
    return planes.select("plane", *((F.round(x, 6) + 0.0).alias(x) for x in ("a", "b", "k", "d")))


@query("fn_m12_model_view", "SELECT r_regionkey, 10.0::DOUBLE AS x, 15.0::DOUBLE AS y, 30.0::DOUBLE AS z, -1.0::DOUBLE AS dz, 1.0::DOUBLE AS scale FROM region")
def _(t):
    eye, direction, scale = V.Frustum.looking(MODEL)
    return t("region").select("r_regionkey", *(F.lit(v).alias(n) for n, v in zip("xyz", eye, strict=True)), F.lit(direction[2]).alias("dz"), F.lit(scale).alias("scale"))


@query("dag_13_near_far", "SELECT round(min(30 - cz - tight_radius), 4) AS near, round(max(30 - cz + tight_radius), 4) AS far FROM dag_nodes")
def _(t):
    near, far = CAMERA.near_far(center(), c("tight_radius"))
    return t("dag_nodes").agg(F.round(near, 4).alias("near"), F.round(far, 4).alias("far"))


@query("agg_42_near_far", f"SELECT node % 10 AS part, round(min(30 - cz - radius), 4) AS near, round(max(30 - cz + radius), 4) AS far FROM dag_nodes WHERE NOT ({INSIDE} + radius < 0) GROUP BY 1")
def _(t):
    near, far = CAMERA.near_far(center(), c("radius"))
    seen = t("dag_nodes").where(~CAMERA.outside(center(), c("radius")))
    return seen.groupBy((c("node") % 10).alias("part")).agg(F.round(near, 4).alias("near"), F.round(far, 4).alias("far"))


@query("dag_05_stored_error", "SELECT node, error, row_number() OVER (ORDER BY error DESC, node) AS place FROM dag_nodes")
def _(t):
    from ..operators.prefix import running

    return running(t("dag_nodes").select("node", "error"), ["error", "node"], number="place", descending=True)


# A node is blocked if it, or a node on a way to it, is below the target or not there (every 11th isn't).
_STOP = "(e < 0.9 OR node % 11 = 10)"


@query("dag_04_blocked", f"""WITH RECURSIVE s AS ({SCREEN}), b(node) AS (SELECT node FROM s WHERE {_STOP} UNION SELECT p.dst FROM b JOIN dag_patches p ON p.src = b.node WHERE p.dst < (SELECT count(*) FROM dag_nodes))
SELECT node, node IN (SELECT node FROM b) AS blocked FROM dag_nodes""")
def _(t):
    e = CAMERA.error(center(), c("radius"), c("error"))
    nodes = t("dag_nodes")
    start = nodes.where((e < 0.9) | (c("node") % 11 == 10)).select("node")
    blocked = D.reached(start, t("dag_patches").join(nodes.select(c("node").alias("dst")), "dst", "left_semi"))
    return nodes.select("node").join(blocked.withColumn("blocked", F.lit(True)), "node", "left").select("node", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query("dag_09_resident_cut", f"""WITH RECURSIVE s AS ({SCREEN}), b(node) AS (SELECT node FROM s WHERE {_STOP} UNION SELECT p.dst FROM b JOIN dag_patches p ON p.src = b.node),
f AS (SELECT node, e, sum(size_bytes) OVER (ORDER BY e DESC, node) AS held FROM s WHERE node NOT IN (SELECT node FROM b)) SELECT node FROM f WHERE held <= 300000""")
def _(t):
    from ..plans import cuts

    e = CAMERA.error(center(), c("radius"), c("error"))
    nodes = t("dag_nodes").withColumn("e", e)
    blocked = D.reached(nodes.where((c("e") < 0.9) | (c("node") % 11 == 10)).select("node"), t("dag_patches"))
    free = nodes.join(blocked, "node", "left_anti").drop("error").withColumnRenamed("e", "error")
    return cuts.by_budget(free, "size_bytes", 300_000)


@query("dag_17_web_cut", f"""WITH RECURSIVE s AS ({SCREEN}), k AS (SELECT * FROM s WHERE e >= 0.8),
r(node) AS (SELECT node FROM k WHERE node = 0 UNION SELECT p.dst FROM r JOIN dag_patches p ON p.src = r.node JOIN k ON k.node = p.dst),
f AS (SELECT node, e, sum(nvert * 0.8::DOUBLE) OVER (ORDER BY e DESC, node) - nvert * 0.8::DOUBLE AS drawn FROM k WHERE node IN (SELECT node FROM r)) SELECT node, e >= 1 AND drawn <= 20000 AS selected FROM f""")
def _(t):
    """Reached over nodes of 0.8 of the target error at least; selected by error while the budget isn't passed."""
    from ..operators.prefix import running

    nodes = t("dag_nodes").withColumn("e", CAMERA.error(center(), c("radius"), c("error"))).where("e >= 0.8")
    inner = t("dag_patches").join(nodes.select(c("node").alias("dst")), "dst", "left_semi")
    reached = D.reached(nodes.where("node = 0").select("node"), inner)
    w = nodes.join(reached, "node", "left_semi").select("node", "e", (c("nvert") * 0.8).alias("w"))
    return running(w, ["e", "node"], {"drawn": "w"}, descending=True).select("node", ((c("e") >= 1) & (c("drawn") - c("w") <= 20_000)).alias("selected"))


@query("dag_02_enqueued_once", "WITH RECURSIVE r(node) AS (SELECT node FROM dag_nodes WHERE node = 0 UNION SELECT p.dst FROM r JOIN dag_patches p ON p.src = r.node) SELECT node FROM r")
def _(t):
    return D.reached(t("dag_nodes").where("node = 0").select("node"), t("dag_patches"))


@query("dag_19_children_of_cut", "SELECT DISTINCT p.dst AS node FROM dag_patches p JOIN dag_nodes n ON n.node = p.src WHERE n.error >= 2.5 AND p.dst < (SELECT count(*) FROM dag_nodes) AND p.dst NOT IN (SELECT node FROM dag_nodes WHERE error >= 2.5)")
def _(t):
    cut = D.by_error(t("dag_nodes"), 2.5)
    below = t("dag_patches").join(cut.withColumnRenamed("node", "src"), "src", "left_semi").select(c("dst").alias("node")).distinct()
    return below.join(t("dag_nodes").select("node"), "node", "left_semi").join(cut, "node", "left_anti")


@query("srt_10_request_candidates", f"WITH s AS ({SCREEN}) SELECT node, round(e, 4) AS e FROM s WHERE node % 11 = 10 ORDER BY s.e DESC, node LIMIT 3")
def _(t):
    e = CAMERA.error(center(), c("radius"), c("error"))
    return t("dag_nodes").where("node % 11 = 10").select("node", e.alias("e")).orderBy(F.desc("e"), "node").limit(3).select("node", F.round("e", 4).alias("e"))


@query("jon_14_ray_hits", """WITH k AS (SELECT node, cx * 0.6 + cy * 0.8 AS along, cx * cx + cy * cy + cz * cz AS oo, 9 * tight_radius * tight_radius AS r2 FROM dag_nodes WHERE node NOT IN (SELECT src FROM dag_patches WHERE dst < (SELECT count(*) FROM dag_nodes))),
h AS (SELECT node, CASE WHEN oo <= r2 THEN 0 WHEN along > 0 AND oo - along * along <= r2 THEN along - sqrt(greatest(r2 - (oo - along * along), 0)) END AS d FROM k)
SELECT node, round(d, 4) AS d FROM h WHERE d IS NOT NULL ORDER BY h.d, node LIMIT 1""")
def _(t):
    """The nearest sphere of a leaf on a ray from the origin; leaves are nodes without children."""
    nodes = t("dag_nodes")
    inner = t("dag_patches").join(nodes.select(c("node").alias("dst")), "dst", "left_semi").select(c("src").alias("node"))
    hit = G.ray_sphere(center(), c("tight_radius") * 3, (0, 0, 0), (0.6, 0.8, 0.0))
    hits = nodes.join(inner, "node", "left_anti").select("node", hit.alias("d")).where("d IS NOT NULL")
    return hits.orderBy("d", "node").limit(1).select("node", F.round("d", 4).alias("d"))
