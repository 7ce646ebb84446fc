"""Nodes: descriptors, checks, normals over nodes, textured corners, and searches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import nodes as N
from ..operators import points as P
from ..operators.prefix import running
from ..plans import dag as D
from ..tables import apart
from . import query

c = F.col
NORMALS = """n AS (SELECT node, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS g,
greatest(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2) + power(z1 - z0, 2)), sqrt(power(x2 - x0, 2) + power(y2 - y0, 2) + power(z2 - z0, 2))) AS big, fid FROM node_faces),
l AS (SELECT *, sqrt(a * a + b * b + g * g) AS l FROM n), u AS (SELECT node, fid, a / l AS nx, b / l AS ny, g / l AS nz, l / 2 AS area FROM l WHERE l * 100000 > least(big, big + l))"""


def _cone(weight: str) -> str:
    return f"""WITH {NORMALS}, m0 AS (SELECT node, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz, sum({weight}) AS total FROM u GROUP BY node),
m AS (SELECT node, total, mx / sqrt(mx * mx + my * my + mz * mz) AS mx, my / sqrt(mx * mx + my * my + mz * mz) AS my, mz / sqrt(mx * mx + my * my + mz * mz) AS mz FROM m0),
r AS (SELECT u.node, CAST(floor(49 * acos(greatest(-1.0, least(1.0, round(nx * mx + ny * my + nz * mz, 12)))) / pi()) AS INT) AS ring, {weight} AS w FROM u JOIN m ON m.node = u.node),
h AS (SELECT node, ring, sum(sum(w)) OVER (PARTITION BY node ORDER BY ring) AS held FROM r GROUP BY node, ring),
k AS (SELECT h.node, min(ring) AS ring FROM h JOIN m ON m.node = h.node WHERE held >= 0.95 * total GROUP BY h.node),
a AS (SELECT m.*, pi() * (ring + 1) / 50 AS alpha FROM m JOIN k ON k.node = m.node), s AS (SELECT node, {', '.join(f'CASE WHEN alpha >= pi() / 2 - 0.1 THEN 0 ELSE m{x} / cos(pi() / 2 - alpha) END AS a{x}' for x in 'xyz')} FROM a)"""


ROUND = ", ".join(f"round(a{x}, 5) + 0.0 AS a{x}" for x in "xyz")
rounded = lambda: [(F.round(f"a{x}", 5) + 0.0).alias(f"a{x}") for x in "xyz"]


@query("agg_12_normal_cone", _cone("1.0::DOUBLE") + f" SELECT node, {ROUND} FROM s")
def _(t):
    return N.cones(N.sturdy(t("node_faces"))).select("node", *rounded())


@query("agg_13_area_cone", _cone("area") + f" SELECT node, {ROUND} FROM s")
def _(t):
    return N.cones(N.sturdy(t("node_faces")), weight=c("area")).select("node", *rounded())


@query("agg_15_mesh_cone", _cone("1.0::DOUBLE") + """, q AS (SELECT node, ax, ay, az, sqrt(ax * ax + ay * ay + az * az) AS l FROM s)
SELECT node, """ + ", ".join(f"CAST(trunc(greatest(least(CASE WHEN l > 0.001 THEN round(a{x} / l, 9) ELSE a{x} END, 1.0), -1.0) * 32766) AS INT) AS n{i}" for i, x in enumerate("xyz")) + ", CAST(trunc(least(round(l, 9), 10.0) * 3276) AS INT) AS n3 FROM q")
def _(t):
    cone = N.cones(N.sturdy(t("node_faces")))
    size = G.norm(tuple(c(f"a{x}") for x in "xyz"))
    unit = cone.withColumn("l", size).select("node", F.round("l", 9).alias("l"), *(F.when(c("l") > 0.001, F.round(c(f"a{x}") / c("l"), 9)).otherwise(c(f"a{x}")).alias(f"a{x}") for x in "xyz"))
    return unit.select("node", *(G.pack_unit(c(f"a{x}")).alias(f"n{i}") for i, x in enumerate("xyz")), (F.least("l", F.lit(10.0)) * 3276).cast("int").alias("n3"))


@query("agg_14_anchors", """WITH p AS (SELECT node, vid, x * 0.6 + y * 0.8 AS along FROM node_vertices), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY along, vid) AS f, row_number() OVER (PARTITION BY node ORDER BY along DESC, vid) AS k FROM p)
SELECT a.node, a.vid AS front, b.vid AS back FROM r a JOIN r b ON b.node = a.node AND b.k = 1 WHERE a.f = 1""")
def _(t):
    v = t("node_vertices")
    axes = v.select("node").distinct().select("node", F.lit(0.6).alias("ax"), F.lit(0.8).alias("ay"), F.lit(0.0).alias("az"))
    return N.anchors(v, axes).select("node", c("front.vid").alias("front"), c("back.vid").alias("back"))


@query("agg_10_bounding_sphere", None)
def _(t):
    return N.spheres(t("node_vertices"))


@query("prj_18_node_descriptor", None)
def _(t):
    return N.descriptors(t("node_vertices"), t("node_faces"))


# Zero rows: every vertex lies in its node's sphere.
@query("agg_11_sphere_holds_vertices", "SELECT node, vid FROM node_vertices WHERE false")
def _(t):
    v = t("node_vertices").join(N.spheres(t("node_vertices")), "node")
    return v.where(G.distance2(G.vec(), (c("cx"), c("cy"), c("cz"))) > c("radius") * c("radius")).select("node", "vid")


@query("agg_41_scene_sphere", None)
def _(t):
    return N.enclosing_sphere(t("mesh_vertices"))


# ---- checks
@query("flt_19_thin_faces", f"WITH {NORMALS} SELECT fid FROM u")
def _(t):
    return N.sturdy(t("node_faces")).select("fid")


CLUSTERED = "SELECT fid, node, fid % 100 // 25 AS patch, v0 // 2 AS a, v1 // 2 AS b, v2 // 2 AS k FROM node_faces"


@query("flt_02_degenerate_patches", f"""WITH f AS ({CLUSTERED}), s AS (SELECT node, patch, count(*) FILTER (a <> b AND a <> k AND b <> k) AS kept FROM f GROUP BY node, patch)
SELECT node, CAST(patch AS BIGINT) AS patch, kept, CAST(sum(kept) OVER (PARTITION BY node ORDER BY patch) AS BIGINT) AS tri_end FROM s""")
def _(t):
    """Faces of a mesh with every two vertices merged: those that lost a corner go, patch ends close up."""
    a, b, k = (F.floor(c(f"v{i}") / 2) for i in range(3))
    kept = F.sum(F.when((a != b) & (a != k) & (b != k), 1).otherwise(0))
    rows = t("node_faces").groupBy("node", F.floor(c("fid") % 100 / 25).alias("patch")).agg(kept.alias("kept"))
    return rows.withColumn("tri_end", F.sum("kept").over(W.partitionBy("node").orderBy("patch")))


@query("flt_17_point_cloud", "SELECT (SELECT count(*) FROM mesh_faces) = 0 AS mesh, true AS cloud")
def _(t):
    none = t("mesh_faces").where("fid < 0")
    return t("region").limit(1).select(F.lit(t("mesh_faces").isEmpty()).alias("mesh"), F.lit(none.isEmpty()).alias("cloud"))


FIRST = "SELECT node, patches, size_bytes, sum(patches) OVER (ORDER BY node) - patches AS first_patch, sum(size_bytes) OVER (ORDER BY node) - size_bytes AS begin_at FROM node_index"


@query("flt_22_structure_checks", f"""WITH i AS ({FIRST}), k AS (SELECT count(*) AS patches FROM dag_patches), m AS (SELECT count(*) AS nodes FROM dag_nodes)
SELECT 'first_patch' AS test, count(*) AS broken FROM i, k WHERE first_patch > k.patches UNION ALL SELECT 'patch_node', count(*) FROM dag_patches, m WHERE dst > m.nodes OR dst <= src
UNION ALL SELECT 'offset', count(*) FROM i WHERE begin_at % 256 <> 0 UNION ALL SELECT 'texture', count(*) FROM dag_patches WHERE src % 40 > 38""")
def _(t):
    i = running(t("node_index"), ["node"], {"p": "patches", "s": "size_bytes"})
    patches, nodes = t("dag_patches"), t("dag_nodes").count()
    total = patches.count()
    bad = [("first_patch", i, c("p") - c("patches") > total), ("patch_node", patches, (c("dst") > nodes) | (c("dst") <= c("src"))), ("offset", i, (c("s") - c("size_bytes")) % 256 != 0), ("texture", patches, c("src") % 40 > 38)]
    rows = [df.agg(F.sum(F.when(cond, 1).otherwise(0)).alias("broken")).select(F.lit(name).alias("test"), F.coalesce("broken", F.lit(0)).alias("broken")) for name, df, cond in bad]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


REACH = "sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2) + power(a.cz - b.cz, 2))"


@query("flt_23_saturation_violations", f"SELECT p.src, p.ordinal, p.dst, b.error >= a.error AS by_error, {REACH} + b.radius > a.radius AS by_sphere FROM dag_patches p JOIN dag_nodes a ON a.node = p.src JOIN dag_nodes b ON b.node = p.dst WHERE b.error >= a.error OR {REACH} + b.radius > a.radius")
def _(t):
    k = D.children(t("dag_nodes"), t("dag_patches"))
    far = G.norm(tuple(c(f"src_{x}") - c(f"dst_{x}") for x in ("cx", "cy", "cz"))) + c("dst_radius") > c("src_radius")
    return k.select("src", "ordinal", "dst", (c("dst_error") >= c("src_error")).alias("by_error"), far.alias("by_sphere")).where("by_error OR by_sphere")


RAW = "SELECT node, CAST((node * 7919) % 1000 / 10.0 AS DOUBLE) AS error, cx, cy, cz, 1.0 + node % 5 AS radius FROM dag_nodes"
raw = lambda t: t("dag_nodes").select("node", (c("node") * 7919 % 1000 / 10.0).alias("error"), "cx", "cy", "cz", (1.0 + c("node") % 5).alias("radius"))


@query("agg_27_saturate", None)
def _(t):
    return N.saturated(raw(t), t("dag_patches"))


# Zero rows: after saturation no child has as much error as its parent, or reaches out of it.
@query("jon_03_saturated", "SELECT src, dst FROM dag_patches WHERE false")
def _(t):
    k = D.children(N.saturated(raw(t), t("dag_patches")), t("dag_patches"))
    far = G.norm(tuple(c(f"src_{x}") - c(f"dst_{x}") for x in ("cx", "cy", "cz"))) + c("dst_radius") > c("src_radius")
    return k.where((c("dst_error") >= c("src_error")) | far).select("src", "dst")


@query("agg_26_saturate_level", f"""WITH r AS ({RAW}), k AS (SELECT p.src, max({REACH} + b.radius) AS reach FROM dag_patches p JOIN r a ON a.node = p.src JOIN r b ON b.node = p.dst GROUP BY p.src)
SELECT r.node, round(CASE WHEN k.src IS NULL THEN r.radius ELSE greatest(r.radius, k.reach) * 1.01 END, 5) AS radius FROM r LEFT JOIN k ON k.src = r.node""")
def _(t):
    """One level: what each node's own children ask of its radius."""
    k = D.children(raw(t), t("dag_patches"))
    reach = G.norm(tuple(c(f"src_{x}") - c(f"dst_{x}") for x in ("cx", "cy", "cz"))) + c("dst_radius")
    most = k.groupBy(c("src").alias("node")).agg(F.max(reach).alias("reach"))
    return raw(t).join(most, "node", "left").select("node", F.round(F.when(c("reach").isNull(), c("radius")).otherwise(F.greatest("radius", "reach") * 1.01), 5).alias("radius"))


@query("flt_24_tight_spheres", "WITH b AS (SELECT node, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, (max(y) - min(y)) AS tight FROM node_vertices GROUP BY node), d AS (SELECT v.node, tight, max(sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2))) AS reach FROM node_vertices v JOIN b ON b.node = v.node GROUP BY v.node, tight) SELECT node, round(reach, 5) AS repaired FROM d WHERE reach > tight")
def _(t):
    """Tight radii (here the node's height) that don't reach its farthest vertex, and what does."""
    v = t("node_vertices")
    mid = [((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"]
    b = v.groupBy("node").agg(*mid, (F.max("y") - F.min("y")).alias("tight"))
    d = G.norm(G.sub(G.vec(), (c("cx"), c("cy"), c("cz"))))
    return v.join(b, "node").groupBy("node", "tight").agg(F.max(d).alias("reach")).where("reach > tight").select("node", F.round("reach", 5).alias("repaired"))


@query("flt_04_cell_members", "SELECT n.node, m.vid FROM mesh_vertices m JOIN dag_nodes n ON m.x >= n.cx - 1 AND m.x < n.cx + 1 AND m.y >= n.cy - 1 AND m.y < n.cy + 1 AND m.z >= n.cz - 1 AND m.z < n.cz + 1")
def _(t):
    """Vertices in each node's half-open box of side 2: cells of that side are the join key."""
    cell = lambda v: F.floor(v / 2)
    boxes = t("dag_nodes").select("node", "cx", "cy", "cz")
    for a in "xyz":
        boxes = boxes.select("*", F.explode(F.array_distinct(F.array(cell(c(f"c{a}") - 1), cell(c(f"c{a}") + 1)))).alias(f"k{a}"))
    v = t("mesh_vertices").select("vid", *"xyz", *(cell(c(a)).alias(f"k{a}") for a in "xyz"))
    met = boxes.join(apart(v), ["kx", "ky", "kz"])
    return met.where(G.in_box(G.vec(), tuple(c(f"c{a}") - 1 for a in "xyz"), tuple(c(f"c{a}") + 1 for a in "xyz"))).select("node", "vid")


# ---- normals over nodes
LEVEL = "CASE WHEN node % 3 = 0 THEN 1 ELSE 0 END"


@query("agg_35_unify_normals", """WITH s AS (SELECT x, y, z, sum(nx) AS sa, sum(ny) AS sb, sum(nz) AS sk, count(*) AS n FROM node_vertices GROUP BY x, y, z)
SELECT v.node, v.vid, """ + ", ".join(f"CASE WHEN n > 1 THEN CAST(trunc({s} * 32766 / sqrt(CAST(sa * sa + sb * sb + sk * sk AS DOUBLE))) AS INT) ELSE v.{o} END AS {o}" for s, o in (("sa", "nx"), ("sb", "ny"), ("sk", "nz"))) + " FROM node_vertices v JOIN s ON s.x = v.x AND s.y = v.y AND s.z = v.z")
def _(t):
    v = t("node_vertices")
    return N.unify_normals(v, v.select("node").distinct().withColumn("level", F.lit(0)))


@query("agg_36_finest_value", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY {LEVEL}, node) AS p, bool_or({LEVEL} = 0) OVER (PARTITION BY x, y, z) AS leaf FROM node_vertices),
f AS (SELECT x, y, z, nx, ny, nz FROM r WHERE p = 1) SELECT v.node, v.vid, f.nx, f.ny, f.nz FROM r v JOIN f ON f.x = v.x AND f.y = v.y AND f.z = v.z WHERE NOT v.leaf""")
def _(t):
    """Places that only nodes above have: they take the normal of the first of those."""
    v = t("node_vertices")
    level = F.when(c("node") % 3 == 0, 1).otherwise(0)
    levels = v.select("node").distinct().withColumn("level", level)
    leaf = v.where(level == 0).select("x", "y", "z").distinct()
    above = v.join(leaf, ["x", "y", "z"], "left_anti").select("node", "vid")
    return N.unify_normals(v, levels).join(above, ["node", "vid"], "left_semi")


@query("agg_38_unified_everywhere", "SELECT x, y, z FROM mesh_vertices WHERE false")
def _(t):
    """Zero rows: after the pass no place has two normals."""
    v = t("node_vertices")
    levels = v.select("node").distinct().withColumn("level", F.when(c("node") % 3 == 0, 1).otherwise(0))
    done = N.unify_normals(v, levels).join(v.select("node", "vid", *"xyz"), ["node", "vid"])
    return done.groupBy(*"xyz").agg(F.countDistinct("nx", "ny", "nz").alias("n")).where("n > 1").select(*"xyz")


@query("agg_37_border_vertices", "SELECT node, vid, x, y, z FROM (SELECT *, count(*) OVER (PARTITION BY x, y, z) AS n FROM node_vertices) WHERE n > 1")
def _(t):
    v = t("node_vertices")
    shared = v.groupBy(*"xyz").agg(F.count("*").alias("n")).where("n > 1").select(*"xyz")
    return v.join(shared, [*"xyz"], "left_semi").select("node", "vid", *"xyz")


@query("jon_09_coincident", "SELECT a.node AS a, b.node AS b, a.vid FROM node_vertices a JOIN node_vertices b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.node < b.node")
def _(t):
    v = t("node_vertices").select("node", "vid", *"xyz")
    return v.select(c("node").alias("a"), "vid", *"xyz").join(v.select(c("node").alias("b"), *"xyz"), [*"xyz"]).where("a < b").select("a", "b", "vid")


@query("agg_09_integer_normals", """WITH k AS (SELECT *, CAST(round(x0 * 16) AS BIGINT) AS X0, CAST(round(y0 * 16) AS BIGINT) AS Y0, CAST(round(z0 * 16) AS BIGINT) AS Z0 FROM node_faces),
q AS (SELECT fid, v0, v1, v2, """ + ", ".join(f"CAST(round({a}{i} * 16) AS BIGINT) AS q{a}{i}" for i in range(3) for a in "xyz") + """ FROM node_faces),
n AS (SELECT v0, v1, v2, (qy1 - qy0) * (qz2 - qz0) - (qz1 - qz0) * (qy2 - qy0) AS a, (qz1 - qz0) * (qx2 - qx0) - (qx1 - qx0) * (qz2 - qz0) AS b, (qx1 - qx0) * (qy2 - qy0) - (qy1 - qy0) * (qx2 - qx0) AS g FROM q),
s AS (SELECT vid, sum(a) AS a, sum(b) AS b, sum(g) AS g FROM (SELECT v0 AS vid, a, b, g FROM n UNION ALL SELECT v1, a, b, g FROM n UNION ALL SELECT v2, a, b, g FROM n) GROUP BY vid)
SELECT vid, """ + ", ".join(f"CAST(trunc({v} * 32767 / sqrt(CAST(a * a + b * b + g * g AS DOUBLE))) AS INT) AS n{v}" for v in "abg") + " FROM s WHERE a * a + b * b + g * g > 0")
def _(t):
    from ..operators import mesh as M

    q = t("node_faces").select("fid", "v0", "v1", "v2", *(F.round(c(f"{a}{i}") * 16).cast("long").alias(f"{a}{i}") for i in range(3) for a in "xyz"))
    s = M.vertex_normals(q)
    size = F.sqrt((c("nx") * c("nx") + c("ny") * c("ny") + c("nz") * c("nz")).cast("double"))
    return s.withColumn("l", size).where("l > 0").select("vid", *((c(f"n{a}") * 32767 / c("l")).cast("int").alias(f"n{o}") for a, o in zip("xyz", "abg", strict=True)))


# ---- textured corners
@query("msh_16_seam_split", "SELECT fid, k, vid, dense_rank() OVER (PARTITION BY vid ORDER BY u, v) - 1 AS copy FROM wedges")
def _(t):
    order = W.partitionBy("vid").orderBy("u", "v")
    return t("wedges").select("fid", "k", "vid", (F.dense_rank().over(order).cast("long") - 1).alias("copy"))


@query("prj_03_textured_mesh", "SELECT fid, max(u) FILTER (k = 0) AS u0, max(v) FILTER (k = 0) AS w0, max(u) FILTER (k = 1) AS u1, max(v) FILTER (k = 1) AS w1, max(u) FILTER (k = 2) AS u2, max(v) FILTER (k = 2) AS w2, max(chart) AS tex FROM wedges GROUP BY fid")
def _(t):
    cols = [F.max(F.when(c("k") == i, c(s))).alias(f"{o}{i}") for i in range(3) for s, o in (("u", "u"), ("v", "w"))]
    return t("wedges").groupBy("fid").agg(*cols, F.max("chart").alias("tex"))


@query("prj_05_textured_triangles", "SELECT w.fid, w.k, w.u, w.v, w.chart AS tex, m.x, m.y, m.z, 7 AS node FROM wedges w JOIN mesh_vertices m ON m.vid = w.vid")
def _(t):
    return t("wedges").join(t("mesh_vertices").select("vid", *"xyz"), "vid").select("fid", "k", "u", "v", c("chart").alias("tex"), *"xyz", F.lit(7).alias("node"))


@query("agg_32_chart_boxes", "SELECT node, chart, min(u) AS low_u, max(u) AS high_u, min(v) AS low_v, max(v) AS high_v FROM wedges WHERE NOT (u = 0 AND v = 0) GROUP BY node, chart")
def _(t):
    w = t("wedges").where(~((c("u") == 0) & (c("v") == 0)))
    return w.groupBy("node", "chart").agg(*(f(x).alias(f"{n}_{x}") for x in "uv" for f, n in ((F.min, "low"), (F.max, "high"))))


@query("agg_31_uv_quantised", "SELECT node, CAST(min(floor(u * 512 + 0.5)) AS BIGINT) AS low_u, CAST(max(floor(u * 512 + 0.5)) AS BIGINT) AS high_u, CAST(1 + floor(log2(greatest(max(floor(u * 512 + 0.5)) - min(floor(u * 512 + 0.5)), max(floor(v * 512 + 0.5)) - min(floor(v * 512 + 0.5)), 1))) AS INT) AS bits FROM wedges GROUP BY node")
def _(t):
    u, v = (G.grid(c(x), -9) for x in "uv")
    w = t("wedges").select("node", u.alias("u"), v.alias("v")).groupBy("node").agg(F.min("u").alias("low_u"), F.max("u").alias("high_u"), (F.max("v") - F.min("v")).alias("dv"))
    return w.select("node", "low_u", "high_u", (F.floor(F.log2(F.greatest(c("high_u") - c("low_u"), "dv", F.lit(1)).cast("double"))) + 1).cast("int").alias("bits"))


@query("agg_30_quantised_range", "SELECT node, " + ", ".join(f"CAST({m}(floor({a} / 0.25 + 0.5)) AS BIGINT) AS {m}_{a}" for a in "xyz" for m in ("min", "max")) + ", CAST(1 + floor(log2(greatest(" + ", ".join(f"max(floor({a} / 0.25 + 0.5)) - min(floor({a} / 0.25 + 0.5))" for a in "xyz") + ", 1))) AS INT) AS bits FROM node_vertices GROUP BY node")
def _(t):
    q = t("node_vertices").select("node", *(G.grid(c(a), -2).alias(a) for a in "xyz"))
    b = P.bounds(q, ["node"])
    return b.select("*", (F.floor(F.log2(F.greatest(*(c(f"max_{a}") - c(f"min_{a}") for a in "xyz"), F.lit(1)).cast("double"))) + 1).cast("int").alias("bits"))


@query("jon_15_texture_lookup", "SELECT f.fid, t.name FROM (SELECT fid, CASE WHEN fid % 5 = 4 THEN 4294967295 ELSE fid % 5 END AS tex FROM mesh_faces) f LEFT JOIN (SELECT r_regionkey AS tex, r_name AS name FROM region) t ON t.tex = f.tex AND f.tex <> 4294967295")
def _(t):
    """Texture 0xffffffff is none."""
    none = 0xFFFFFFFF
    f = t("mesh_faces").select("fid", F.when(c("fid") % 5 == 4, F.lit(none)).otherwise(c("fid") % 5).alias("tex"))
    names = t("region").select(c("r_regionkey").cast("long").alias("tex"), c("r_name").alias("name"))
    return f.withColumn("tex", F.nullif("tex", F.lit(none))).join(names, "tex", "left").select("fid", "name")


# ---- payloads and offsets
@query("prj_08_columnar", "SELECT node, count(*) AS n, " + ", ".join(f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY vid) AS {x}" for x in ("vid", "nx", "ny", "r")) + " FROM node_vertices GROUP BY node")
def _(t):
    rows = t("node_vertices").groupBy("node").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("vid", "nx", "ny", "r"))).alias("v"))
    column = lambda x: F.concat_ws(",", F.transform("v", lambda e: e[x].cast("string"))).alias(x)
    return rows.select("node", "n", *map(column, ("vid", "nx", "ny", "r")))


@query("prj_09_columnar_uv", "SELECT node, string_agg(CAST(CAST(round(u * 512) AS BIGINT) AS VARCHAR), ',' ORDER BY fid, k) AS u FROM wedges GROUP BY node")
def _(t):
    rows = t("wedges").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("fid", "k", F.round(c("u") * 512).cast("long").alias("u")))).alias("w"))
    return rows.select("node", F.concat_ws(",", F.transform("w", lambda e: e["u"].cast("string"))).alias("u"))


@query("prj_02_splat_rows", "SELECT node, vid, x, y, z, r, g, b, 255 AS a, nx, ny, nz FROM node_vertices")
def _(t):
    return t("node_vertices").select("node", "vid", *"xyzrgb", F.lit(255).alias("a"), "nx", "ny", "nz")


@query("prj_06_splats_of_mesh", "SELECT vid, x, y, z, r, g, b, 12 AS node FROM mesh_vertices")
def _(t):
    return t("mesh_vertices").select("vid", *"xyzrgb", F.lit(12).alias("node"))


@query("prj_07_binned", "SELECT fid, 3 AS node FROM mesh_faces WHERE fid % 2 = 0 UNION ALL SELECT fid, 4 FROM mesh_faces WHERE fid % 2 = 1")
def _(t):
    f = t("mesh_faces").select("fid")
    return f.where("fid % 2 = 0").withColumn("node", F.lit(3)).unionAll(f.where("fid % 2 = 1").withColumn("node", F.lit(4)))


@query("prj_16_offset_spans", f"WITH i AS ({FIRST}) SELECT node, CAST(begin_at AS BIGINT) AS begin_at, CAST(coalesce(lead(begin_at) OVER (ORDER BY node), (SELECT sum(size_bytes) FROM node_index)) AS BIGINT) AS end_at, CAST(begin_at // 256 AS BIGINT) AS stored FROM i")
def _(t):
    i = running(t("node_index"), ["node"], {"s": "size_bytes"})
    return i.select("node", (c("s") - c("size_bytes")).alias("begin_at"), c("s").alias("end_at"), ((c("s") - c("size_bytes")) / 256).cast("long").alias("stored"))


@query("prj_17_last_patch", f"WITH i AS ({FIRST}) SELECT i.node, CAST(first_patch AS BIGINT) AS first_patch, CAST(first_patch + i.patches AS BIGINT) AS last_patch, n.cx AS tight_x, n.tight_radius FROM i JOIN dag_nodes n ON n.node = i.node")
def _(t):
    i = running(t("node_index"), ["node"], {"p": "patches"})
    return i.select("node", (c("p") - c("patches")).alias("first_patch"), c("p").alias("last_patch"), c("cx").alias("tight_x"), "tight_radius")


@query("str_22_chunk_offsets", "WITH q AS (SELECT node, CAST((nvert * 12 + 255) // 256 * 256 AS BIGINT) AS padded FROM dag_nodes) SELECT node, padded, CAST(sum(padded) OVER (ORDER BY node) - padded AS BIGINT) AS at FROM q")
def _(t):
    d = t("dag_nodes").select("node", G.pad(c("nvert") * 12).alias("padded"))
    return running(d, ["node"], {"s": "padded"}).select("node", "padded", (c("s") - c("padded")).alias("at"))


@query("agg_25_coordinate_step", "SELECT min(0.5 * error / 2) AS step FROM (SELECT error FROM dag_nodes WHERE node IN (SELECT src FROM dag_patches WHERE dst = (SELECT count(*) FROM dag_nodes)) UNION ALL SELECT error FROM dag_nodes WHERE node = 0)")
def _(t):
    n = t("dag_nodes")
    leaves = D.finest_level(n, t("dag_patches"), n.count()).select("error").unionAll(n.where("node = 0").select("error"))
    return leaves.agg(F.min(0.5 * c("error") / 2).alias("step"))


# ---- orders
for _name, _table, _order in (("srt_02_faces_by_node", "node_faces", ["node", "fid"]), ("srt_03_vertices_by_node", "node_vertices", ["node", "vid"]), ("srt_07_edges_by_ends", "node_faces", ["v0", "v1", "fid"])):

    @query(_name, f"SELECT {', '.join(_order)}, row_number() OVER (ORDER BY {', '.join(_order)}) AS place FROM {_table}")
    def _(t, table=_table, order=_order):
        return running(t(table).select(*order), order, number="place").select(*order, "place")


@query("srt_05_points_by_place", "SELECT x, y, z, node, vid, row_number() OVER (ORDER BY x, y, z, -node, vid) AS place FROM node_vertices")
def _(t):
    return running(t("node_vertices").withColumn("down", -c("node")), [*"xyz", "down", "vid"], number="place").select(*"xyz", "node", "vid", "place")


@query("srt_14_reversed_patches", "SELECT (SELECT count(*) FROM dag_patches) - row_number() OVER (ORDER BY src, ordinal) AS place, (SELECT count(*) FROM dag_nodes) - src AS src, (SELECT count(*) FROM dag_nodes) - dst AS dst FROM dag_patches")
def _(t):
    n, total = t("dag_nodes").count(), t("dag_patches").count()
    return running(t("dag_patches"), ["src", "ordinal"], number="i").select((F.lit(total) - c("i")).alias("place"), (F.lit(n) - c("src")).alias("src"), (F.lit(n) - c("dst")).alias("dst"))


@query("set_02_level_union", "SELECT node, count(*) AS n FROM (SELECT node FROM node_faces UNION ALL SELECT node FROM node_vertices) GROUP BY node")
def _(t):
    return t("node_faces").select("node").unionAll(t("node_vertices").select("node")).groupBy("node").agg(F.count("*").alias("n"))


@query("agg_04_cell_order_statistic", "WITH r AS (SELECT node, x, row_number() OVER (PARTITION BY node ORDER BY x, pid) AS i, count(*) OVER (PARTITION BY node) AS n FROM splats) SELECT node, x AS split FROM r WHERE i = CAST(floor(n * 0.6666) AS BIGINT) + 1")
def _(t):
    w = W.partitionBy("node").orderBy("x", "pid")  # a node is bounded
    r = t("splats").select("node", "x", F.row_number().over(w).alias("i"), F.count("*").over(W.partitionBy("node")).alias("n"))
    return r.where(c("i") == F.floor(c("n") * 0.6666) + 1).select("node", c("x").alias("split"))


@query("msh_05_route_by_split", "WITH m AS (SELECT node, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM splats GROUP BY node) SELECT pid, CASE WHEN CASE WHEN dx > dy AND dx > dz THEN x < mx WHEN NOT (dx > dy) AND dy > dz THEN y < my ELSE z < mz END THEN 0 ELSE 1 END AS side FROM splats s JOIN m ON m.node = s.node")
def _(t):
    """Each cell's points by its own middle along its longest side."""
    s = t("splats")
    b = P.bounds(s, ["node"])
    axis = G.longest_axis(*(c(f"max_{a}") - c(f"min_{a}") for a in "xyz"))
    mid = lambda a: (c(f"min_{a}") + c(f"max_{a}")) / 2
    low = F.when(axis == 0, c("x") < mid("x")).when(axis == 1, c("y") < mid("y")).otherwise(c("z") < mid("z"))
    return s.join(b, "node").select("pid", F.when(low, 0).otherwise(1).alias("side"))


# ---- searches: every point whose id is divisible by 50, against all
PTS = "p AS (SELECT CAST(vid AS BIGINT) AS id, x, y, z FROM mesh_vertices)"
D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"
pts = lambda t: t("mesh_vertices").select(c("vid").alias("id"), "x", "y", "z")


@query("jon_11_nearest", f"WITH {PTS}, q AS (SELECT * FROM p WHERE id % 50 = 0), m AS (SELECT q.id AS q, p.id AS p, {D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {D2}, p.id) AS rank FROM q, p) SELECT q, p, round(d2, 4) AS d2, CAST(rank AS INT) AS rank FROM m WHERE rank <= 4")
def _(t):
    p = pts(t)
    return P.nearest(p.where("id % 50 = 0"), p, 4, 2.0).select("q", "p", F.round("d2", 4).alias("d2"), "rank")


@query("jon_13_closest", f"WITH {PTS}, q AS (SELECT id, x + 0.3 AS x, y, z FROM p WHERE id % 50 = 0), m AS (SELECT q.id AS q, p.id AS p, row_number() OVER (PARTITION BY q.id ORDER BY {D2}, p.id) AS r FROM q, p) SELECT q, p FROM m WHERE r = 1")
def _(t):
    p = pts(t)
    return P.nearest(p.where("id % 50 = 0").withColumn("x", c("x") + 0.3), p, 1, 1.0).select("q", "p")


@query("udx_09_cell_average", "WITH k AS (SELECT CAST(floor(x / 5) AS BIGINT) AS a, CAST(floor(y / 5) AS BIGINT) AS b, vid, r, g, power(x - (floor(x / 5) * 5 + 2.5), 2) + power(y - (floor(y / 5) * 5 + 2.5), 2) AS d FROM mesh_vertices) SELECT a, b, round(avg(r), 4) AS r, round(avg(g), 4) AS g, arg_min(vid, (d, vid)) AS nearest FROM k GROUP BY a, b".replace("arg_min(vid, (d, vid))", "arg_min(vid, struct_pack(d := d, vid := vid))"))
def _(t):
    a, b = F.floor(c("x") / 5), F.floor(c("y") / 5)
    d = F.pow(c("x") - (a * 5 + 2.5), 2) + F.pow(c("y") - (b * 5 + 2.5), 2)
    v = t("mesh_vertices").select(a.alias("a"), b.alias("b"), d.alias("d"), "vid", "r", "g")
    return v.groupBy("a", "b").agg(F.round(F.avg("r"), 4).alias("r"), F.round(F.avg("g"), 4).alias("g"), F.min_by("vid", F.struct("d", "vid")).alias("nearest"))


@query("udx_10_face_samples", "SELECT fid, i, round(x0 * (1 - (i + 1) / 6.0::DOUBLE) + x1 * ((i + 1) / 12.0::DOUBLE) + x2 * ((i + 1) / 12.0::DOUBLE), 5) AS x FROM node_faces, range(3) r(i)")
def _(t):
    """Each face gives three samples along the line from its first corner to the opposite side's middle."""
    i = c("i")
    rows = t("node_faces").select("fid", "x0", "x1", "x2", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return rows.select("fid", i.cast("long").alias("i"), F.round(c("x0") * (1 - (i + 1) / 6) + c("x1") * ((i + 1) / 12) + c("x2") * ((i + 1) / 12), 5).alias("x"))


@query("win_12_smoothed_path", "WITH f AS (SELECT event_id AS frame, value AS z FROM events) SELECT a.frame, round(sum(exp(-0.1 * (b.frame - a.frame) * (b.frame - a.frame)) * b.z) / sum(exp(-0.1 * (b.frame - a.frame) * (b.frame - a.frame))), 4) AS z FROM f a JOIN f b ON b.frame - a.frame BETWEEN -6 AND 5 GROUP BY a.frame")
def _(t):
    """Recorded values by frame, each the Gaussian mean of the frames around."""
    f = t("events").select(c("event_id").alias("frame"), c("value").alias("z"))
    shifted = f.select(F.explode(F.sequence(F.lit(-6), F.lit(5))).alias("k"), (c("frame") - c("k")).alias("at"), "z")
    w = F.exp(-0.1 * c("k") * c("k"))
    out = shifted.groupBy(c("at").alias("frame")).agg(F.round(F.sum(w * c("z")) / F.sum(w), 4).alias("z"))
    return out.join(f.select("frame"), "frame", "left_semi").select("frame", "z")
