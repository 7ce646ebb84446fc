"""Cleaning, topology, normals, statistics, quality, selection, colour and smoothing of a mesh, over whole tables.

rough_faces has repeated, degenerate and overhanging faces among those of the mesh.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import geometry as G
from ..functions import intersect as X
from ..operators import mesh as M
from ..operators.prefix import running
from ..plans import dag as D
from . import TRI, query

c = F.col
r4 = lambda v: F.round(v, 4) + F.lit(0.0)
tri = lambda t: M.gather(t("mesh_faces"), t("mesh_vertices"))
corner = lambda k: G.vec(suffix=str(k))
pick = lambda t, *names: t("mesh_vertices").select("vid", *names)

SAME = "list_sort([v0, v1, v2])"
E = "e AS (SELECT fid, v0 AS a, v1 AS b FROM {0} UNION ALL SELECT fid, v1, v2 FROM {0} UNION ALL SELECT fid, v2, v0 FROM {0})"
U = E + ", u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n, count(*) FILTER (a < b) AS up FROM e WHERE a <> b GROUP BY 1, 2)"
NRM = "(y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS g"
FN = f"{TRI}, n0 AS (SELECT *, {NRM} FROM tri), fn AS (SELECT *, sqrt(a * a + b * b + g * g) AS l FROM n0)"
CORNER = "k AS (SELECT fid, v0 AS vid, a, b, g, l, z0 AS z FROM fn UNION ALL SELECT fid, v1, a, b, g, l, z1 FROM fn UNION ALL SELECT fid, v2, a, b, g, l, z2 FROM fn)"
LEN = ["sqrt(power(x{0} - x{1}, 2) + power(y{0} - y{1}, 2) + power(z{0} - z{1}, 2))".format(i, (i + 1) % 3) for i in range(3)]


def normals(t):
    """Triangles with normals, their length l, and the corners' values."""
    return M.face_normal(tri(t)).withColumn("l", G.norm((c("nx"), c("ny"), c("nz"))))


def edge_counts(t, table):
    e = M.edges(t(table)).where("a <> b")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(c("a") < c("b"), 1).otherwise(0)).alias("up"))


def around(t):
    """(vid, other): each pair of neighbours, both ways, once."""
    u = M.undirected(M.edges(t("mesh_faces"))).select("a", "b").distinct()
    return u.select(c("a").alias("vid"), c("b").alias("other")).unionAll(u.select(c("b").alias("vid"), c("a").alias("other")))


NEAR = f"{E.format('mesh_faces')}, nb AS (SELECT a AS vid, b AS other FROM e UNION SELECT b, a FROM e)"


# ---- cleaning
@query("vc_02_duplicate_faces", f"SELECT min(fid) AS fid FROM rough_faces GROUP BY {SAME}")
def _(t):
    """Of faces with the same corners, in whatever order, the first stays."""
    return t("rough_faces").groupBy(F.array_sort(F.array("v0", "v1", "v2")).alias("k")).agg(F.min("fid").alias("fid")).select("fid")


@query("vc_03_duplicate_edges", f"WITH {U.format('rough_faces')} SELECT a, b, n FROM u WHERE n > 1")
def _(t):
    return edge_counts(t, "rough_faces").where("n > 1").select("a", "b", "n")


@query("vc_14_non_manifold_edges", f"WITH {U.format('rough_faces')} SELECT a, b, n FROM u WHERE n > 2")
def _(t):
    return edge_counts(t, "rough_faces").where("n > 2").select("a", "b", "n")


@query("vc_14_faces_on_non_manifold_edges", f"WITH {U.format('rough_faces')} SELECT DISTINCT e.fid FROM e JOIN u ON u.a = least(e.a, e.b) AND u.b = greatest(e.a, e.b) WHERE n > 2")
def _(t):
    bad = edge_counts(t, "rough_faces").where("n > 2").select("a", "b")
    return M.undirected(M.edges(t("rough_faces"))).join(bad, ["a", "b"], "left_semi").select("fid").distinct()


@query("vc_16_zero_area", f"WITH {TRI.replace('mesh_faces', 'rough_faces')}, n AS (SELECT fid, {NRM} FROM tri) SELECT fid FROM n WHERE a * a + b * b + g * g = 0")
def _(t):
    n = M.face_normal(M.gather(t("rough_faces"), t("mesh_vertices")))
    return n.where("nx * nx + ny * ny + nz * nz = 0").select("fid")


@query("vc_17_area_range", f"WITH {FN} SELECT fid, round(l / 2, 4) AS area FROM fn WHERE l / 2 BETWEEN 0.6 AND 1.4")
def _(t):
    return normals(t).where(c("l").between(1.2, 2.8)).select("fid", r4(c("l") / 2).alias("area"))


@query("vc_31_water_tight", f"WITH {U.format('mesh_faces')} SELECT count(*) FILTER (n <> 2) = 0 AS tight, count(*) AS edges, count(*) FILTER (n = 1) AS border, count(*) FILTER (n > 2) AS many FROM u")
def _(t):
    some = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return edge_counts(t, "mesh_faces").agg((some(c("n") != 2) == 0).alias("tight"), F.count("*").alias("edges"), some(c("n") == 1).alias("border"), some(c("n") > 2).alias("many"))


@query("vc_40_coherent", f"WITH {U.format('rough_faces')} SELECT a, b FROM u WHERE n = 2 AND up <> 1")
def _(t):
    """Edges whose two faces run along them the same way."""
    return edge_counts(t, "rough_faces").where("n = 2 AND up <> 1").select("a", "b")


@query("vc_42_flipped", "SELECT fid, v0, v2 AS v1, v1 AS v2 FROM mesh_faces")
def _(t):
    return t("mesh_faces").select("fid", "v0", c("v2").alias("v1"), c("v1").alias("v2"))


@query("vc_33_holes", None)
def _(t):
    """Border loops: components of the border's edges, with their lengths."""
    border = M.boundary_edges(t("mesh_faces"))
    comp = D.components(border)
    return border.join(comp.withColumnRenamed("id", "a"), "a").groupBy("comp").agg(F.count("*").alias("edges"))


@query("vc_34_component_sizes", "SELECT min(v0) AS comp, count(*) AS faces FROM mesh_faces")
def _(t):
    e = M.undirected(M.edges(t("mesh_faces"))).select("a", "b").distinct()
    comp = D.components(e)
    return t("mesh_faces").join(comp.withColumnRenamed("id", "v0"), "v0").groupBy("comp").agg(F.count("*").alias("faces"))


@query("vc_55_small_components", "SELECT p_size AS part, min(p_partkey) AS comp, count(*) AS n FROM part GROUP BY p_size HAVING count(*) >= 3")
def _(t):
    """Components (chains of parts of one size) of fewer than three members go."""
    w = W.partitionBy("p_size").orderBy("p_partkey")
    p = t("part").select(c("p_partkey").cast("long").alias("id"), "p_size", F.lead(c("p_partkey").cast("long")).over(w).alias("next"))
    comp = D.components(p.select(c("id").alias("a"), F.coalesce("next", "id").alias("b")))
    return p.join(comp, "id").groupBy(c("p_size").alias("part"), "comp").agg(F.count("*").alias("n")).where("n >= 3")


@query("vc_38_genus", f"WITH {U.format('mesh_faces')} SELECT (SELECT count(*) FROM mesh_vertices) AS v, (SELECT count(*) FROM u) AS e, (SELECT count(*) FROM mesh_faces) AS f, CAST((2 - (SELECT count(*) FROM mesh_vertices) + (SELECT count(*) FROM u) - (SELECT count(*) FROM mesh_faces) - 1) / 2 AS BIGINT) AS genus")
def _(t):
    """(2 components - V + E - F - holes) / 2 of a mesh of one component with one border."""
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("v", t("mesh_vertices")), ("e", edge_counts(t, "mesh_faces")), ("f", t("mesh_faces")))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    return one.select("v", "e", "f", ((2 - c("v") + c("e") - c("f") - 1) / 2).cast("long").alias("genus"))


@query("vc_39_regular", f"WITH {NEAR} SELECT n AS valence, count(*) AS vertices FROM (SELECT vid, count(*) AS n FROM nb GROUP BY vid) GROUP BY n")
def _(t):
    return around(t).groupBy("vid").agg(F.count("*").alias("valence")).groupBy("valence").agg(F.count("*").alias("vertices"))


# ---- topology
@query("vt_02_unique_edges", f"WITH {U.format('mesh_faces')} SELECT a, b FROM u")
def _(t):
    return edge_counts(t, "mesh_faces").select("a", "b")


@query("vt_06_vertex_faces", "SELECT vid, string_agg(CAST(fid AS VARCHAR), ',' ORDER BY fid) AS faces FROM (SELECT v0 AS vid, fid FROM mesh_faces UNION ALL SELECT v1, fid FROM mesh_faces UNION ALL SELECT v2, fid FROM mesh_faces) GROUP BY vid")
def _(t):
    k = M.corners(t("mesh_faces")).groupBy("vid").agg(F.array_sort(F.collect_list("fid")).alias("f"))  # a vertex's faces
    return k.select("vid", F.concat_ws(",", F.transform("f", lambda x: x.cast("string"))).alias("faces"))


@query("vf_24_border_flags", f"WITH {U.format('mesh_faces')} SELECT f.fid, bool_or(u.n = 1) AS border FROM (SELECT * FROM e) f JOIN u ON u.a = least(f.a, f.b) AND u.b = greatest(f.a, f.b) GROUP BY f.fid")
def _(t):
    u = edge_counts(t, "mesh_faces").select("a", "b", "n")
    return M.undirected(M.edges(t("mesh_faces"))).join(u, ["a", "b"]).groupBy("fid").agg(F.max(c("n") == 1).alias("border"))


# ---- normals
@query("vn_06_face_normals", f"WITH {FN} SELECT fid, round(a / l, 4) + 0.0 AS a, round(b / l, 4) + 0.0 AS b, round(g / l, 4) + 0.0 AS g FROM fn WHERE l > 0")
def _(t):
    return normals(t).where("l > 0").select("fid", *(r4(c(n) / c("l")).alias(o) for n, o in (("nx", "a"), ("ny", "b"), ("nz", "g"))))


@query("vn_13_vertex_normals", f"WITH {FN}, {CORNER}, s AS (SELECT vid, sum(a) AS a, sum(b) AS b, sum(g) AS g FROM k GROUP BY vid) SELECT vid, round(a / sqrt(a * a + b * b + g * g), 4) + 0.0 AS a, round(b / sqrt(a * a + b * b + g * g), 4) + 0.0 AS b, round(g / sqrt(a * a + b * b + g * g), 4) + 0.0 AS g FROM s WHERE a * a + b * b + g * g > 0")
def _(t):
    n = M.vertex_normals(tri(t)).withColumn("l", G.norm((c("nx"), c("ny"), c("nz")))).where("l > 0")
    return n.select("vid", *(r4(c(x) / c("l")).alias(o) for x, o in (("nx", "a"), ("ny", "b"), ("nz", "g"))))


@query("vn_08_mean_of_unit_normals", f"WITH {FN}, {CORNER} SELECT vid, round(sum(a / l), 4) + 0.0 AS a, round(sum(b / l), 4) + 0.0 AS b, round(sum(g / l), 4) + 0.0 AS g FROM k WHERE l > 0 GROUP BY vid")
def _(t):
    n = normals(t).where("l > 0").select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), *((c(x) / c("l")).alias(x) for x in ("nx", "ny", "nz")))
    return n.groupBy("vid").agg(*(r4(F.sum(x)).alias(o) for x, o in (("nx", "a"), ("ny", "b"), ("nz", "g"))))


@query("vn_04_angle_weighted", f"WITH {FN}, d AS (SELECT *, {LEN[0]} AS p, {LEN[1]} AS q, {LEN[2]} AS s FROM fn), w AS (SELECT v0 AS vid, g / l * acos(greatest(-1.0, least(1.0, (p * p + s * s - q * q) / (2 * p * s)))) AS g FROM d UNION ALL SELECT v1, g / l * acos(greatest(-1.0, least(1.0, (p * p + q * q - s * s) / (2 * p * q)))) FROM d UNION ALL SELECT v2, g / l * acos(greatest(-1.0, least(1.0, (q * q + s * s - p * p) / (2 * q * s)))) FROM d) SELECT vid, round(sum(g), 4) + 0.0 AS g FROM w GROUP BY vid")
def _(t):
    """The third component of vertex normals, each face weighted by its angle there."""
    d = normals(t)
    p, q, s = (G.norm(G.sub(corner(i), corner((i + 1) % 3))) for i in range(3))
    angle = lambda x, y, z: F.acos(X.clamp((x * x + y * y - z * z) / (2 * x * y), -1.0, 1.0))
    rows = F.array(*(F.struct(c(f"v{k}").alias("vid"), (c("nz") / c("l") * a).alias("g")) for k, a in enumerate((angle(p, s, q), angle(p, q, s), angle(q, s, p)))))
    return d.select(F.explode(rows).alias("r")).groupBy(c("r.vid").alias("vid")).agg(r4(F.sum("r.g")).alias("g"))


# ---- statistics
@query("va_06_cloud_barycentre", "SELECT round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM mesh_vertices")
def _(t):
    return t("mesh_vertices").agg(*(r4(F.avg(a)).alias(a) for a in "xyz"))


@query("va_07_shell_barycentre", f"WITH {FN} SELECT " + ", ".join(f"round(sum(l * ({a}0 + {a}1 + {a}2) / 3) / sum(l), 4) AS {a}" for a in "xyz") + " FROM fn")
def _(t):
    return normals(t).agg(*(r4(F.sum(c("l") * (c(a + "0") + c(a + "1") + c(a + "2")) / 3) / F.sum("l")).alias(a) for a in "xyz"))


@query("va_08_volume", f"WITH {TRI} SELECT round(sum(x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6, 3) AS volume FROM tri")
def _(t):
    return M.measures(tri(t)).select(F.round("volume", 3).alias("volume"))


@query("va_12_quality_histogram", f"WITH {FN}, q AS (SELECT l / power(greatest({LEN[0]}, {LEN[1]}, {LEN[2]}), 2) AS q FROM fn) SELECT CAST(floor(round(q, 9) * 20) AS BIGINT) AS bin, count(*) AS n FROM q GROUP BY 1")
def _(t):
    q = F.round(X.quality(tuple(corner(k) for k in range(3))), 9)
    return tri(t).groupBy(F.floor(q * 20).alias("bin")).agg(F.count("*").alias("n"))


@query("va_14_edge_length_histogram", f"WITH {TRI}, d AS (SELECT {LEN[0]} AS d FROM tri UNION ALL SELECT {LEN[1]} FROM tri UNION ALL SELECT {LEN[2]} FROM tri) SELECT CAST(floor(round(d, 9) * 4) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY 1")
def _(t):
    d = F.explode(F.array(*(G.norm(G.sub(corner(i), corner((i + 1) % 3))) for i in range(3)))).alias("d")
    return tri(t).select(d).groupBy(F.floor(F.round("d", 9) * 4).alias("bin")).agg(F.count("*").alias("n"))


@query("va_15_edge_length_average", f"WITH {TRI}, d AS (SELECT least(v0, v1) AS a, greatest(v0, v1) AS b, {LEN[0]} AS d FROM tri UNION SELECT least(v1, v2), greatest(v1, v2), {LEN[1]} FROM tri UNION SELECT least(v2, v0), greatest(v2, v0), {LEN[2]} FROM tri), o AS (SELECT a, b, min(d) AS d FROM d GROUP BY a, b) SELECT round(avg(d), 4) AS mean, (SELECT round(avg(x), 4) FROM (SELECT {LEN[0]} AS x FROM tri UNION ALL SELECT {LEN[1]} FROM tri UNION ALL SELECT {LEN[2]} FROM tri)) AS by_face FROM o")
def _(t):
    """Every edge once, and every edge as often as faces have it."""
    rows = F.array(*(F.struct(F.least(f"v{i}", f"v{(i + 1) % 3}").alias("a"), F.greatest(f"v{i}", f"v{(i + 1) % 3}").alias("b"), G.norm(G.sub(corner(i), corner((i + 1) % 3))).alias("d")) for i in range(3)))
    e = tri(t).select(F.explode(rows).alias("e")).groupBy("e.a", "e.b").agg(F.min("e.d").alias("d"), F.count("*").alias("n"))
    return e.agg(r4(F.avg("d")).alias("mean"), r4(F.sum(c("d") * c("n")) / F.sum("n")).alias("by_face"))


@query("vo_57_percentiles", "SELECT p, z FROM (SELECT z, row_number() OVER (ORDER BY z, vid) - 1 AS i, count(*) OVER () AS n FROM mesh_vertices) JOIN (VALUES (0.1), (0.5), (0.9)) v(p) ON i = CAST(floor(n * p) AS BIGINT)")
def _(t):
    """The values at shares of the whole order."""
    n = t("mesh_vertices").count()
    places = t("region").sparkSession.createDataFrame([(p, int(n * p) + 1) for p in (0.1, 0.5, 0.9)], "p double, i long")
    return running(pick(t, "z"), ["z", "vid"], number="i").join(F.broadcast(places), "i").select("p", "z")  # three rows


@query("vo_55_inertia", f"WITH {TRI}, d AS (SELECT *, x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2) AS d FROM tri) SELECT " + ", ".join(f"round(sum(d * ({a}0 + {a}1 + {a}2)) / 24, 2) AS m{a}" for a in "xyz") + ", " + ", ".join(f"round(sum(d * ({a}0 * {b}0 + {a}1 * {b}1 + {a}2 * {b}2 + ({a}0 + {a}1 + {a}2) * ({b}0 + {b}1 + {b}2))) / 120, 2) AS m{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "yz", "xz")) + " FROM d")
def _(t):
    """First and second moments of the solid between the origin and the surface."""
    d = G.dot(corner(0), G.cross(corner(1), corner(2)))
    total = lambda a: c(a + "0") + c(a + "1") + c(a + "2")
    first = [F.round(F.sum(d * total(a)) / 24, 2).alias("m" + a) for a in "xyz"]
    second = [F.round(F.sum(d * (sum((c(f"{a}{k}") * c(f"{b}{k}") for k in range(3)), F.lit(0.0)) + total(a) * total(b))) / 120, 2).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "yz", "xz")]
    return tri(t).agg(*first, *second)


@query("vo_56_covariance", "SELECT " + ", ".join(f"round(covar_pop({a}, {b}), 4) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "yz", "xz")) + " FROM mesh_vertices")
def _(t):
    return t("mesh_vertices").agg(*(r4(F.covar_pop(a, b)).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "yz", "xz")))


# ---- quality, selection, colour
@query("vq_03_normalised", "SELECT vid, round((z - (SELECT min(z) FROM mesh_vertices)) / ((SELECT max(z) FROM mesh_vertices) - (SELECT min(z) FROM mesh_vertices)), 4) AS q FROM mesh_vertices")
def _(t):
    span = t("mesh_vertices").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return pick(t, "z").crossJoin(F.broadcast(span)).select("vid", r4((c("z") - c("low")) / (c("high") - c("low"))).alias("q"))  # one row


@query("vq_07_from_faces", f"WITH {FN}, {CORNER} SELECT vid, round(sum(l * l) / sum(l), 4) AS q FROM k GROUP BY vid")
def _(t):
    """A vertex takes the mean of its faces' areas (doubled), weighted by area."""
    n = normals(t).select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), "l")
    return n.groupBy("vid").agg(r4(F.sum(c("l") * c("l")) / F.sum("l")).alias("q"))


@query("vq_10_from_vertices", f"WITH {TRI} SELECT fid, round((z0 + z1 + z2) / 3, 4) AS q FROM tri")
def _(t):
    return tri(t).select("fid", r4((c("z0") + c("z1") + c("z2")) / 3).alias("q"))


@query("vq_11_from_plane", "SELECT vid, round((x + 2 * y + 2 * z - 6) / 3, 4) AS q FROM mesh_vertices")
def _(t):
    return pick(t, *"xyz").select("vid", r4((c("x") + 2 * c("y") + 2 * c("z") - 6) / 3).alias("q"))


@query("vq_12_gaussian_curvature", f"WITH {FN}, d AS (SELECT *, {LEN[0]} AS p, {LEN[1]} AS q, {LEN[2]} AS s FROM fn), w AS (SELECT v0 AS vid, l, acos(greatest(-1.0, least(1.0, (p * p + s * s - q * q) / (2 * p * s)))) AS t FROM d UNION ALL SELECT v1, l, acos(greatest(-1.0, least(1.0, (p * p + q * q - s * s) / (2 * p * q)))) FROM d UNION ALL SELECT v2, l, acos(greatest(-1.0, least(1.0, (q * q + s * s - p * p) / (2 * q * s)))) FROM d) SELECT vid, round((2 * pi() - sum(t)) / (sum(l) / 6), 4) AS k FROM w GROUP BY vid")
def _(t):
    """Angle defect over a third of the area around."""
    d = normals(t)
    p, q, s = (G.norm(G.sub(corner(i), corner((i + 1) % 3))) for i in range(3))
    angle = lambda x, y, z: F.acos(X.clamp((x * x + y * y - z * z) / (2 * x * y), -1.0, 1.0))
    rows = F.array(*(F.struct(c(f"v{k}").alias("vid"), a.alias("t")) for k, a in enumerate((angle(p, s, q), angle(p, q, s), angle(q, s, p)))))
    w = d.select("l", F.explode(rows).alias("r"))
    return w.groupBy(c("r.vid").alias("vid")).agg(r4((2 * F.pi() - F.sum("r.t")) / (F.sum("l") / 6)).alias("k"))


IN = "x >= 3 AND x < 9 AND y >= 2 AND y < 40"
chosen = lambda t: t("mesh_vertices").where(IN).select("vid")


@query("vs_17_faces_of_vertices_strict", f"WITH s AS (SELECT vid FROM mesh_vertices WHERE {IN}) SELECT fid FROM mesh_faces WHERE v0 IN (SELECT vid FROM s) AND v1 IN (SELECT vid FROM s) AND v2 IN (SELECT vid FROM s)")
def _(t):
    n = M.corners(t("mesh_faces")).join(chosen(t), "vid", "left_semi").groupBy("fid").agg(F.count("*").alias("n"))
    return n.where("n = 3").select("fid")


@query("vs_18_faces_of_vertices_loose", f"WITH s AS (SELECT vid FROM mesh_vertices WHERE {IN}) SELECT fid FROM mesh_faces WHERE v0 IN (SELECT vid FROM s) OR v1 IN (SELECT vid FROM s) OR v2 IN (SELECT vid FROM s)")
def _(t):
    return M.corners(t("mesh_faces")).join(chosen(t), "vid", "left_semi").select("fid").distinct()


@query("vs_16_vertices_of_faces_strict", "WITH k AS (SELECT v0 AS vid, fid FROM mesh_faces UNION ALL SELECT v1, fid FROM mesh_faces UNION ALL SELECT v2, fid FROM mesh_faces) SELECT vid FROM k GROUP BY vid HAVING bool_and(fid % 7 <> 0)")
def _(t):
    return M.corners(t("mesh_faces")).groupBy("vid").agg(F.min(c("fid") % 7 != 0).alias("all")).where("all").select("vid")


@query("vs_21_long_edges", f"WITH {TRI} SELECT fid FROM tri WHERE greatest({', '.join(LEN)}) > 3 OR least({', '.join(LEN)}) < 1.05")
def _(t):
    d = [G.norm(G.sub(corner(i), corner((i + 1) % 3))) for i in range(3)]
    return tri(t).where((F.greatest(*d) > 3) | (F.least(*d) < 1.05)).select("fid")


@query("vs_13_inverted", f"SELECT vid, NOT ({IN}) AS selected FROM mesh_vertices")
def _(t):
    return t("mesh_vertices").select("vid", (~F.expr(IN)).alias("selected"))


@query("vk_05_quality_ramp", "WITH q AS (SELECT vid, greatest(0.0, least(1.0, (z - 1) / 3)) AS t FROM mesh_vertices) SELECT vid, CAST(floor(CASE WHEN t * 4 < 1 THEN 255 WHEN t * 4 < 2 THEN 255 * (2 - t * 4) ELSE 0 END) AS INT) AS r FROM q")
def _(t):
    return t("mesh_vertices").select("vid", C.ramp(c("z"), 1.0, 4.0)[0].alias("r"))


@query("vk_03_from_faces", "WITH k AS (SELECT v0 AS vid, fid FROM mesh_faces UNION ALL SELECT v1, fid FROM mesh_faces UNION ALL SELECT v2, fid FROM mesh_faces) SELECT vid, CAST(sum(fid % 256) // count(*) AS BIGINT) AS r FROM k GROUP BY vid")
def _(t):
    return M.corners(t("mesh_faces")).groupBy("vid").agg(F.floor(F.sum(c("fid") % 256) / F.count("*")).alias("r"))


@query("vk_04_from_vertices", "SELECT f.fid, (a.r + b.r + k.r) // 3 AS r FROM mesh_faces f JOIN mesh_vertices a ON a.vid = f.v0 JOIN mesh_vertices b ON b.vid = f.v1 JOIN mesh_vertices k ON k.vid = f.v2")
def _(t):
    rows = M.corners(t("mesh_faces")).join(pick(t, "r"), "vid").groupBy("fid").agg(F.sum("r").alias("r"))
    return rows.select("fid", F.floor(c("r") / 3).cast("int").alias("r"))


# ---- smoothing
@query("vm_04_laplacian", f"WITH {NEAR} SELECT v.vid, round((v.z + sum(o.z)) / (1 + count(*)), 5) AS z FROM mesh_vertices v JOIN nb ON nb.vid = v.vid JOIN mesh_vertices o ON o.vid = nb.other GROUP BY v.vid, v.z")
def _(t):
    """One step: a vertex moves to the mean of itself and its neighbours."""
    o = t("mesh_vertices").select(c("vid").alias("other"), c("z").alias("oz"))
    s = around(t).join(o, "other").groupBy("vid").agg(F.sum("oz").alias("s"), F.count("*").alias("n"))
    return pick(t, "z").join(s, "vid").select("vid", F.round((c("z") + c("s")) / (1 + c("n")), 5).alias("z"))


@query("vm_07_taubin", f"WITH {NEAR}, s1 AS (SELECT v.vid, v.z + 0.5 * (avg(o.z) - v.z) AS z FROM mesh_vertices v JOIN nb ON nb.vid = v.vid JOIN mesh_vertices o ON o.vid = nb.other GROUP BY v.vid, v.z) SELECT v.vid, round(v.z - 0.53 * (avg(o.z) - v.z) + 1e-7, 3) AS z FROM s1 v JOIN nb ON nb.vid = v.vid JOIN s1 o ON o.vid = nb.other GROUP BY v.vid, v.z")
def _(t):
    """A step towards the neighbours' mean and one away from it."""
    near, v = around(t), pick(t, "z")
    for step in (0.5, -0.53):
        mean = near.join(v.select(c("vid").alias("other"), c("z").alias("oz")), "other").groupBy("vid").agg(F.avg("oz").alias("m"))
        v = v.join(mean, "vid").select("vid", (c("z") + step * (c("m") - c("z"))).alias("z"))
    return v.select("vid", F.round(c("z") + 1e-7, 3).alias("z"))


@query("vm_10_colour_laplacian", f"WITH {NEAR} SELECT v.vid, CAST(sum(o.r) // count(*) AS BIGINT) AS r FROM mesh_vertices v JOIN nb ON nb.vid = v.vid JOIN mesh_vertices o ON o.vid = nb.other GROUP BY v.vid")
def _(t):
    o = t("mesh_vertices").select(c("vid").alias("other"), "r")
    return around(t).join(o, "other").groupBy("vid").agg(F.floor(F.sum("r") / F.count("*")).alias("r"))


@query("vm_14_quality_laplacian", f"WITH {NEAR} SELECT v.vid, round((v.z + avg(o.z)) / 2, 5) AS q FROM mesh_vertices v JOIN nb ON nb.vid = v.vid JOIN mesh_vertices o ON o.vid = nb.other GROUP BY v.vid, v.z")
def _(t):
    o = t("mesh_vertices").select(c("vid").alias("other"), c("z").alias("oz"))
    s = around(t).join(o, "other").groupBy("vid").agg(F.avg("oz").alias("m"))
    return pick(t, "z").join(s, "vid").select("vid", F.round((c("z") + c("m")) / 2, 5).alias("q"))


# ---- sampling, clustering, distances over edges
@query("vps_14_all_vertices_and_centres", f"WITH {TRI} SELECT 0 AS kind, vid AS id, round(x, 4) AS x FROM mesh_vertices UNION ALL SELECT 1, fid, round((x0 + x1 + x2) / 3, 4) FROM tri")
def _(t):
    v = t("mesh_vertices").select(F.lit(0).alias("kind"), c("vid").alias("id"), r4(c("x")).alias("x"))
    return v.unionAll(tri(t).select(F.lit(1).alias("kind"), c("fid").alias("id"), r4((c("x0") + c("x1") + c("x2")) / 3).alias("x")))


@query("vo_48_grid_points", "SELECT CAST(floor(x / 3) AS BIGINT) AS a, CAST(floor(y / 3) AS BIGINT) AS b, CAST(floor(z / 3) AS BIGINT) AS k, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM mesh_vertices GROUP BY 1, 2, 3")
def _(t):
    cell = [F.floor(c(a) / 3).alias(o) for a, o in zip("xyz", "abk", strict=True)]
    return t("mesh_vertices").groupBy(*cell).agg(F.count("*").alias("n"), *(r4(F.avg(a)).alias(a) for a in "xyz"))


@query("vo_40_points_in_box", "SELECT vid FROM mesh_vertices WHERE x >= 2 AND x <= 8.5 AND y >= 3 AND y <= 30 AND z >= 0.5 AND z <= 4")
def _(t):
    return t("mesh_vertices").where("x BETWEEN 2 AND 8.5 AND y BETWEEN 3 AND 30 AND z BETWEEN 0.5 AND 4").select("vid")


@query("vg_05_steps_from_border", None)
def _(t):
    """(vid, steps): edges to the nearest border vertex, a level at a time."""
    from ..tables import materialise

    near = materialise(around(t), "near")
    front = materialise(M.boundary_vertices(t("mesh_faces")).withColumn("steps", F.lit(0)), "steps")
    seen, step = [front], 0
    while True:
        step += 1
        new = near.join(front.select(c("vid").alias("other")), "other", "left_semi").select("vid").distinct()
        for s in seen[-2:]:  # neighbours lie at most one step apart
            new = new.join(s.select("vid"), "vid", "left_anti")
        front = materialise(new.withColumn("steps", F.lit(step)), "steps")
        if not front.limit(1).count():
            break
        seen.append(front)
    out = seen[0]
    for s in seen[1:]:
        out = out.unionAll(s)
    return out
