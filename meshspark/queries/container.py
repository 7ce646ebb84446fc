"""The container, written and read again; level-of-detail builds."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import nodes as N
from ..operators.prefix import running
from ..plans import build as B
from ..sources import container as S
from ..sources import meshes as M
from ..sources.lines import scratch
from ..tables import materialise
from . import query

c = F.col
LOCAL = "l AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY vid) - 1 AS i FROM node_vertices)"
SIZES = f"s AS (SELECT v.node, nvert, nface, ((nvert * 22 + nface * 6 + 255) // 256) * 256 AS size FROM (SELECT node, count(*) AS nvert FROM node_vertices GROUP BY node) v JOIN (SELECT node, count(*) AS nface FROM node_faces GROUP BY node) f ON f.node = v.node)"
INDEX = f"{SIZES}, n AS (SELECT count(*) AS nodes, sum(nvert) AS v, sum(nface) AS f FROM s), h AS (SELECT ((88 + 44 * (nodes + 1) + 12 * 2 * nodes + 255) // 256) * 256 AS start FROM n)"
real = lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"


def local(t):
    """(vertices, faces) of each node with numbers of their own."""
    v = t("node_vertices").withColumn("i", F.row_number().over(W.partitionBy("node").orderBy("vid")) - 1)  # a node is bounded
    f = t("node_faces").select("node", "fid", "v0", "v1", "v2")
    for k in range(3):
        f = f.join(v.select("node", c("vid").alias(f"v{k}"), c("i").alias(f"w{k}")), ["node", f"v{k}"])
    f = f.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("fid")) - 1)
    return v, f.select("node", c("k").alias("fid"), "w0", "w1", "w2")


def written(t) -> str:
    v, f = local(t)
    count = t("node_faces").groupBy("node").agg(F.count("*").alias("nface"))
    sphere = t("node_vertices").groupBy("node").agg(*(((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"), (F.max("y") - F.min("y")).alias("radius"))
    nodes = sphere.withColumns({"error": 1000.0 / (1 + c("node")), "tight_radius": c("radius") / 2, **{f"n{k}": c("node") % 100 + k for k in range(4)}})
    n = nodes.count()
    patches = count.select(c("node").alias("src"), F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), F.least(c("node") + 1, F.lit(n)).alias("dst"), F.floor(c("nface") / 2).alias("tri_end")), F.struct(F.lit(1).alias("ordinal"), F.lit(n).cast("long").alias("dst"), c("nface").alias("tri_end")))).alias("p")).select("src", "p.*", F.when(c("src") % 3 == 0, c("src")).alias("texture"))
    path = scratch(v.sparkSession, "model")
    name = path if urlparse(path).scheme else f"file://{path}"
    vertices = v.select("node", c("i").alias("vid"), *"xyz", "nx", "ny", "nz", *"rgb", F.lit(255).alias("a"))
    folder_of(name)
    S.write_container(name, nodes, patches, vertices, f.select("node", "fid", *(c(f"w{k}").alias(f"v{k}") for k in range(3))))
    return name


def folder_of(name: str) -> None:
    import os

    os.makedirs(os.path.dirname(urlparse(name).path), exist_ok=True)


def table(t, name: str):
    return S.read_container(t("region").sparkSession, written(t), name)


@query("src_16_container_header", f"WITH {INDEX} SELECT 2 AS version, CAST(v AS BIGINT) AS nvert, CAST(f AS BIGINT) AS nface, true AS normals, true AS colours, false AS uv, nodes + 1 AS n_nodes, 2 * nodes AS n_patches FROM n")
def _(t):
    return table(t, "header").select("version", "nvert", "nface", "normals", "colours", "uv", "n_nodes", "n_patches")


@query("src_17_container_nodes", f"WITH {INDEX} SELECT s.node, CAST(start + sum(size) OVER (ORDER BY s.node) - size AS BIGINT) AS \"offset\", CAST(size AS BIGINT) AS size, nvert, nface, {real('1000.0 / (1 + s.node)')} AS error, s.node % 100 AS n0, CAST(2 * s.node AS BIGINT) AS first_patch, CAST(2 * s.node + 2 AS BIGINT) AS last_patch FROM s, h")
def _(t):
    return table(t, "nodes").select("node", "offset", "size", "nvert", "nface", c("error").cast("double").alias("error"), "n0", "first_patch", "last_patch")


@query("src_17_container_patches", f"WITH {INDEX} SELECT 2 * s.node + o AS patch, s.node AS src, o AS ordinal, CASE WHEN o = 0 THEN least(s.node + 1, nodes) ELSE nodes END AS dst, CASE WHEN o = 0 THEN 0 ELSE nface // 2 END AS tri_begin, CASE WHEN o = 0 THEN nface // 2 ELSE nface END AS tri_end, CASE WHEN s.node % 3 = 0 THEN s.node END AS texture FROM s, n, range(2) r(o)")
def _(t):
    return table(t, "patches")


@query("src_18_container_vertices", f"WITH {LOCAL} SELECT node, i AS vid, {', '.join(f'{real(a)} AS {a}' for a in 'xyz')}, nx, ny, nz, r, g, b, 255 AS a FROM l")
def _(t):
    return table(t, "vertices").select("node", "vid", *(c(a).cast("double").alias(a) for a in "xyz"), "nx", "ny", "nz", *"rgba")


@query("src_18_container_faces", f"WITH {LOCAL} SELECT f.node, row_number() OVER (PARTITION BY f.node ORDER BY f.fid) - 1 AS fid, a.i AS v0, b.i AS v1, k.i AS v2 FROM node_faces f JOIN l a ON a.node = f.node AND a.vid = f.v0 JOIN l b ON b.node = f.node AND b.vid = f.v1 JOIN l k ON k.node = f.node AND k.vid = f.v2")
def _(t):
    return table(t, "faces")


@query("src_23_container_one_node", "SELECT node, count(*) AS n FROM node_vertices WHERE node = 0 GROUP BY node")
def _(t):
    """Only the nodes asked for are read where the session pushes filters into Python sources."""
    return table(t, "vertices").where("node = 0").groupBy("node").agg(F.count("*").alias("n"))


def exported(t, used_only: bool):
    """The nodes' meshes as one PLY file: vertices of all nodes one behind the other, faces shifted by what is before."""
    name = written(t)
    spark = t("region").sparkSession
    v, f = (S.read_container(spark, name, x) for x in ("vertices", "faces"))
    f = f.where("fid % 2 = 0") if used_only else f
    if used_only:
        v = v.join(f.select("node", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct(), ["node", "vid"], "left_semi")
    numbered = running(v, ["node", "vid"], number="n").withColumn("n", c("n") - 1)
    for k in range(3):
        f = f.join(numbered.select("node", c("vid").alias(f"v{k}"), c("n").alias(f"w{k}")), ["node", f"v{k}"])
    faces = running(f, ["node", "fid"], number="i").select((c("i") - 1).alias("fid"), *(c(f"w{k}").alias(f"v{k}") for k in range(3)))
    path = scratch(spark, "extract") + ".ply"
    M.write_ply(numbered.select(c("n").alias("vid"), *(c(a).cast("double").alias(a) for a in "xyz"), *"rgb"), faces, path)
    return M.read_ply_text(spark, path)


NUMBERED = f"{LOCAL}, g AS (SELECT node, vid, x, y, z, r, row_number() OVER (ORDER BY node, i) - 1 AS n FROM l)"


@query("snk_03_ply_of_nodes", f"WITH {NUMBERED} SELECT n AS vid, x, y, {real('z')} AS z, r FROM g")
def _(t):
    return exported(t, False)[0].select("vid", *"xyz", "r")


@query("snk_03_ply_faces_of_nodes", f"WITH {NUMBERED} SELECT row_number() OVER (ORDER BY f.node, f.fid) - 1 AS fid, a.n AS v0, b.n AS v1, k.n AS v2 FROM node_faces f JOIN g a ON a.node = f.node AND a.vid = f.v0 JOIN g b ON b.node = f.node AND b.vid = f.v1 JOIN g k ON k.node = f.node AND k.vid = f.v2")
def _(t):
    return exported(t, False)[1]


@query("snk_04_unified_ply", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY fid) - 1 AS i FROM node_faces), e AS (SELECT * FROM f WHERE i % 2 = 0),
u AS (SELECT node, v0 AS vid FROM e UNION SELECT node, v1 FROM e UNION SELECT node, v2 FROM e), g AS (SELECT node, vid, row_number() OVER (ORDER BY node, vid) - 1 AS n FROM u)
SELECT row_number() OVER (ORDER BY e.node, e.i) - 1 AS fid, a.n AS v0, b.n AS v1, k.n AS v2 FROM e JOIN g a ON a.node = e.node AND a.vid = e.v0 JOIN g b ON b.node = e.node AND b.vid = e.v1 JOIN g k ON k.node = e.node AND k.vid = e.v2""")
def _(t):
    """Only vertices that a kept face uses."""
    return exported(t, True)[1]


# ---- builds: the fixture mesh in cells of 400 triangles
soup = lambda t: t("node_faces").select(*B.CORNERS)


@query("msh_02_cells_in_capacity", "SELECT CAST(count(*) AS BIGINT) AS triangles, count(*) > 400 AS parted, 0 AS over FROM mesh_faces")
def _(t):
    """All triangles are in cells, and no cell holds more than its capacity."""
    cells = B.partition(soup(t), 400)[0].groupBy("cell").agg(F.count("*").alias("n"))
    return cells.agg(F.sum("n").alias("triangles"), (F.count("*") > 1).alias("parted"), F.sum((c("n") > 400).cast("int")).alias("over"))


@query("msh_01_cells_hold_all", "SELECT count(*) AS triangles, 0 AS outside FROM mesh_faces")
def _(t):
    """Every triangle is in one cell, and has a corner in its box."""
    at, boxes = B.partition(soup(t), 400)
    inside = B._inside(0) | B._inside(1) | B._inside(2)
    return at.join(boxes, "cell").agg(F.count("*").alias("triangles"), F.sum(F.when(inside, 0).otherwise(1)).alias("outside"))


@query("msh_10_build_nodes", None)
def _(t):
    return B.build(soup(t), 400, 100).nodes


@query("msh_11_build_patches", None)
def _(t):
    return B.build(soup(t), 400, 100).patches


@query("msh_11_finest_level_is_whole", "SELECT count(*) AS faces FROM mesh_faces")
def _(t):
    return B.build(soup(t), 400, 100).nodes.where("level = 0").agg(F.sum("nface").alias("faces"))


@query("msh_11_patches_cover_nodes", "SELECT true AS levels, CAST(count(*) AS BIGINT) AS finest, 0 AS uncovered FROM mesh_faces")
def _(t):
    """Above the finest level each node's faces all came from nodes below; the finest ones came from none."""
    g = B.build(soup(t), 400, 100)
    from_below = g.patches.groupBy(c("src").alias("node")).agg(F.sum("nface").alias("n"))
    met = g.nodes.join(from_below, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    finest, wrong = F.when(c("level") == 0, c("nface") - c("n")), F.when(c("level") > 0, (c("n") != c("nface")).cast("int"))
    return met.agg((F.max("level") > 0).alias("levels"), F.sum(finest).alias("finest"), F.coalesce(F.sum(wrong), F.lit(0)).alias("uncovered"))


@query("msh_12_locked_borders", "SELECT count(*) > 400 AS borders, 0 AS missing FROM mesh_faces")
def _(t):
    """Vertices of faces that cross a cell's border are still there after simplification."""
    at, boxes = B.partition(soup(t), 400)
    inside = B._inside(0) & B._inside(1) & B._inside(2)
    point = lambda df: df.select(F.explode(F.array(*(F.struct(*(c(f"{a}{k}").alias(a) for a in "xyz")) for k in range(3)))).alias("p")).select("p.*").distinct()
    border = point(at.join(boxes, "cell").where(~inside))
    kept = point(B.simplified(at, boxes, 0.5)).withColumn("kept", F.lit(1))
    return border.join(kept, [*"xyz"], "left").agg((F.count("*") > 0).alias("borders"), F.coalesce(F.sum(c("kept").isNull().cast("int")), F.lit(0)).alias("missing"))


@query("msh_13_simplified_counts", None)
def _(t):
    at, boxes = B.partition(soup(t), 400)
    return B.simplified(at, boxes, 0.5).groupBy("cell").agg(F.count("*").alias("nface"), F.max("error").alias("error"))


@query("agg_27_build_saturates", "SELECT true AS edges, 0 AS by_error, 0 AS by_sphere")
def _(t):
    """A built graph, saturated, has no child of as much error as its parent, and none that reaches out of it."""
    g = B.build(soup(t), 400, 100)
    corners = g.faces.select("node", F.explode(F.array(*(F.struct(*(c(f"{a}{k}").alias(a) for a in "xyz")) for k in range(3)))).alias("p")).select("node", "p.*")
    edges = materialise(g.patches.withColumn("ordinal", F.row_number().over(W.partitionBy("src").orderBy("dst"))), "edges")  # a node is bounded
    s = N.saturated(g.nodes.join(N.spheres(corners), "node"), edges)
    a, b = (s.select(c("node").alias(x), *(c(k).alias(f"{k}_{x}") for k in ("error", "cx", "cy", "cz", "radius"))) for x in ("src", "dst"))
    apart = F.sqrt(sum((c(f"c{k}_src") - c(f"c{k}_dst")) ** 2 for k in "xyz"))
    out = (apart + c("radius_dst") > c("radius_src")).cast("int")
    return edges.join(a, "src").join(b, "dst").agg((F.count("*") > 0).alias("edges"), F.coalesce(F.sum((c("error_dst") >= c("error_src")).cast("int")), F.lit(0)).alias("by_error"), F.coalesce(F.sum(out), F.lit(0)).alias("by_sphere"))
