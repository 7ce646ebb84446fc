"""Operators on indexed meshes: vertices (vid, x, y, z, ...), faces (fid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def gather(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates x0 .. z2: three equi joins on the vertex id."""
    out = faces
    for k in range(3):
        corner = vertices.select(F.col("vid").alias(f"v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))
        out = out.join(corner, f"v{k}")
    return out


def corners(faces: DataFrame) -> DataFrame:
    """(fid, k, vid): one row per face and corner."""
    return faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))


def edges(faces: DataFrame) -> DataFrame:
    """Directed edges (fid, a, b) of each face."""
    pairs = F.array(*(F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return faces.select("fid", F.explode(pairs).alias("e")).select("fid", "e.a", "e.b")


def undirected(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select("fid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def drop_degenerate(triangles: DataFrame) -> DataFrame:
    """Without triangles two of whose corners share a position."""
    same = lambda i, j: (F.col(f"x{i}") == F.col(f"x{j}")) & (F.col(f"y{i}") == F.col(f"y{j}")) & (F.col(f"z{i}") == F.col(f"z{j}"))
    return triangles.where(~(same(0, 1) | same(0, 2) | same(1, 2)))


def face_normal(triangles: DataFrame) -> DataFrame:
    """triangles with the unnormalised normal (nx, ny, nz)."""
    p = [G.vec(suffix=str(k)) for k in range(3)]
    n = G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0]))
    return triangles.withColumns(dict(zip(("nx", "ny", "nz"), n, strict=True)))


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): sums of the normals of the faces around, so larger faces weigh more."""
    n = face_normal(triangles)
    return n.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), "nx", "ny", "nz").groupBy("vid").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz")))


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges of one face only."""
    return undirected(edges(faces)).groupBy("a", "b").agg(F.count("*").alias("faces")).where("faces = 1").select("a", "b")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    """Vertices where the signed ids of outgoing and incoming edge ends don't cancel."""
    e = edges(faces)
    signed = e.select(F.col("a").alias("vid"), F.col("b").alias("s")).unionAll(e.select(F.col("b").alias("vid"), (-F.col("a")).alias("s")))
    return signed.groupBy("vid").agg(F.sum("s").alias("s")).where("s <> 0").select("vid")


def adjacency(faces: DataFrame) -> DataFrame:
    """(f, g, a, b): faces on both sides of an edge, f < g; an edge of more faces pairs none."""
    u = undirected(edges(faces)).groupBy("a", "b").agg(F.min("fid").alias("f"), F.max("fid").alias("g"), F.count("*").alias("n"))
    return u.where("n = 2").select("f", "g", "a", "b")


def border_vertices(triangles: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Vertices of faces that have a corner outside the box."""
    inside = [G.in_box(G.vec(suffix=str(k)), low, high) for k in range(3)]
    out = triangles.where(~(inside[0] & inside[1] & inside[2]))
    return out.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()


def lock(triangles: DataFrame, low: tuple, high: tuple) -> DataFrame:
    inside = [G.in_box(G.vec(suffix=str(k)), low, high) for k in range(3)]
    return triangles.select("fid", (~(inside[0] & inside[1] & inside[2])).alias("locked"))


def merge_vertices(vertices: DataFrame) -> DataFrame:
    """(vid, to): vertices of equal position become the one of smallest id.

    The smallest id per position is an aggregate with a map-side part, then joined back.
    """
    least = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("to"))
    return vertices.select("vid", "x", "y", "z").join(least, ["x", "y", "z"]).select("vid", "to")


def edge_error(triangles: DataFrame) -> DataFrame:
    """Root mean square of edge lengths."""
    p = [G.vec(suffix=str(k)) for k in range(3)]
    e2 = F.array(G.distance2(p[0], p[1]), G.distance2(p[1], p[2]), G.distance2(p[2], p[0]))
    return triangles.select(F.explode(e2).alias("e2")).agg(F.sqrt(F.avg("e2")).alias("error"))


def measures(triangles: DataFrame) -> DataFrame:
    """Area, and the signed volume of a closed mesh."""
    p = [G.vec(suffix=str(k)) for k in range(3)]
    n = G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0]))
    return triangles.agg(F.sum(G.norm(n) / 2).alias("area"), F.sum(G.dot(p[0], G.cross(p[1], p[2])) / 6).alias("volume"))


def cluster(triangles: DataFrame, cell: float) -> DataFrame:
    """Vertex clustering: (c0, c1, c2) cells of triangles over three cells, each set of cells once."""
    key = lambda k: F.concat_ws(":", *(F.floor(F.col(f"{c}{k}") / cell).cast("string") for c in "xyz"))
    t = triangles.select(F.array_sort(F.array(key(0), key(1), key(2))).alias("c"))
    t = t.select(*(F.element_at("c", k + 1).alias(f"c{k}") for k in range(3)))
    return t.where("c0 <> c1 AND c1 <> c2").distinct()
