"""Principal curvatures of a mesh from the bends of its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import eigen
from ..functions import geometry as G
from ..functions.intersect import clamp
from .mesh import edges, face_normal, gather, vertex_normals

N = ("nx", "ny", "nz")


def bends(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, bend, length, ex, ey, ez) of every edge of two faces that turn alike: the angle from one to the other, up to a
    quarter turn, positive where the edge is convex as seen along the normals; its length and unit direction."""
    n = face_normal(gather(faces.select("fid", "v0", "v1", "v2"), vertices)).select("fid", *N)
    size = G.norm(tuple(map(F.col, N)))
    n = n.select("fid", *(F.try_divide(F.col(c), size).alias(c) for c in N))
    e = edges(faces).where("a <> b").join(n, "fid")
    up = F.col("a") < F.col("b")
    of = lambda cond, name: [F.max(F.when(cond, F.col(c))).alias(f"{name}{c[1]}") for c in N]
    both = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("faces"), F.sum(up.cast("int")).alias("up"), *of(up, "p"), *of(~up, "q"))
    side = lambda s: vertices.select(F.col("vid").alias(s), *(F.col(c).cast("double").alias(f"{s}{c}") for c in "xyz"))
    at = both.where("faces = 2 AND up = 1").join(side("a"), "a").join(side("b"), "b")
    d = G.sub(G.vec("b"), G.vec("a"))
    at = at.withColumn("length", G.norm(d)).where("length > 0")
    at = at.withColumns({f"e{c}": v / F.col("length") for c, v in zip("xyz", d, strict=True)})
    turn = G.dot(G.cross(G.vec("p"), G.vec("q")), G.vec("e"))
    return at.select("a", "b", F.asin(clamp(turn, -1.0, 1.0)).alias("bend"), "length", "ex", "ey", "ez").where("bend IS NOT NULL")


def tensors(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, xx .. zz): bend x length x direction x direction, summed over the edges at each vertex."""
    b = bends(faces, vertices)
    weight = F.col("bend") * F.col("length")
    cells = b.select(F.explode(F.array("a", "b")).alias("vid"), *((weight * F.col(f"e{k[0]}") * F.col(f"e{k[1]}")).alias(k) for k in eigen.CELLS))
    return cells.groupBy("vid").agg(*(F.sum(k).alias(k) for k in eigen.CELLS))


def principal(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, k1, k2, d1, d2): curvatures and their directions (x, y, z), by normal cycles over the edges at a vertex.

    k1 and k2 are the two greater eigenvalues of the vertex's tensor (not divided by an area).  The direction most along the
    vertex's normal is left out; of the other two the one of greater absolute value is d1, of equal ones the greater value's.
    Where d2's value equals the one left out (as on a cylinder) d2 is turned in their plane until it is across the normal.
    A bend is told across its edge, so the greater value's direction lies along the ridge.  Vertices without an edge of two
    faces with area have no row; flat ones have zeros.
    """
    t = tensors(faces, vertices).join(vertex_normals(gather(faces.select("fid", "v0", "v1", "v2"), vertices)), "vid")
    t = t.select("vid", *N, eigen.symmetric(*(F.col(k) for k in eigen.CELLS)).alias("e"))
    along = lambda p: F.abs(p["vector"]["x"] * F.col("nx") + p["vector"]["y"] * F.col("ny") + p["vector"]["z"] * F.col("nz"))
    place = F.transform("e", lambda p, i: F.struct(along(p).alias("along"), (-i).alias("i")))
    t = t.withColumn("out", -F.array_max(place)["i"])
    rest = F.filter("e", lambda p, i: i != F.col("out"))
    t = t.select("vid", *N, F.col("e")[2]["value"].alias("k1"), F.col("e")[1]["value"].alias("k2"), F.get("e", F.col("out"))["value"].alias("left"), rest.alias("r"))
    first = F.abs(F.col("r")[0]["value"]) > F.abs(F.col("r")[1]["value"])
    pick = lambda cond: F.when(cond, F.col("r")[0]).otherwise(F.col("r")[1])
    t = t.select("vid", *N, "k1", "k2", "left", pick(first).alias("p"), pick(~first).alias("q"))
    across = G.cross(tuple(F.col("p.vector")[c] for c in "xyz"), tuple(map(F.col, N)))
    size = G.norm(across)
    alike = (F.abs(F.col("q.value") - F.col("left")) <= 1e-9 * F.abs(F.col("p.value"))) & (size > 0)
    turned = F.struct(*(F.try_divide(v, size).alias(c) for v, c in zip(across, "xyz", strict=True)))
    return t.select("vid", "k1", "k2", F.col("p.vector").alias("d1"), F.when(alike, turned).otherwise(F.col("q.vector")).alias("d2"))
