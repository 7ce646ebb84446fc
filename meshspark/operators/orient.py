"""Coherent orientation of surfaces, and which side is out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.dag import components
from ..tables import materialise
from .mesh import edges, gather

# The directions in which extremes vote, and the cosine of 85 degrees.
DIRECTIONS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (-1, 1, 1), (-1, -1, 1), (1, -1, 1))
COS_85 = 0.08715574274765817


def dual(faces: DataFrame) -> DataFrame:
    """(f, g, same): faces beside each other, f < g, and whether both run along their edge the same way.

    An edge of more or fewer than two faces joins none.
    """
    e = edges(faces).where("a <> b")
    u = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.min("fid").alias("f"), F.max("fid").alias("g"), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).alias("up"))
    return u.where("n = 2 AND f <> g").select("f", "g", (F.col("up") != 1).alias("same"))


def orient(faces: DataFrame) -> DataFrame:
    """(fid, v0, v1, v2, flipped, component, orientable): all faces of a component turn as its first one does.

    Every face stands for two nodes, as it is (2 * fid) and flipped (2 * fid + 1); faces beside each other join
    those that go together.  Where a face's two nodes come into one component of this doubled graph the surface
    has one side only: `orientable` is false and its faces stay.  fid must not be negative or beyond 2 ** 62.
    component: the least fid of faces that hang together over edges of two faces.
    """
    d = dual(faces)
    turn = F.when(F.col("same"), 1).otherwise(0)
    joined = d.select((F.col("f") * 2).alias("a"), (F.col("g") * 2 + turn).alias("b")).unionAll(d.select((F.col("f") * 2 + 1).alias("a"), (F.col("g") * 2 + 1 - turn).alias("b")))
    comp = components(joined)
    of = comp.groupBy(F.floor(F.col("id") / 2).alias("fid")).agg(F.min(F.when(F.col("id") % 2 == 0, F.col("comp"))).alias("own"), F.min(F.when(F.col("id") % 2 == 1, F.col("comp"))).alias("other"))
    out = faces.select("fid", "v0", "v1", "v2").join(of, "fid", "left")
    out = out.withColumns({"own": F.coalesce("own", F.col("fid") * 2), "other": F.coalesce("other", F.col("fid") * 2 + 1)})
    flipped = F.col("own") > F.col("other")
    return out.select("fid", "v0", F.when(flipped, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(flipped, F.col("v1")).otherwise(F.col("v2")).alias("v2"), flipped.alias("flipped"), F.floor(F.least("own", "other") / 2).alias("component"), (F.col("own") != F.col("other")).alias("orientable"))


def _unit_normals(sums: DataFrame, *kept: str) -> DataFrame:
    length = G.norm(tuple(F.col(f"n{x}") for x in "xyz"))
    return sums.withColumn("_l", length).select(*kept, *(F.coalesce(F.try_divide(F.col(f"n{x}"), F.col("_l")), F.lit(0.0)).alias(f"n{x}") for x in "xyz"))


def _angle_rows(triangles: DataFrame, *kept: str) -> DataFrame:
    """(*kept, vid, x, y, z, nx, ny, nz, firm): each corner with its face's unit normal times the angle there; without normal where the face has no area."""
    p = [G.vec(suffix=str(k)) for k in range(3)]
    normal = tuple(F.col(f"_n{x}") for x in "xyz")
    # In steps, as each would be copied into all that use it.
    t = triangles.withColumns({f"_n{x}": c for x, c in zip("xyz", G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0])), strict=True)}).withColumn("_size", G.norm(normal))
    angles = {}
    for k in range(3):
        u, v = G.sub(p[(k + 1) % 3], p[k]), G.sub(p[(k + 2) % 3], p[k])
        cos = F.try_divide(G.dot(u, v), G.norm(u) * G.norm(v))
        angles[f"_angle{k}"] = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    t = t.withColumns({f"_u{x}": F.try_divide(c, F.col("_size")) for x, c in zip("xyz", normal, strict=True)} | angles)
    firm = F.col("_size") > 0
    rows = [F.struct(F.col(f"v{k}").alias("vid"), *(c.alias(x) for c, x in zip(p[k], "xyz", strict=True)), *(F.when(firm, F.col(f"_u{x}") * F.col(f"_angle{k}")).alias(f"n{x}") for x in "xyz"), firm.alias("firm")) for k in range(3)]
    return t.select(*kept, F.explode(F.array(*rows)).alias("r")).select(*kept, "r.*")


def angle_normals(triangles: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): unit sums of face normals weighted by the faces' angles there; degenerate faces don't count."""
    return _unit_normals(_angle_rows(triangles).where("firm").groupBy("vid").agg(*(F.sum(f"n{x}").alias(f"n{x}") for x in "xyz")), "vid")


def outward_votes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(component, votes, inside_out) of oriented faces (fid, v0, v1, v2, component).

    In seven directions the first and last vertex of a component vote against its orientation if their normal
    points back by more than 5 degrees from the side; three votes and more mean that it is inside out.  One
    pass over the corners and aggregates with a map-side part; ties go to the lower vid.
    """
    n = [f"n{x}" for x in "xyz"]
    each = _angle_rows(gather(faces, vertices), "component").groupBy("component", "vid").agg(*(F.first(x).alias(x) for x in "xyz"), *(F.sum(x).alias(x) for x in n), F.max("firm").alias("firm"))
    here = W.partitionBy("vid")  # a vertex has as many rows as components
    whole = each.select("component", "vid", *"xyz", *(F.sum(x).over(here).alias(x) for x in n), F.max("firm").over(here).alias("firm")).where("firm")
    corner = _unit_normals(whole, "component", "vid", *"xyz")
    aggs = []
    for i, d in enumerate(DIRECTIONS):
        size = sum(v * v for v in d) ** 0.5
        unit = tuple(F.lit(v / size) for v in d)
        along, facing = G.dot(G.vec(), unit), G.dot(tuple(F.col(f"n{x}") for x in "xyz"), unit)
        aggs += [F.min_by(facing, F.struct(along, "vid")).alias(f"low{i}"), F.max_by(facing, F.struct(along, -F.col("vid"))).alias(f"high{i}")]
    ends = corner.groupBy("component").agg(*aggs)
    votes = sum((F.when(F.col(f"low{i}") > COS_85, 1).otherwise(0) + F.when(F.col(f"high{i}") < -COS_85, 1).otherwise(0) for i in range(len(DIRECTIONS))), F.lit(0))
    return ends.select("component", votes.alias("votes"), (votes >= len(DIRECTIONS) // 2).alias("inside_out"))


def outward(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Oriented faces (see orient) with the components that are inside out flipped once more."""
    faces = materialise(faces, "oriented")
    votes = outward_votes(faces, vertices).select("component", "inside_out")
    met = faces.join(votes, "component", "left")
    turn = F.coalesce("inside_out", F.lit(False))
    return met.select("fid", "v0", F.when(turn, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(turn, F.col("v1")).otherwise(F.col("v2")).alias("v2"), (F.col("flipped") != turn).alias("flipped"), "component", "orientable")
