"""Quadrics of plane distances: a symmetric matrix in six columns, a vector in three, a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .mesh import face_normal

PARTS = ("xx", "xy", "xz", "yy", "yz", "zz", "x", "y", "z", "one")


def of_plane(n: G.Vector, d: Column) -> dict[str, Column]:
    """The squared distance to n * p + d = 0."""
    v = (*n, d)
    at = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (0, 3), (1, 3), (2, 3), (3, 3))
    return {f"q_{name}": v[i] * v[j] for name, (i, j) in zip(PARTS, at, strict=True)}


def vertex_quadrics(faces: DataFrame) -> DataFrame:
    """(vid, q_...): sums over the faces around of their planes' quadrics; faces (v0 .. v2, x0 .. z2)."""
    n = face_normal(faces)
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    unit = n.withColumn("_l", size).where("_l > 0").withColumns({c: F.col(c) / F.col("_l") for c in ("nx", "ny", "nz")})
    normal = (F.col("nx"), F.col("ny"), F.col("nz"))
    made = of_plane(normal, -G.dot(normal, G.vec(suffix="0")))
    rows = unit.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), *(v.alias(k) for k, v in made.items()))
    return rows.groupBy("vid").agg(*(F.sum(k).alias(k) for k in made))


def apply(p: G.Vector) -> Column:
    """The quadric's value at a point."""
    x, y, z = p
    q = {k: F.col(f"q_{k}") for k in PARTS}
    square = q["xx"] * x * x + q["yy"] * y * y + q["zz"] * z * z
    mixed = q["xy"] * x * y + q["xz"] * x * z + q["yz"] * y * z + q["x"] * x + q["y"] * y + q["z"] * z
    return square + 2 * mixed + q["one"]


def minimum(least: float = 1e-6) -> G.Vector:
    """The one point of least value (Cramer's rule); null where the matrix is near singular."""
    q = {k: F.col(f"q_{k}") for k in PARTS}
    rows = [(q["xx"], q["xy"], q["xz"]), (q["xy"], q["yy"], q["yz"]), (q["xz"], q["yz"], q["zz"])]
    right = (-q["x"], -q["y"], -q["z"])
    det = G.dot(rows[0], G.cross(rows[1], rows[2]))
    out = []
    for k in range(3):
        cols = [tuple(r[j] if j != k else right[i] for j in range(3)) for i, r in enumerate(rows)]
        out.append(F.when(F.abs(det) > least, G.dot(cols[0], G.cross(cols[1], cols[2])) / det))
    return tuple(out)
