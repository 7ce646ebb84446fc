"""Eigenvalues and eigenvectors of symmetric 3 x 3 matrices as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from .intersect import clamp, let

CELLS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _times(r: Column, v: G.Vector) -> G.Vector:
    return r["xx"] * v[0] + r["xy"] * v[1] + r["xz"] * v[2], r["xy"] * v[0] + r["yy"] * v[1] + r["yz"] * v[2], r["xz"] * v[0] + r["yz"] * v[1] + r["zz"] * v[2]


def _parts(v: Column) -> G.Vector:
    return tuple(v[c] for c in "xyz")


def _vector(v: G.Vector) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(v, "xyz", strict=True)))


def symmetric(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """An array of three structs (value, vector of x, y, z), values rising, vectors of length one and at right angles.

    The value that stands apart comes from the characteristic polynomial, its vector from a cross product of rows; the
    other two from a rotation in the plane across it, so equal values do no harm.  A matrix with a null has none.
    """

    def spread(r: Column) -> Column:
        mean = (r["xx"] + r["yy"] + r["zz"]) / 3
        diagonal = [r[k] - mean for k in ("xx", "yy", "zz")]
        square = sum((d * d for d in diagonal), F.lit(0.0)) + 2 * (r["xy"] * r["xy"] + r["xz"] * r["xz"] + r["yz"] * r["yz"])
        return let(apart, **{k: r[k] for k in CELLS}, mean=mean, size=F.sqrt(square / 6))

    def apart(r: Column) -> Column:
        a, b, d = (F.coalesce(F.try_divide(r[k] - r["mean"], r["size"]), F.lit(0.0)) for k in ("xx", "yy", "zz"))
        p, q, s = (F.coalesce(F.try_divide(r[k], r["size"]), F.lit(0.0)) for k in ("xy", "xz", "yz"))
        half = (a * (b * d - s * s) - p * (p * d - s * q) + q * (p * s - b * q)) / 2
        angle = F.acos(clamp(half, -1.0, 1.0)) / 3
        value = r["mean"] + 2 * r["size"] * F.when(half >= 0, F.cos(angle)).otherwise(F.cos(angle + 2 * math.pi / 3))
        return let(axis, **{k: r[k] for k in CELLS}, value=value)

    def axis(r: Column) -> Column:
        rows = [(r["xx"] - r["value"], r["xy"], r["xz"]), (r["xy"], r["yy"] - r["value"], r["yz"]), (r["xz"], r["yz"], r["zz"] - r["value"])]
        across = [G.cross(rows[i], rows[k]) for i, k in ((0, 1), (0, 2), (1, 2))]
        return let(frame, **{k: r[k] for k in CELLS}, best=F.array_max(F.array(*(F.struct(G.dot(v, v).alias("n"), _vector(v).alias("v")) for v in across))))

    def frame(r: Column) -> Column:
        size = F.sqrt(r["best"]["n"])
        unit = tuple(F.coalesce(F.try_divide(v, size), F.lit(float(c == "z"))) for v, c in zip(_parts(r["best"]["v"]), "xyz", strict=True))
        return let(plane, **{k: r[k] for k in CELLS}, v=_vector(unit))

    def plane(r: Column) -> Column:
        x, y, z = _parts(r["v"])
        flat = F.abs(x) > F.abs(y)
        u = tuple(F.when(flat, p).otherwise(q) for p, q in zip((-z, F.lit(0.0), x), (F.lit(0.0), z, -y), strict=True))
        return let(turned, **{k: r[k] for k in CELLS}, v=r["v"], u=_vector(tuple(c / G.norm(u) for c in u)))

    def turned(r: Column) -> Column:
        v, u = _parts(r["v"]), _parts(r["u"])
        w = G.cross(v, u)
        return let(pairs, v=r["v"], u=r["u"], w=_vector(w), own=G.dot(v, _times(r, v)), a=G.dot(u, _times(r, u)), b=G.dot(u, _times(r, w)), d=G.dot(w, _times(r, w)))

    def pairs(r: Column) -> Column:
        return let(made, **{k: r[k] for k in ("v", "u", "w", "own", "a", "b", "d")}, turn=F.atan2(2 * r["b"], r["a"] - r["d"]) / 2)

    def made(r: Column) -> Column:
        c, s, u, w = F.cos(r["turn"]), F.sin(r["turn"]), _parts(r["u"]), _parts(r["w"])
        high = r["a"] * c * c + 2 * r["b"] * s * c + r["d"] * s * s
        low = r["a"] * s * s - 2 * r["b"] * s * c + r["d"] * c * c
        pair = lambda value, v: F.struct(value.alias("value"), v.alias("vector"))
        return F.array_sort(F.array(pair(r["own"], r["v"]), pair(high, _vector(tuple(p * c + q * s for p, q in zip(u, w, strict=True)))), pair(low, _vector(tuple(q * c - p * s for p, q in zip(u, w, strict=True))))))

    cells = {k: v.cast("double") for k, v in zip(CELLS, (xx, xy, xz, yy, yz, zz), strict=True)}
    null = F.lit(False)
    for v in cells.values():
        null = null | v.isNull()
    return F.when(~null, let(spread, **cells))
