"""A spatial join: which boxes, triangles and rays meet.

Everything is dealt into the cells of a grid that it touches; a cell with too many entries is cut into eight, again
and again, while its entries are mostly smaller than half a cell: beyond that a cut would copy more than it parts.  Two boxes may share several cells, but the lowest corner of what they have in common lies in one: there
the pair is made, so no pair comes twice and nothing is made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import intersect as X
from ..tables import apart, discard, materialise
from .mesh import gather

CELL = ["level", "cx", "cy", "cz"]
DEEPEST = 12  # a cell is cut this often at most


def with_boxes(triangles: DataFrame) -> DataFrame:
    """triangles (x0 .. z2) with min_x .. max_z."""
    made = {f"{n}_{c}": f(*(f"{c}{k}" for k in range(3))) for c in "xyz" for n, f in (("min", F.least), ("max", F.greatest))}
    return triangles.withColumns(made)


def cell_size(boxes: DataFrame) -> float:
    """Twice the mean longest side of the boxes, and as much as lets none touch more than 17 cells along a side."""
    longest = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))
    r = boxes.agg(F.avg(longest).alias("mean"), F.max(longest).alias("most")).first()
    return max(2 * (r["mean"] or 0.0), (r["most"] or 0.0) / 16) or 1.0


def _touched(boxes: DataFrame, size: float) -> DataFrame:
    out = boxes.withColumn("level", F.lit(0))
    for c in "xyz":
        out = out.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"min_{c}") / size), F.floor(F.col(f"max_{c}") / size))))
    return out


def cells(boxes: DataFrame, size: float, most: int = 256) -> DataFrame:
    """boxes (min_x .. max_z and more), a row per leaf cell (CELL) that they touch: cells of `size` / 2 ** level."""
    at, done = materialise(_touched(boxes, size), "cells"), []
    for _ in range(DEEPEST):
        longest = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))
        width = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level"))
        full = at.groupBy(*CELL).agg(F.count("*").alias("_n"), F.avg(longest).alias("_long")).where((F.col("_n") > most) & (F.col("_long") < width / 2)).select(*CELL)
        full = materialise(full, "full")
        if not full.limit(1).count():
            discard(full)
            break
        done.append(at.join(full, CELL, "left_anti"))
        part = at.join(full, CELL, "left_semi").withColumn("level", F.col("level") + 1)
        for c in "xyz":
            low = F.col(f"c{c}") * 2
            wall = (low + 1) * (F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level")))
            halves = F.array(F.when(F.col(f"min_{c}") < wall, low), F.when(F.col(f"max_{c}") >= wall, low + 1))
            part = part.withColumn(f"c{c}", F.explode(F.array_compact(halves)))
        at = materialise(part, "cells")
    for d in done:
        at = at.unionByName(d)
    return at


def pairs(at: DataFrame, size: float, key: str, payload: list[str]) -> DataFrame:
    """Pairs of entries (see cells) whose boxes meet, key_a < key_b, each once; columns end in _a and _b."""
    names = [key, *payload, *(f"{m}_{c}" for c in "xyz" for m in ("min", "max"))]
    side = lambda s: at.select(*CELL, *(F.col(n).alias(f"{n}_{s}") for n in names))
    width = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level"))
    meet: Column = F.col(f"{key}_a") < F.col(f"{key}_b")
    for c in "xyz":
        low = F.greatest(f"min_{c}_a", f"min_{c}_b")
        meet &= (F.col(f"min_{c}_a") <= F.col(f"max_{c}_b")) & (F.col(f"min_{c}_b") <= F.col(f"max_{c}_a"))
        meet &= F.floor(low / width) == F.col(f"c{c}")
    return side("a").join(side("b"), CELL).where(meet)


def overlapping(boxes: DataFrame, size: float | None = None, most: int = 256) -> DataFrame:
    """(a, b), a < b, of boxes (id, min_x .. max_z) that meet."""
    size = size or cell_size(boxes)
    return pairs(cells(boxes, size, most), size, "id", []).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _tri(s: str) -> tuple[G.Vector, G.Vector, G.Vector]:
    return tuple(tuple(F.col(f"{c}{k}_{s}") for c in "xyz") for k in range(3))


def _through(a: G.Vector, b: G.Vector, t: tuple) -> Column:
    """A segment passes a triangle's inside (not its border)."""
    e1, e2, d, w = G.sub(t[1], t[0]), G.sub(t[2], t[0]), G.sub(b, a), G.sub(a, t[0])
    p, q = G.cross(d, e2), G.cross(w, e1)
    det = G.dot(e1, p)
    inner = lambda r: (F.abs(r["det"]) > X.EPS) & (r["u"] > 1e-12) & (r["v"] > 1e-12) & (r["u"] + r["v"] < 1) & (r["t"] >= 0) & (r["t"] <= 1)
    return F.coalesce(X.let(inner, det=det, u=X.over(G.dot(w, p), det), v=X.over(G.dot(d, q), det), t=X.over(G.dot(e2, q), det)), F.lit(False))


def self_intersections(faces: DataFrame, vertices: DataFrame, size: float | None = None, most: int = 256) -> DataFrame:
    """(f, g), f < g: faces of a mesh that run through each other.

    Faces without a common vertex meet if an edge of one meets the other, or if they lie in one plane and share
    inner points.  Faces with one vertex in common meet if the opposite edge of one, drawn halfway to that vertex,
    passes the inside of the other; those with a common edge never do, those with the same three vertices always.
    """
    tri = with_boxes(gather(faces, vertices).where("v0 <> v1 AND v1 <> v2 AND v0 <> v2"))
    corners = [f"{c}{k}" for k in range(3) for c in "xyz"]
    size = size or cell_size(tri)
    at = cells(tri.select("fid", "v0", "v1", "v2", *corners, *(f"{m}_{c}" for c in "xyz" for m in ("min", "max"))), size, most)
    p = pairs(at, size, "fid", ["v0", "v1", "v2", *corners])
    ids = lambda s: F.array(*(F.col(f"v{k}_{s}") for k in range(3)))
    p = p.withColumn("_same", F.size(F.array_intersect(ids("a"), ids("b"))))
    a, b = _tri("a"), _tri("b")
    apart = X.triangle_triangle(a, b) | (X.coplanar(a, b) & X.coplanar_overlap(a, b))
    one = F.lit(False)
    for s, other, x, y in (("a", "b", a, b), ("b", "a", b, a)):
        for k in range(3):
            shared = F.array_contains(ids(other), F.col(f"v{k}_{s}"))
            half = [X.times(X.plus(x[(k + i) % 3], x[k]), 0.5) for i in (1, 2)]
            one = one | (shared & _through(*half, y))
    hit = F.when(F.col("_same") == 3, F.lit(True)).when(F.col("_same") == 2, F.lit(False)).when(F.col("_same") == 1, one).otherwise(apart)
    return p.where(hit).select(F.col("fid_a").alias("f"), F.col("fid_b").alias("g"))


def _crossed(rays: DataFrame, size: float, low: list[float], high: list[float]) -> DataFrame:
    """rays (id, ox .. oz, dx .. dz), a row per cell of level 0 that each crosses within the box low .. high."""
    o, d = (tuple(F.col(f"{s}{c}") for c in "xyz") for s in "od")
    box = tuple(tuple(F.lit(float(v)) for v in side) for side in (low, high))
    first, last = X.line_box(o, d, *box)
    r = rays.withColumns({"_t0": F.greatest(first, F.lit(0.0)), "_t1": last}).where("_t1 IS NOT NULL AND _t0 <= _t1")

    def walls(o: Column, d: Column) -> Column:
        """Where the ray passes the cells' walls along one axis."""
        ends = [F.floor((o + F.col(t) * d) / size) for t in ("_t0", "_t1")]
        span = F.sequence(F.least(*ends), F.greatest(*ends) + 1)
        return F.when(F.abs(d) > X.EPS, F.transform(span, lambda k: X.over(k * F.lit(float(size)) - o, d))).otherwise(F.array().cast("array<double>"))

    inside = F.filter(F.flatten(F.array(*map(walls, o, d))), lambda t: (t > F.col("_t0")) & (t < F.col("_t1")))
    r = r.withColumn("_t", F.array_sort(F.concat(inside, F.array("_t0", "_t1"))))
    middle = F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda k: (F.col("_t")[k - 1] + F.col("_t")[k]) / 2)
    cell = lambda t: F.struct(*(F.floor((o[i] + t * d[i]) / size).alias(f"c{c}") for i, c in enumerate("xyz")))
    return r.select(*rays.columns, F.explode(F.array_distinct(F.transform(middle, cell))).alias("_c")).select(*rays.columns, *(F.col(f"_c.c{c}").alias(f"c{c}") for c in "xyz"))


def ray_triangles(rays: DataFrame, triangles: DataFrame, size: float | None = None) -> DataFrame:
    """(id, fid, t), every triangle (fid, x0 .. z2) that a ray (id, ox .. oz, dx .. dz) meets at o + t * d, t >= 0.

    A ray becomes the cells between the walls it crosses, so it meets the triangles on its way only.  A meeting is
    counted in the cell where it lies, or once for triangle and ray where rounding puts it into none of theirs.
    """
    tri = with_boxes(triangles)
    size = size or cell_size(tri)
    b = tri.agg(*(F.min(f"min_{c}").alias(f"l{c}") for c in "xyz"), *(F.max(f"max_{c}").alias(f"h{c}") for c in "xyz")).first()
    if b["lx"] is None:
        return rays.join(triangles, F.lit(False)).select("id", "fid", F.lit(None).cast("double").alias("t"))
    margin = size * 1e-6
    way = _crossed(rays.dropna(), size, [b[f"l{c}"] - margin for c in "xyz"], [b[f"h{c}"] + margin for c in "xyz"])
    met = way.join(apart(_touched(tri, size)), ["cx", "cy", "cz"])
    t = tuple(G.vec(suffix=str(k)) for k in range(3))
    o, d = (tuple(F.col(f"{s}{c}") for c in "xyz") for s in "od")
    return met.select("id", "fid", X.ray_triangle(o, d, t).alias("t")).where("t IS NOT NULL").groupBy("id", "fid").agg(F.min("t").alias("t"))


def first_hits(rays: DataFrame, triangles: DataFrame, size: float | None = None) -> DataFrame:
    """(id, fid, t): the nearest triangle of each ray that meets any; of equally near ones the lower fid."""
    return ray_triangles(rays, triangles, size).groupBy("id").agg(F.min(F.struct("t", "fid")).alias("m")).select("id", "m.fid", "m.t")


def inside(points: DataFrame, triangles: DataFrame, direction: tuple[float, float, float] = (0.5773, 0.5771, 0.5776), size: float | None = None) -> DataFrame:
    """(id, inside): whether points (id, x, y, z) lie in a closed surface: a ray to the outside crosses it an odd number of times.

    The direction is such that rays don't run along the edges of common grids; one that meets an edge counts both its faces.
    """
    rays = points.select("id", *(F.col(c).cast("double").alias(f"o{c}") for c in "xyz"), *(F.lit(v).alias(f"d{c}") for c, v in zip("xyz", direction, strict=True)))
    n = ray_triangles(rays, triangles, size).groupBy("id").agg(F.count("*").alias("n"))
    return points.select("id").join(apart(n), "id", "left").select("id", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))
