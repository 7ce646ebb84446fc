"""Intersections, distances and qualities of lines, planes, boxes, spheres and triangles, as columns.

Points and directions are tuples of three columns, planes (nx, ny, nz, d) with n * p = d, boxes (low, high).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

V = G.Vector
EPS = 1e-12


def plus(a: V, b: V) -> V:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def times(a: V, k: Column | float) -> V:
    return tuple(p * k for p in a)


def over(a: Column, b: Column) -> Column:
    """a / b; null where b is zero, so that no guard can come too late."""
    return F.try_divide(a, b)


def rows_of(*rows: tuple[V, ...]) -> Column:
    """An array with one entry per row of points, for expressions that are the same for each: written once, not copied."""
    return F.array(*(F.struct(*(F.struct(*(c.cast("double").alias(x) for x, c in zip("xyz", p, strict=True))).alias(f"p{i}") for i, p in enumerate(r))) for r in rows))


def points_of(row: Column, n: int) -> list[V]:
    return [tuple(row[f"p{i}"][x] for x in "xyz") for i in range(n)]


def let(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of values, each worked out once however often f names it."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f)[0]


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def line_sphere(o: V, d: V, c: V, r: Column) -> tuple[Column, Column]:
    """Parameters of both meetings of a line (unit direction) with a sphere; null if none."""
    oc = G.sub(c, o)
    along = G.dot(oc, d)
    h = r * r - (G.dot(oc, oc) - along * along)
    root = F.sqrt(F.greatest(h, F.lit(0.0)))
    return F.when(h >= 0, along - root), F.when(h >= 0, along + root)


def plane_line(n: V, k: Column, o: V, d: V) -> Column:
    """Parameter where a line meets a plane; null if they are parallel."""
    nd = G.dot(n, d)
    return F.when(F.abs(nd) > EPS, over(k - G.dot(n, o), nd))


def plane_segment(n: V, k: Column, a: V, b: V) -> Column:
    t = plane_line(n, k, a, G.sub(b, a))
    return F.when((t >= 0) & (t <= 1), t)


def plane_segment_within(n: V, k: Column, a: V, b: V, eps: float) -> Column:
    """Like plane_segment, but an end nearer than `eps` to the plane (unit normal) meets it; the nearer of two such ends does."""
    s, t = G.dot(n, a) - k, G.dot(n, b) - k
    end = F.when(F.least(F.abs(s), F.abs(t)) < eps, F.when(F.abs(s) <= F.abs(t), F.lit(0.0)).otherwise(F.lit(1.0)))
    return F.coalesce(end, F.when(s * t < 0, over(s, s - t)))


def plane_triangle(n: V, k: Column, t: tuple[V, V, V]) -> Column:
    """The plane has corners on both sides, or a corner in it."""
    s = [G.dot(n, p) - k for p in t]
    return (F.least(*s) <= 0) & (F.greatest(*s) >= 0)


def line_triangle(o: V, d: V, t: tuple[V, V, V]) -> Column:
    """Parameter of a line's meeting with a triangle; null if none (or parallel)."""
    e1, e2, s = G.sub(t[1], t[0]), G.sub(t[2], t[0]), G.sub(o, t[0])
    p, q = G.cross(d, e2), G.cross(s, e1)
    det = G.dot(e1, p)
    u, v = over(G.dot(s, p), det), over(G.dot(d, q), det)
    return F.when((F.abs(det) > EPS) & (u >= 0) & (v >= 0) & (u + v <= 1), over(G.dot(e2, q), det))


def ray_triangle(o: V, d: V, t: tuple[V, V, V]) -> Column:
    x = line_triangle(o, d, t)
    return F.when(x >= 0, x)


def segment_triangle(a: V, b: V, t: tuple[V, V, V]) -> Column:
    x = line_triangle(a, G.sub(b, a), t)
    return F.when((x >= 0) & (x <= 1), x)


def _flat(p: V, n: V) -> tuple[Column, Column]:
    """Of a point, the two coordinates in which a plane of normal n is widest."""
    a = [F.abs(c) for c in n]
    x_first, y_first = (a[0] >= a[1]) & (a[0] >= a[2]), a[1] >= a[2]
    return F.when(x_first, p[1]).otherwise(p[0]), F.when(x_first | y_first, p[2]).otherwise(p[1])


def coplanar(s: tuple[V, V, V], t: tuple[V, V, V], eps: float = 1e-9) -> Column:
    """Both triangles lie in one plane: no corner of t is farther than `eps` times s's size from that of s."""
    n = G.cross(G.sub(s[1], s[0]), G.sub(s[2], s[0]))
    size = F.greatest(*(G.distance2(a, b) for a, b in ((s[0], s[1]), (s[0], s[2]), (s[0], t[0]), (s[0], t[1]), (s[0], t[2]))))
    return F.greatest(*(F.abs(G.dot(n, G.sub(p, s[0]))) for p in t)) <= eps * G.norm(n) * F.sqrt(size)


def coplanar_overlap(s: tuple[V, V, V], t: tuple[V, V, V]) -> Column:
    """Triangles of one plane share inner points: no line through an edge of one has the two on different sides.

    Sharing an edge or a corner alone isn't meeting.
    """
    n = G.cross(G.sub(s[1], s[0]), G.sub(s[2], s[0]))
    x, y = ([_flat(p, n) for p in tri] for tri in (s, t))
    apart = F.lit(False)
    for own, other in ((x, y), (y, x)):
        for i in range(3):
            a, b, c = own[i], own[(i + 1) % 3], own[(i + 2) % 3]
            side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            mine = F.signum(side(c))
            apart = apart | (F.greatest(*(side(p) * mine for p in other)) <= 0)
    return ~apart


def triangle_triangle(s: tuple[V, V, V], t: tuple[V, V, V]) -> Column:
    """An edge of one meets the other (triangles in one plane don't count, see coplanar_overlap)."""
    pairs = rows_of(*((x[i], x[(i + 1) % 3], *y) for x, y in ((s, t), (t, s)) for i in range(3)))
    return F.exists(pairs, _pierces)


def _pierces(row: Column) -> Column:
    a, b, *t = points_of(row, 5)
    return segment_triangle(a, b, tuple(t)).isNotNull()


def line_box(o: V, d: V, low: V, high: V) -> tuple[Column, Column]:
    """First and last parameter of a line inside a box; null if it misses it."""
    first, last, ok = F.lit(-1e300), F.lit(1e300), F.lit(True)
    for i in range(3):
        flat = F.abs(d[i]) <= EPS
        a, b = over(low[i] - o[i], d[i]), over(high[i] - o[i], d[i])
        first = F.greatest(first, F.when(flat, F.lit(-1e300)).otherwise(F.least(a, b)))
        last = F.least(last, F.when(flat, F.lit(1e300)).otherwise(F.greatest(a, b)))
        ok = ok & (~flat | ((o[i] >= low[i]) & (o[i] <= high[i])))
    ok = ok & (first <= last)
    return F.when(ok, first), F.when(ok, last)


def ray_box(o: V, d: V, low: V, high: V) -> Column:
    first, last = line_box(o, d, low, high)
    return F.when(last >= 0, F.greatest(first, F.lit(0.0)))


def segment_box(a: V, b: V, low: V, high: V) -> Column:
    first, last = line_box(a, G.sub(b, a), low, high)
    return (last >= 0) & (first <= 1)


def plane_box(n: V, k: Column, low: V, high: V) -> Column:
    near = sum((F.when(n[i] >= 0, n[i] * low[i]).otherwise(n[i] * high[i]) for i in range(3)), F.lit(0.0))
    far = sum((F.when(n[i] >= 0, n[i] * high[i]).otherwise(n[i] * low[i]) for i in range(3)), F.lit(0.0))
    return (near <= k) & (far >= k)


def triangle_box(t: tuple[V, V, V], low: V, high: V) -> Column:
    """No axis of the thirteen (box sides, the normal, edge by side) separates them."""
    mid, half = times(plus(low, high), 0.5), times(G.sub(high, low), 0.5)
    p = [G.sub(x, mid) for x in t]
    edges = [G.sub(t[(i + 1) % 3], t[i]) for i in range(3)]
    unit = [tuple(F.lit(1.0 if i == j else 0.0) for j in range(3)) for i in range(3)]
    axes = [*unit, G.cross(edges[0], edges[1]), *(G.cross(u, e) for u in unit for e in edges)]

    def meets(row: Column) -> Column:
        (a,) = points_of(row, 1)
        s = [G.dot(a, x) for x in p]
        r = sum((half[i] * F.abs(a[i]) for i in range(3)), F.lit(0.0))
        return (F.least(*s) <= r) & (F.greatest(*s) >= -r)

    return F.forall(rows_of(*((a,) for a in axes)), meets)


def sphere_sphere(a: V, r: Column, b: V, s: Column) -> Column:
    return G.distance2(a, b) <= (r + s) * (r + s)


def sphere_triangle(c: V, r: Column, t: tuple[V, V, V]) -> Column:
    return triangle_point(t, c) <= r


def plane_plane(n: V, m: V) -> V:
    """Direction of the line that two planes share; zero if they are parallel."""
    return G.cross(n, m)


def sphere_point_distance(c: V, r: Column, p: V) -> Column:
    return F.greatest(G.norm(G.sub(p, c)) - r, F.lit(0.0))


def sphere_sphere_distance(a: V, r: Column, b: V, s: Column) -> Column:
    return F.greatest(G.norm(G.sub(a, b)) - r - s, F.lit(0.0))


def plane_point2(n: V, k: Column, p: V) -> Column:
    """Squared distance to a plane; null without a normal."""
    d = G.dot(n, p) - k
    return over(d * d, G.dot(n, n))


def line_point2(o: V, d: V, p: V) -> Column:
    """Squared distance to a line; to its point where it has no direction."""
    x = G.cross(G.sub(p, o), d)
    return F.coalesce(over(G.dot(x, x), G.dot(d, d)), G.distance2(p, o))


def line_line(a: V, d: V, b: V, e: V) -> Column:
    """Distance of two lines; of parallel ones too, and of points, which have no direction."""
    n = G.cross(d, e)
    apart = F.when(G.dot(d, d) > 0, line_point2(a, d, b)).otherwise(line_point2(b, e, a))
    return F.when(G.dot(n, n) > EPS, over(F.abs(G.dot(G.sub(b, a), n)), G.norm(n))).otherwise(F.sqrt(apart))


def segment_point2(a: V, b: V, p: V) -> Column:
    d = G.sub(b, a)
    n = G.dot(d, d)
    t = F.when(n > 0, clamp(over(G.dot(G.sub(p, a), d), n))).otherwise(F.lit(0.0))
    return G.distance2(p, plus(a, times(d, t)))


def segment_segment(a: V, b: V, c: V, d: V) -> Column:
    """Nearest of the ends to the other segment, and of the inner meeting where there is one."""
    u, v, w = G.sub(b, a), G.sub(d, c), G.sub(a, c)

    def solved(r: Column) -> Column:
        det = r["uu"] * r["vv"] - r["uv"] * r["uv"]
        s, t = over(r["uv"] * r["vw"] - r["vv"] * r["uw"], det), over(r["uu"] * r["vw"] - r["uv"] * r["uw"], det)
        return let(met, det=det, s=s, t=t)

    def met(r: Column) -> Column:
        s, t = r["s"], r["t"]
        inside = (r["det"] > EPS) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        return F.when(inside, sum((let(lambda x: x["d"] * x["d"], d=w[i] + u[i] * s - v[i] * t) for i in range(3)), F.lit(0.0)))

    inner = let(solved, uu=G.dot(u, u), uv=G.dot(u, v), vv=G.dot(v, v), uw=G.dot(u, w), vw=G.dot(v, w))
    ends = F.array_min(F.transform(rows_of((c, d, a), (c, d, b), (a, b, c), (a, b, d)), _to_segment))
    return F.sqrt(F.least(ends, F.coalesce(inner, ends)))


def _to_segment(row: Column) -> Column:
    return segment_point2(*points_of(row, 3))


def triangle_point(t: tuple[V, V, V], p: V) -> Column:
    """Distance of a point to a triangle: to its plane above the inside, else to the nearest edge."""
    e1, e2, w = G.sub(t[1], t[0]), G.sub(t[2], t[0]), G.sub(p, t[0])
    n = G.cross(e1, e2)

    def above(r: Column) -> Column:
        u, v = over(r["c"] * r["d"] - r["b"] * r["e"], r["det"]), over(r["a"] * r["e"] - r["b"] * r["d"], r["det"])
        return let(lambda x: F.when((r["det"] > EPS) & (x["u"] >= 0) & (x["v"] >= 0) & (x["u"] + x["v"] <= 1), over(r["up"] * r["up"], r["nn"])), u=u, v=v)

    a, b, c, d, e = G.dot(e1, e1), G.dot(e1, e2), G.dot(e2, e2), G.dot(w, e1), G.dot(w, e2)
    height = let(above, a=a, b=b, c=c, d=d, e=e, det=a * c - b * b, up=G.dot(w, n), nn=G.dot(n, n))
    edges = F.array_min(F.transform(rows_of(*((t[i], t[(i + 1) % 3], p) for i in range(3))), _to_segment))
    return F.sqrt(F.coalesce(height, edges))


def _least_distance(points: list[tuple[V, ...]], segments: list[tuple[V, ...]], piercing: list[tuple[V, ...]]) -> Column:
    """0 if a segment of `piercing` (a, b, triangle) meets its triangle, else the least distance of points
    (triangle, p) and of segments (a, b, c, d)."""

    def to_triangle(row: Column) -> Column:
        *t, p = points_of(row, 4)
        return triangle_point(tuple(t), p)

    near = F.array_min(F.transform(rows_of(*points), to_triangle))
    across = F.array_min(F.transform(rows_of(*segments), lambda row: segment_segment(*points_of(row, 4))))
    return F.when(F.exists(rows_of(*piercing), _pierces), F.lit(0.0)).otherwise(F.least(near, across))


def triangle_segment(t: tuple[V, V, V], a: V, b: V) -> Column:
    return _least_distance([(*t, a), (*t, b)], [(t[i], t[(i + 1) % 3], a, b) for i in range(3)], [(a, b, *t)])


def triangle_triangle_distance(s: tuple[V, V, V], t: tuple[V, V, V]) -> Column:
    sides = [[(x[i], x[(i + 1) % 3]) for i in range(3)] for x in (s, t)]
    points = [(*x, p) for x, y in ((s, t), (t, s)) for p in y]
    return _least_distance(points, [(*e, *f) for e in sides[0] for f in sides[1]], [(*e, *x) for x, own in ((s, sides[1]), (t, sides[0])) for e in own])


def _sides(t: tuple[V, V, V]) -> list[Column]:
    return [G.norm(G.sub(t[(i + 1) % 3], t[i])) for i in range(3)]


def double_area(t: tuple[V, V, V]) -> Column:
    return G.norm(G.cross(G.sub(t[1], t[0]), G.sub(t[2], t[0])))


def quality(t: tuple[V, V, V]) -> Column:
    """Twice the area over the longest side squared; 0 for a point or a line."""
    longest = F.greatest(*_sides(t))
    return F.coalesce(over(double_area(t), longest * longest), F.lit(0.0))


def quality_radii(t: tuple[V, V, V]) -> Column:
    """Twice the inscribed over the circumscribed radius: 1 for equal sides."""
    a, b, c = _sides(t)
    s = (a + b + c) / 2
    area2 = F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0))
    return F.coalesce(over(8 * area2, a * b * c * s), F.lit(0.0))


def quality_mean_ratio(t: tuple[V, V, V]) -> Column:
    """4 sqrt(3) times the area over the sum of squared sides: 1 for equal sides."""
    a, b, c = _sides(t)
    total = a * a + b * b + c * c
    return F.coalesce(over(2 * F.sqrt(F.lit(3.0)) * double_area(t), total), F.lit(0.0))
