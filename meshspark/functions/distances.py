"""Distances of lines, segments and triangles for batches of rows: the formulas of `intersect` over arrays.

A column there of a distance between triangles takes thousands of steps a row, in lambdas that Spark doesn't compile.
Points and directions are tuples of three arrays (or numbers); NaN stands for null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

from . import geometry as G
from .intersect import EPS, plus, times

V = tuple[np.ndarray, np.ndarray, np.ndarray]


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; NaN where b is zero."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


def _least(values: list[np.ndarray]) -> np.ndarray:
    return reduce(np.fmin, values)


def line_point2(o: V, d: V, p: V) -> np.ndarray:
    x = G.cross(G.sub(p, o), d)
    far = over(G.dot(x, x), G.dot(d, d))
    return np.where(np.isnan(far), G.distance2(p, o), far)


def line_line(a: V, d: V, b: V, e: V) -> np.ndarray:
    n = G.cross(d, e)
    nn = G.dot(n, n)
    apart = np.where(G.dot(d, d) > 0, line_point2(a, d, b), line_point2(b, e, a))
    return np.where(nn > EPS, over(np.abs(G.dot(G.sub(b, a), n)), np.sqrt(nn)), np.sqrt(apart))


def segment_point2(a: V, b: V, p: V) -> np.ndarray:
    d = G.sub(b, a)
    n = G.dot(d, d)
    t = np.where(n > 0, np.clip(over(G.dot(G.sub(p, a), d), n), 0.0, 1.0), 0.0)
    return G.distance2(p, plus(a, times(d, t)))


def segment_segment(a: V, b: V, c: V, d: V) -> np.ndarray:
    u, v, w = G.sub(b, a), G.sub(d, c), G.sub(a, c)
    uu, uv, vv, uw, vw = G.dot(u, u), G.dot(u, v), G.dot(v, v), G.dot(u, w), G.dot(v, w)
    det = uu * vv - uv * uv
    s, t = over(uv * vw - vv * uw, det), over(uu * vw - uv * uw, det)
    inside = (det > EPS) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    inner = sum((x * x for x in (w[i] + u[i] * s - v[i] * t for i in range(3))), 0.0)
    ends = _least([segment_point2(c, d, a), segment_point2(c, d, b), segment_point2(a, b, c), segment_point2(a, b, d)])
    return np.sqrt(np.fmin(ends, np.where(inside, inner, ends)))


def triangle_point(t: tuple[V, V, V], p: V) -> np.ndarray:
    e1, e2, w = G.sub(t[1], t[0]), G.sub(t[2], t[0]), G.sub(p, t[0])
    n = G.cross(e1, e2)
    a, b, c, d, e = G.dot(e1, e1), G.dot(e1, e2), G.dot(e2, e2), G.dot(w, e1), G.dot(w, e2)
    det, up = a * c - b * b, G.dot(w, n)
    u, v = over(c * d - b * e, det), over(a * e - b * d, det)
    height = np.where((det > EPS) & (u >= 0) & (v >= 0) & (u + v <= 1), over(up * up, G.dot(n, n)), np.nan)
    edges = _least([segment_point2(t[i], t[(i + 1) % 3], p) for i in range(3)])
    return np.sqrt(np.where(np.isnan(height), edges, height))


def _pierces(a: V, b: V, t: tuple[V, V, V]) -> np.ndarray:
    d = G.sub(b, a)
    e1, e2, s = G.sub(t[1], t[0]), G.sub(t[2], t[0]), G.sub(a, t[0])
    p, q = G.cross(d, e2), G.cross(s, e1)
    det = G.dot(e1, p)
    u, v, x = over(G.dot(s, p), det), over(G.dot(d, q), det), over(G.dot(e2, q), det)
    return (np.abs(det) > EPS) & (u >= 0) & (v >= 0) & (u + v <= 1) & (x >= 0) & (x <= 1)


def _least_distance(points: list[tuple], segments: list[tuple], piercing: list[tuple]) -> np.ndarray:
    near = _least([triangle_point(t, p) for t, p in points] + [segment_segment(*s) for s in segments])
    return np.where(reduce(np.logical_or, (_pierces(a, b, t) for a, b, t in piercing)), 0.0, near)


def triangle_segment(t: tuple[V, V, V], a: V, b: V) -> np.ndarray:
    return _least_distance([(t, a), (t, b)], [(t[i], t[(i + 1) % 3], a, b) for i in range(3)], [(a, b, t)])


def triangle_triangle(s: tuple[V, V, V], t: tuple[V, V, V]) -> np.ndarray:
    sides = [[(x[i], x[(i + 1) % 3]) for i in range(3)] for x in (s, t)]
    points = [(x, p) for x, y in ((s, t), (t, s)) for p in y]
    return _least_distance(points, [(*e, *f) for e in sides[0] for f in sides[1]], [(*e, x) for x, own in ((s, sides[1]), (t, sides[0])) for e in own])
