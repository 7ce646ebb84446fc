"""What a viewer asks of a node: normal cones, screen-space error, frustums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: Normals are packed by 32766, widths (up to 10) by 3276; the back-face test of the
#: original divides the width by 32766 too, which makes it nearly never true.
NORMAL_SCALE, WIDTH_SCALE, LITERAL_WIDTH_SCALE = 32766.0, 3276.0, 32766.0


def _scaled(n: G.Vector, by: Column | float) -> G.Vector:
    return tuple(c * by for c in n)


def _plus(a: G.Vector, b: G.Vector) -> G.Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def _looks(d: G.Vector, n: G.Vector) -> Column:
    """d lies inside the cone around n, whose length is one over the cosine that bounds it."""
    f = G.dot(d, n)
    return ~((f < 0.001) | (f * f < G.dot(d, d)))


def _packed(cone: G.Vector) -> G.Vector:
    return _scaled(cone, 1 / NORMAL_SCALE)


def point(view: tuple[float, float, float]) -> G.Vector:
    return tuple(F.lit(float(v)) for v in view)


def backface(cone: G.Vector, width: Column, center: G.Vector, radius: Column, view: tuple, width_scale: float = WIDTH_SCALE) -> Column:
    """All faces of a packed normal cone look away: the sphere's centre, moved against the normal, is in it."""
    n = _packed(cone)
    d = G.sub(G.sub(center, _scaled(n, radius)), point(view))
    return _looks(d, _scaled(n, width / width_scale))


def frontface(cone: G.Vector, width: Column, center: G.Vector, radius: Column, view: tuple) -> Column:
    """All faces of a packed normal cone look at the view point."""
    n = _packed(cone)
    d = G.sub(_plus(center, _scaled(n, radius)), point(view))
    return _looks(_scaled(d, -1), _scaled(n, width / WIDTH_SCALE))


def anchored_frontface(normal: G.Vector, front: G.Vector, view: tuple) -> Column:
    return _looks(_scaled(G.sub(front, point(view)), -1), normal)


def anchored_backface(normal: G.Vector, back: G.Vector, view: tuple) -> Column:
    return _looks(G.sub(back, point(view)), normal)


@dataclass
class Frustum:
    """Four side planes, near and far (n, d with n * p + d inside), the eye, and the size of a pixel."""

    planes: list[tuple[float, float, float, float]]
    eye: tuple[float, float, float]
    direction: tuple[float, float, float]
    scale: float
    resolution: float

    @classmethod
    def of(cls, projection: list[float], model: list[float], width: int) -> Frustum:
        """From column-major matrices and the viewport's width."""
        p, m = (np.array(x, float).reshape(4, 4).T for x in (projection, model))
        eye, direction, scale = cls.looking(model)
        back = np.linalg.inv(p)
        center, side = (_project(back, v) for v in ((0, 0, -1), (1, 0, -1)))
        resolution = 2 * np.linalg.norm(side - center) / np.linalg.norm(center) / width
        rows = p @ m
        planes = [rows[3] - rows[1], rows[3] - rows[0], rows[3] + rows[1], rows[3] + rows[0], rows[3] + rows[2], rows[3] - rows[2]]
        planes = [tuple((q / np.linalg.norm(q[:3])).tolist()) for q in planes]
        return cls(planes, eye, direction, scale, float(resolution))

    @staticmethod
    def looking(model: list[float]) -> tuple[tuple, tuple, float]:
        """(eye, direction over its squared length, one over its length) of a model matrix alone."""
        back = np.linalg.inv(np.array(model, float).reshape(4, 4).T)
        eye = _project(back, (0, 0, 0))
        d = _project(back, (0, 0, -1)) - eye
        square = float(d @ d)
        return tuple(eye.tolist()), tuple((d / square).tolist()), 1 / square**0.5

    def distance(self, center: G.Vector, radius: Column) -> Column:
        """How far the sphere reaches inside the nearest side plane; negative outside."""
        return G.planes_distance(center, radius, self.planes[:4])

    def outside(self, center: G.Vector, radius: Column) -> Column:
        return G.outside_planes(center, radius, self.planes[:4])

    def along(self, center: G.Vector) -> Column:
        return G.dot(G.sub(center, point(self.eye)), point(self.direction))

    def pixel(self, p: G.Vector, radius: Column | float = 0.0) -> Column:
        """Size of a pixel at a point, or at the nearest point of a sphere; -1 behind the eye."""
        d = G.dot(p, point(self.direction)) - radius * self.scale
        return F.when(d <= 0, F.lit(-1.0)).otherwise(self.resolution * d)

    def near_far(self, center: G.Vector, radius: Column) -> tuple[Column, Column]:
        return F.min(self.along(center) - radius * self.scale), F.max(self.along(center) + radius * self.scale)

    def error(self, center: G.Vector, radius: Column, error: Column, near: float = 0.1) -> Column:
        """Error in pixels at the sphere's nearest point; outside the frustum it shrinks with the distance
        (r / (r - d)) ** 2, and by 1000 (a factor above one counts as one)."""
        dist = F.greatest(G.norm(G.sub(center, point(self.eye))) - radius, F.lit(near))
        seen = error / F.greatest(self.resolution * dist, F.lit(1e-6))
        d = self.distance(center, radius)
        shrink = F.least(radius / (radius - d), F.lit(1.0))
        return F.when(d < 0, seen * shrink * shrink * 0.001).otherwise(seen)

    def simple_error(self, center: G.Vector, radius: Column, error: Column) -> Column:
        """The same with a distance of 0.1 at least and a plain division by 1000 outside."""
        dist = F.greatest(G.norm(G.sub(center, point(self.eye))) - radius, F.lit(0.1))
        seen = error / (self.resolution * dist)
        return F.when(self.outside(center, radius), seen / 1000).otherwise(seen)


def _project(m: np.ndarray, v: tuple) -> np.ndarray:
    out = m @ np.array([*v, 1.0])
    return out[:3] / out[3]
