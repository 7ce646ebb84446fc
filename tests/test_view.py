"""View predicates on values worked out by hand from the formulas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meshspark.functions import geometry as G
from meshspark.functions import view as V
from meshspark.queries.view import CAMERA

EYE = (0.0, 0.0, -5.0)


def one(spark, **columns):
    return tuple(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


def vec(*v):
    return tuple(F.lit(float(x)) for x in v)


# The normal points away from the eye at (0, 0, -5); at the origin d = (0, 0, 5 - r) and f = (5 - r) * width / scale.
@pytest.mark.parametrize("normal, width, radius, back, front", [
    ((0, 0, 32766), 3276, 1.0, True, False),  # f = 4 = |d|
    ((0, 0, 32766), 3200, 1.0, False, False),  # f is a little less than |d|
    ((0, 0, 32766), 32766, 5.0, False, False),  # f = 0
    ((0, 0, -32766), 3276, 1.0, False, True),  # looks at the eye
    ((32766, 0, 0), 32760, 1.0, False, False),  # d = (-1, 0, 5): f = -10
])
def test_packed_cones(spark, normal, width, radius, back, front):
    args = (vec(*normal), F.lit(width), vec(0, 0, 0), F.lit(radius), EYE)
    assert one(spark, b=V.backface(*args), f=V.frontface(*args)) == (back, front)


def test_back_faces_with_the_literal_scale_are_nearly_never_found(spark):
    args = (vec(0, 0, 32766), F.lit(32760), vec(0, 0, 0), F.lit(1.0), EYE)
    assert one(spark, b=V.backface(*args), l=V.backface(*args, V.LITERAL_WIDTH_SCALE)) == (True, False)


def test_anchored_cones(spark):
    # d = (0, 0, 5): f = 10, f * f = 100 >= 25; turned around it is a front.
    assert one(spark, b=V.anchored_backface(vec(0, 0, 2), vec(0, 0, 0), EYE), f=V.anchored_frontface(vec(0, 0, -2), vec(0, 0, 0), EYE)) == (True, True)
    assert one(spark, b=V.anchored_backface(vec(0, 0, 0.9), vec(0, 0, 0), EYE), f=V.anchored_frontface(vec(0, 0, 2), vec(0, 0, 0), EYE)) == (False, False)


def test_the_frustum_of_a_camera():
    h = math.sqrt(0.5)
    want = [(0, -h, -h, 45 * h), (-h, 0, -h, 40 * h), (0, h, -h, 15 * h), (h, 0, -h, 20 * h)]
    assert all(p == pytest.approx(q) for p, q in zip(CAMERA.planes[:4], want, strict=True))
    assert CAMERA.eye == pytest.approx((10, 15, 30)) and CAMERA.direction == pytest.approx((0, 0, -1))
    assert CAMERA.resolution == pytest.approx(2 / 800) and CAMERA.scale == pytest.approx(1)
    assert CAMERA.planes[4] == pytest.approx((0, 0, -1, 29.9)) and CAMERA.planes[5] == pytest.approx((0, 0, 1, 70), abs=1e-6)


# (center, radius, error) -> pixels, seen from (10, 15, 30) at 0.0025 a unit.
@pytest.mark.parametrize("center, radius, error, want", [
    ((10, 15, 0), 10.0, 1.0, 1 / (0.0025 * 20)),
    ((10, 15, 29), 5.0, 1.0, 1 / (0.0025 * 0.1)),  # inside the sphere: the near plane counts
    ((10, 15, 30), 0.0, 2.0, 2 / (0.0025 * 0.1)),
    ((110, 15, 0), 1.0, 1.0, 1 / (0.0025 * (math.sqrt(100**2 + 30**2) - 1)) * (1 / (1 + 70 * math.sqrt(0.5) - 1)) ** 2 * 0.001),
    ((10, 115, 0), 2.0, 3.0, 3 / (0.0025 * (math.sqrt(100**2 + 30**2) - 2)) * (2 / (70 * math.sqrt(0.5))) ** 2 * 0.001),
])
def test_screen_errors(spark, center, radius, error, want):
    assert one(spark, e=CAMERA.error(vec(*center), F.lit(radius), F.lit(error)))[0] == pytest.approx(want)


def test_simple_errors_outside_shrink_by_a_thousand(spark):
    far = math.sqrt(100**2 + 30**2) - 1
    assert one(spark, e=CAMERA.simple_error(vec(110, 15, 0), F.lit(1.0), F.lit(1.0)))[0] == pytest.approx(1 / (0.0025 * far) / 1000)
    assert one(spark, e=CAMERA.simple_error(vec(10, 15, 0), F.lit(10.0), F.lit(1.0)))[0] == pytest.approx(20)


def test_pixels_and_precision(spark):
    assert one(spark, p=CAMERA.pixel(vec(0, 0, -4), 1.0), q=CAMERA.pixel(vec(0, 0, 4))) == (pytest.approx(0.0025 * 3), -1.0)
    bits = G.float_precision(vec(1024, 0, 1), vec(1, 1, 1))
    assert one(spark, b=bits, v=G.precision_verdict(bits)) == (pytest.approx(14), "warn")


def test_matrices_have_sixteen_numbers(spark):
    assert one(spark, m=G.matrix_of(F.lit(":".join(map(str, range(16))))))[0] == [float(i) for i in range(16)]
    with pytest.raises(Exception, match="not a matrix"):
        one(spark, m=G.matrix_of(F.lit("1:2:3")))


def test_spheres_that_hold_each_other(spark):
    made = G.sphere_add(vec(0, 0, 0), F.lit(1.0), vec(4, 0, 0), F.lit(1.0))
    assert one(spark, x=made[0][0], r=made[1]) == (2.0, 3.0)
    made = G.sphere_add(vec(0, 0, 0), F.lit(9.0), vec(4, 0, 0), F.lit(1.0))
    assert one(spark, x=made[0][0], r=made[1]) == (0.0, 9.0)
