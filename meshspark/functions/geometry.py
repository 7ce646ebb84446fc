"""Column functions on points, boxes, spheres, planes and cones.  A vector is a tuple of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vector:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vector, b: Vector) -> Column:
    d = sub(a, b)
    return dot(d, d)


def snap(v: Column, step: float) -> Column:
    """Towards zero on a grid of `step`."""
    return F.lit(step) * (v / F.lit(step)).cast("int")


def grid(v: Column, log_step: int) -> Column:
    """Nearest cell of size 2**log_step."""
    return F.floor(v / F.lit(2.0**log_step) + F.lit(0.5))


def in_box(p: Vector, low: tuple, high: tuple) -> Column:
    """Lower sides belong to the box, upper ones don't."""
    out = F.lit(True)
    for v, a, b in zip(p, low, high, strict=True):
        out = out & (v >= a) & (v < b)
    return out


def longest_axis(dx: Column, dy: Column, dz: Column) -> Column:
    return F.when((dx > dy) & (dx > dz), 0).when(~(dx > dy) & (dy > dz), 1).otherwise(2)


def plane_distance(p: Vector, plane: tuple[float, float, float, float]) -> Column:
    return p[0] * plane[0] + p[1] * plane[1] + p[2] * plane[2] + plane[3]


def outside_planes(center: Vector, radius: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """Some plane has the whole sphere behind it."""
    out = F.lit(False)
    for plane in planes:
        out = out | (plane_distance(center, plane) + radius < 0)
    return out


def planes_distance(center: Vector, radius: Column, planes: list) -> Column:
    """How far the sphere reaches inside the nearest plane."""
    return F.least(*(plane_distance(center, p) + radius for p in planes))


def ray_sphere(center: Vector, radius: Column, origin: tuple, direction: tuple) -> Column:
    """Distance along a unit ray to the sphere: 0 inside, null where it isn't met."""
    oc = sub(center, tuple(F.lit(float(v)) for v in origin))
    along = dot(oc, tuple(F.lit(float(v)) for v in direction))
    off = dot(oc, oc) - along * along
    inside = dot(oc, oc) <= radius * radius
    met = (along > 0) & (off <= radius * radius)
    return F.when(inside, F.lit(0.0)).when(met, along - F.sqrt(F.greatest(radius * radius - off, F.lit(0.0))))


def clamp_split(mid: Column, low: Column, high: Column, adaptivity: float) -> Column:
    """A split place, held near the middle: adaptivity 0 is the middle itself."""
    size = high - low
    return F.least(F.greatest(mid, low + size * ((1 - adaptivity) / 2)), low + size * ((1 + adaptivity) / 2))


def pack_unit(v: Column, scale: float = 32766.0) -> Column:
    """A number in -1..1 as a 16-bit whole number, cut towards zero."""
    return (F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)) * scale).cast("int")


def affine(p: Vector, m: list[float]) -> Vector:
    """Rows of a 4 x 4 matrix applied to a point."""
    w = p[0] * m[12] + p[1] * m[13] + p[2] * m[14] + m[15]
    return tuple((p[0] * m[4 * i] + p[1] * m[4 * i + 1] + p[2] * m[4 * i + 2] + m[4 * i + 3]) / w for i in range(3))


def pad(size: Column, to: int = 256) -> Column:
    """Next multiple of a power of two."""
    return (size.cast("long") - 1).bitwiseAND(F.lit(~(to - 1))) + to


def around(center: Vector, radius: Column) -> tuple[Vector, Vector]:
    """The box (low, high) around a sphere."""
    return tuple(c - radius for c in center), tuple(c + radius for c in center)


def boxes_meet(low: Vector, high: Vector, other_low: Vector, other_high: Vector) -> Column:
    out = F.lit(True)
    for a, b, p, q in zip(low, high, other_low, other_high, strict=True):
        out = out & (a <= q) & (b >= p)
    return out


def box_diagonal(low: Vector, high: Vector) -> Column:
    return norm(sub(high, low))


def box_volume(low: Vector, high: Vector) -> Column:
    d = sub(high, low)
    return d[0] * d[1] * d[2]


def sphere_add(a: Vector, r: Column, b: Vector, s: Column) -> tuple[Vector, Column]:
    """The smallest sphere around two spheres."""
    d = norm(sub(b, a))
    inside, outside = d + s <= r, d + r <= s
    step = (d + s - r) / 2 / d
    center = tuple(F.when(inside, p).when(outside, q).otherwise(p + (q - p) * step) for p, q in zip(a, b, strict=True))
    return center, F.when(inside, r).when(outside, s).otherwise((d + r + s) / 2)


def pack_cone(n: Vector) -> tuple[Column, Column, Column, Column]:
    """A scaled normal as four whole numbers: its direction by 32766, its length (10 at most) by 3276."""
    size = norm(n)
    unit = tuple(F.when(size > 0.001, c / size).otherwise(c) for c in n)
    return (*(pack_unit(c) for c in unit), (F.least(size, F.lit(10.0)) * 3276).cast("int"))


def normal_z(x: Column, y: Column, sign: Column) -> Column:
    """The third component of a packed unit normal."""
    z = F.sqrt(F.greatest(F.lit(32767.0 * 32767.0) - x * x - y * y, F.lit(0.0)))
    return (F.when(sign == 1, -z).otherwise(z)).cast("int")


#: Bytes of a payload's columns, per vertex or face.
COORD_BYTES, UV_BYTES, NORMAL_BYTES, COLOUR_BYTES, FACE_BYTES = 12, 8, 6, 4, 6
ATTRIBUTE_BYTES = {"byte": 1, "ubyte": 1, "short": 2, "ushort": 2, "int": 4, "uint": 4, "float": 4, "double": 8}


def element_width(attributes: list[str]) -> int:
    """Bytes of attributes such as `float3`."""
    return sum(ATTRIBUTE_BYTES[a.rstrip("0123456789")] * int(a[-1]) for a in attributes)


def payload_size(nvert: Column, nface: Column, normals: bool, colours: bool, uv: bool) -> Column:
    width = COORD_BYTES + NORMAL_BYTES * normals + COLOUR_BYTES * colours + UV_BYTES * uv
    return nvert * width + nface * FACE_BYTES


def payload_offsets(nvert: Column, normals: bool, colours: bool, uv: bool) -> list[Column]:
    """First bytes of the columns: coordinates, texture coordinates, normals, colours, faces."""
    at, out = 0, []
    for width in (0, COORD_BYTES, UV_BYTES * uv, NORMAL_BYTES * normals, COLOUR_BYTES * colours):
        at += width
        out.append((nvert * at).cast("long"))
    return out


def matrix_of(text: Column) -> Column:
    """16 numbers parted by colons; anything else is an error."""
    numbers = F.transform(F.split(text, ":"), lambda v: v.cast("double"))
    bad = (F.size(numbers) != 16) | F.exists(numbers, lambda v: v.isNull())
    return F.when(bad, F.raise_error(F.concat(F.lit("not a matrix of 16 numbers: "), text)).cast("array<double>")).otherwise(numbers)


def float_precision(center: Vector, size: Vector) -> Column:
    """Bits that single precision leaves a box of this size so far from the origin; the worst axis counts."""
    bits = (F.log2(F.nullif(F.abs(s), F.lit(0.0))) - F.log2(F.nullif(F.abs(c), F.lit(0.0))) + 24 for c, s in zip(center, size, strict=True))
    return F.least(*(F.coalesce(b, F.lit(1e9)) for b in bits))


def precision_verdict(bits: Column) -> Column:
    return F.when(bits < 12, "refuse").when(bits < 16, "warn").otherwise("fine")
