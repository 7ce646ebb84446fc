"""Column functions on colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible: green, then blue and red against green, modulo 256."""
    return g, F.pmod(b - g, F.lit(256)), F.pmod(r - g, F.lit(256))


def from_ycc(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return F.pmod(cr + y, F.lit(256)), y, F.pmod(cb + y, F.lit(256))


def quantise(c: Column, step: int) -> Column:
    return (c / step).cast("int") * step


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


#: The ramp's five stops.
RAMP = ((255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255))


def ramp(v: Column, low: float, high: float) -> tuple[Column, Column, Column]:
    """Red, yellow, green, cyan, blue over low..high, clamped outside."""
    t = F.greatest(F.least((v - low) / (high - low), F.lit(1.0)), F.lit(0.0)) * 4
    k = F.least(F.floor(t), F.lit(3)).cast("int")
    out = []
    for channel in range(3):
        expr = F.lit(None).cast("double")
        for i in range(3, -1, -1):
            expr = F.when(k == i, lerp(F.lit(float(RAMP[i][channel])), F.lit(float(RAMP[i + 1][channel])), t - i)).otherwise(expr)
        out.append(F.floor(expr).cast("int"))
    return tuple(out)


def hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Channels in 0..1 of hue, saturation and value in 0..1."""
    k = F.floor(h * 6)
    f = h * 6 - k
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    sector = F.pmod(k, F.lit(6))
    table = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    out = []
    for channel in range(3):
        expr = table[5][channel]
        for i in range(4, -1, -1):
            expr = F.when(sector == i, table[i][channel]).otherwise(expr)
        out.append(expr)
    return tuple(out)


def gray(v: Column) -> Column:
    return F.floor(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def debug_colour(i: Column) -> tuple[Column, Column, Column]:
    """Channels that tell neighbouring numbers apart.  Fixed values: the factors and remainders."""
    return tuple(F.pmod(F.pmod(i, F.lit(m)) * k, F.lit(r)) + r for m, k, r in ((16, 135, 127), (7, 57, 127), (11, 171, 63)))
