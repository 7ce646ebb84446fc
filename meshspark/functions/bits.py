"""Bit-level column functions: Morton codes, integer logarithms, zig-zag numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton(x: Column, y: Column, z: Column, levels: int) -> Column:
    """Interleave `levels` bits (21 at most) of three whole numbers, x lowest."""
    out = F.lit(0).cast("long")
    for axis, v in enumerate((x, y, z)):
        v = v.cast("long")
        for i in range(levels):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 3 * i + axis))
    return out


def morton_axis(code: Column, axis: int, levels: int, dims: int = 3) -> Column:
    """One coordinate of a Morton code."""
    out = F.lit(0).cast("long")
    for i in range(levels):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, dims * i + axis).bitwiseAND(F.lit(1)), i))
    return out


def ilog2(v: Column) -> Column:
    """Place of the highest set bit; 0 for 0."""
    return F.length(F.bin(v.cast("long"))) - 1


def needed_bits(v: Column) -> Column:
    """Bits of a signed number with its sign; 1 for 0 and -1."""
    n = F.when(v >= 0, v).otherwise(-v - 1)
    return F.when(n == 0, F.lit(1)).otherwise(F.length(F.bin(n.cast("long"))) + 1)


def zigzag(v: Column) -> Column:
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 1, -((v + 1) / 2).cast("long")).otherwise((v / 2).cast("long"))


def round_up_pow2(v: Column) -> Column:
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L").cast("long") * F.pow(F.lit(2.0), F.length(F.bin((v - 1).cast("long")))).cast("long"))


def highest_difference(a: Column, b: Column) -> Column:
    return ilog2(a.cast("long").bitwiseXOR(b.cast("long")))


def test_bit(v: Column, bit: int) -> Column:
    return F.shiftright(v.cast("long"), bit).bitwiseAND(F.lit(1)) == 1


def set_bit(v: Column, bit: int) -> Column:
    return v.cast("long").bitwiseOR(F.lit(1 << bit))


def clear_bit(v: Column, bit: int) -> Column:
    return v.cast("long").bitwiseAND(F.lit(~(1 << bit)))


def trailing_zeros(v: Column) -> Column:
    """Level of row v in a ruler sequence; 0 for 0."""
    low = v.cast("long").bitwiseAND(-v.cast("long"))
    return F.when(v == 0, F.lit(0)).otherwise(F.bit_count(low - 1))


def residual_bits(v: Column) -> Column:
    """What a residual holds beside its class: its zig-zag number plus one, without the highest bit."""
    u = zigzag(v) + 1
    return u - F.pow(F.lit(2.0), ilog2(u)).cast("long")
