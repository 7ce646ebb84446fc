"""Samples that keep a distance from each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import apart, discard, materialise

#: Fixed value: how densely disks are taken to fill an area.
DENSITY = 0.7


def disk_radius(area: float, samples: int) -> float:
    """The radius at which about `samples` disks fit an area."""
    return math.sqrt(area / (DENSITY * math.pi * samples))


def disk_samples(area: float, radius: float) -> int:
    return int(area / (radius * radius * math.pi * DENSITY))


def poisson_disk(points: DataFrame, radius: float, seed: int = 0) -> tuple[DataFrame, int]:
    """((id, x, y, z) of the points kept, rounds): no two nearer than `radius`, every other one nearer than that to one kept.

    Points get a priority by a hash of their id.  Cells are small enough that one holds one sample at most.  In each
    round the first point of every cell is a candidate, candidates without a nearer candidate of higher priority are
    kept, and all points near those go.  So only candidates, one a cell, are ever paired with each other, however
    many points a cell holds, and a point goes only to the cells that come near enough; the result depends on ids and
    seed alone.  Rows with a null coordinate are dropped, and of rows with equal ids and places one counts.
    """
    side = radius / math.sqrt(3) * 0.999
    cell = [F.floor(F.col(c) / side).alias(f"c{i}") for i, c in enumerate("xyz")]
    left = points.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna(subset=[*"xyz"]).distinct()
    left = materialise(left.select("*", F.xxhash64("id", F.lit(seed)).alias("turn"), *cell), "left")
    steps = [(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3)]
    cells, order = ["c0", "c1", "c2"], F.struct("turn", "id", *"xyz")

    def gap(c: str, i: int) -> Column:
        """From the point to the cell `o` along one axis."""
        low = (F.col(f"c{i}") + F.col(f"o.o{i}")) * F.lit(side)
        return F.greatest(low - F.col(c), F.col(c) - low - side, F.lit(0.0))

    def beside(df: DataFrame, steps: list[tuple]) -> DataFrame:
        """Points with each cell a step away that comes nearer than `radius`."""
        o = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{i}") for i, v in enumerate(step))) for step in steps))).alias("o")
        reached = sum((gap(c, i) * gap(c, i) for i, c in enumerate("xyz")), F.lit(0.0)) < radius * radius * (1 + 1e-6)
        return df.select("*", o).where(reached).select("id", *"xyz", "turn", *((F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(3)))

    near = lambda a, b: G.distance2(G.vec(a), G.vec(b)) < radius * radius
    named = lambda df, s: df.select(*cells, *(F.col(c).alias(f"{s}{c}") for c in ("id", *"xyz", "turn")))
    kept, rounds = [], 0
    while left.limit(1).count():
        rounds += 1
        first = materialise(left.groupBy(*cells).agg(F.min_by(F.struct("id", *"xyz", "turn"), order).alias("p")).select("p.*", *cells), "candidates")
        # Of two cells one meets the other, so a pair comes once; either of its points may be the later one.
        pairs = named(beside(first, [o for o in steps if o > (0, 0, 0)]), "p").join(apart(named(first, "q")), cells).where(near("p", "q"))
        point = lambda s: F.struct(*(F.col(f"{s}{c}").alias(c) for c in ("turn", "id", *"xyz")))
        blocked = pairs.select(F.greatest(point("p"), point("q")).alias("b")).select(*(f"b.{c}" for c in ("id", *"xyz"))).distinct()
        chosen = materialise(first.join(apart(blocked), ["id", *"xyz"], "left_anti"), "kept")
        gone = named(beside(chosen, steps), "p").join(apart(named(left, "q")), cells).where(near("p", "q")).select(*(F.col(f"q{c}").alias(c) for c in ("id", *"xyz"))).distinct()
        before, left = left, materialise(left.join(apart(gone), ["id", *"xyz"], "left_anti"), "left")
        discard(before, first)
        kept.append(chosen.select("id", *"xyz"))
    out = kept[0] if kept else left.select("id", *"xyz")
    for k in kept[1:]:
        out = out.unionAll(k)
    return out, rounds


def poisson_disk_of(points: DataFrame, samples: int, area: float, slack: float = 0.05, most: int = 20, seed: int = 0) -> tuple[DataFrame, float]:
    """(points kept, the radius): about `samples` of them, within `slack`, or as near as `most` halvings of the range of radii come."""
    low, high, best = 0.0, 2 * disk_radius(area, samples), None
    for _ in range(most):
        radius = (low + high) / 2
        got = poisson_disk(points, radius, seed)[0]
        n = got.count()
        if best is None or abs(n - samples) < abs(best[2] - samples):
            best = got, radius, n
        if abs(n - samples) <= slack * samples:
            break
        low, high = (radius, high) if n > samples else (low, radius)
    return best[0], best[1]
