"""Operators on point sets: boxes, order statistics, neighbours, KD cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import materialise
from .prefix import running


def bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def order_statistic(points: DataFrame, column: str, tie: list[str], ratio: float) -> DataFrame:
    """The value at place floor(n * ratio) in rising order."""
    n = points.count()
    return running(points, [column, *tie], number="_n").where(F.col("_n") == int(n * ratio) + 1).select(F.col(column).alias("split"))


def spacing(points: DataFrame, by: list[str]) -> DataFrame:
    """8 * sqrt(volume ** (2/3) / n) of each group's box."""
    b = bounds(points, by).join(points.groupBy(*by).agg(F.count("*").alias("n")), by)
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    return b.select(*by, (8 * F.sqrt(F.pow(volume, F.lit(2 / 3)) / F.col("n"))).alias("spacing"))


def within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(q, p, d2) with d2 < radius ** 2: an equi join of grid cells, each query in its 27 cells."""
    cells = [F.floor(F.col(c) / radius) for c in "xyz"]
    p = points.select(F.col("id").alias("p"), *(F.col(c).alias(f"p{c}") for c in "xyz"), *(v.alias(f"c{i}") for i, v in enumerate(cells)))
    near = [F.explode(F.sequence(v - 1, v + 1)).alias(f"c{i}") for i, v in enumerate(cells)]
    q = queries.select(F.col("id").alias("q"), *(F.col(c).alias(f"q{c}") for c in "xyz"), *(F.col(c) for c in "xyz"))
    for e in near:
        q = q.select("*", e)
    d2 = G.distance2(G.vec("q"), G.vec("p"))
    return q.drop("x", "y", "z").join(p, ["c0", "c1", "c2"]).select("q", "p", d2.alias("d2")).where(F.col("d2") < radius * radius)


def nearest(queries: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """(q, p, d2, rank): the k nearest points, ties by id.

    Cells of growing size are searched; a query is done when its k-th neighbour is nearer than the
    searched radius, so no query meets all points unless the set is small.  The search ends when the
    radius spans the box around all points and queries, so fewer than k points are found whole.  Rows
    with a null coordinate are near nothing.
    """
    whole = " AND ".join(f"{c} IS NOT NULL" for c in "xyz")
    left, points = queries.select("id", *"xyz").where(whole), points.select("id", *"xyz").where(whole)
    box = bounds(left.unionAll(points)).first()
    span = sum((float(box[f"max_{c}"]) - float(box[f"min_{c}"])) ** 2 for c in "xyz") ** 0.5 if box["min_x"] is not None else 0.0
    out = None
    while True:
        last = radius > span
        found = within(left, points, radius)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d2", "p"))).where(F.col("rank") <= k)
        ranked = materialise(ranked, "near")
        full = ranked.groupBy("q").agg(F.count("*").alias("n")).where(F.lit(last) | (F.col("n") >= k)).select("q")
        done = ranked.join(full, "q", "left_semi")
        out = done if out is None else out.unionAll(done)
        if last:
            return out
        left = materialise(left.join(full.withColumnRenamed("q", "id"), "id", "left_anti"), "left")
        if not left.limit(1).count():
            return out
        radius *= 2


def route(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Points with their cell; cells (cell, axis, mid, child0, child1) form a tree from cell 0.

    One join per level: every point steps into the child on its side of the split.
    """
    at = points.withColumn("cell", F.lit(0).cast("long"))
    depth = cells.agg(F.max("level").alias("d")).first()["d"]
    for _ in range(depth or 0):
        step = cells.select("cell", "axis", "mid", "child0", "child1")
        v = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
        to = F.when(F.col("child0").isNull(), F.col("cell")).when(v < F.col("mid"), F.col("child0")).otherwise(F.col("child1"))
        at = at.join(step, "cell", "left").select(*points.columns, F.coalesce(to, F.col("cell")).alias("cell"))
    return at


def stride_sample(points: DataFrame, order: list[str], keep: int, total: int) -> DataFrame:
    """`keep` rows at even places of the order: those whose number is floor(k * total / keep)."""
    numbered = running(points, order, number="_n").withColumn("_n", F.col("_n") - 1)
    step = total / keep
    k = F.ceil(F.col("_n") / F.lit(step))
    return numbered.where((F.floor(k * F.lit(step)) == F.col("_n")) & (k < keep)).drop("_n")


def overlaps(boxes: DataFrame, size: float) -> DataFrame:
    """(a, b), a < b, of boxes that meet: an equi join of the cells of `size` they cover, then the test."""
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"min_{c}") / size), F.floor(F.col(f"max_{c}") / size))).alias(f"c{c}")
    covered = boxes
    for c in "xyz":
        covered = covered.select("*", span(c))
    cols = ["id", *(f"{m}_{c}" for c in "xyz" for m in ("min", "max"))]
    side = lambda s: covered.select("cx", "cy", "cz", *(F.col(c).alias(f"{c}_{s}") for c in cols))
    meet: Column = F.col("id_a") < F.col("id_b")
    for c in "xyz":
        meet &= (F.col(f"min_{c}_a") <= F.col(f"max_{c}_b")) & (F.col(f"min_{c}_b") <= F.col(f"max_{c}_a"))
    return side("a").join(side("b"), ["cx", "cy", "cz"]).where(meet).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
