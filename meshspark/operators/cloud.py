"""Point clouds: planes through neighbours, normals that agree along a spanning forest, outliers.

Points are (id, x, y, z) with distinct ids; rows with a null coordinate are left out, other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import eigen
from ..functions import geometry as G
from ..tables import discard, materialise
from .points import nearest

#: Coefficients of 1, v, v ** 2, ... under an outlier's score.
SCORE = (1.0, 0.278393, 0.230389, 0.000972, 0.078108)
#: Fixed value: neighbours whose normals have a smaller cosine don't pass a direction on.
COSINE = 0.3


def fitted(points: DataFrame, near: DataFrame) -> DataFrame:
    """(id, n, planes): eigenvalues and vectors of the covariance of each point's neighbours (q, p).

    The first vector is the normal of the plane through them.  Sums are taken about the point itself.  Where the neighbours
    lie on one line the normal is some direction across it; in one place, any.
    """
    side = lambda s: points.select(F.col("id").alias(s), *(F.col(c).cast("double").alias(f"{s}{c}") for c in "xyz"))
    d = dict(zip("xyz", G.sub(G.vec("p"), G.vec("q")), strict=True))
    rows = near.select("q", "p").join(side("p"), "p").join(side("q"), "q").select("q", *(v.alias(c) for c, v in d.items()))
    sums = rows.groupBy("q").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), *(F.avg(F.col(k[0]) * F.col(k[1])).alias(k) for k in eigen.CELLS))
    cov = [F.col(k) - F.col(k[0]) * F.col(k[1]) for k in eigen.CELLS]
    return sums.select(F.col("q").alias("id"), "n", eigen.symmetric(*cov).alias("planes"))


def normals(points: DataFrame, k: int = 10, radius: float = 1.0, farthest: float | None = None) -> DataFrame:
    """(id, nx, ny, nz, variation): the normal, with either sign, of the plane through the k nearest points, itself included.

    Points at `farthest` or beyond don't count.  variation: share of the least of the three variances, 0 on a plane.
    radius: what the search for neighbours starts with.
    """
    near = nearest(points, points, k, radius)
    if farthest is not None:
        near = near.where(F.col("d2") < farthest * farthest)
    value = lambda i: F.col("planes")[i]["value"]
    share = F.coalesce(F.try_divide(F.greatest(value(0), F.lit(0.0)), value(0) + value(1) + value(2)), F.lit(0.0))
    return fitted(points, near).select("id", *(F.col("planes")[0]["vector"][c].alias(f"n{c}") for c in "xyz"), share.alias("variation"))


def spanning_forest(ids: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, root, turn), (a, b) of the forest): the minimum spanning forest of links (a, b, weight, turn), by rounds.

    In each round every tree takes its lightest link to another one, ties by the link's ends, and trees that hang
    together become one; links inside a tree go, and of those between two trees the lightest stays.  turn of an id:
    the turns of the links to its tree's root, added up modulo 2.  The number of trees at least halves a round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    first = links.where("a <> b AND weight IS NOT NULL").groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.struct("weight", "turn")).alias("w"))
    left = materialise(first.select("a", "b", F.struct("w.weight", F.col("a").alias("ka"), F.col("b").alias("kb")).alias("key"), F.col("w.turn").cast("int").alias("turn")), "links")
    label = materialise(ids.select("id", F.col("id").alias("root"), F.lit(0).alias("turn")).distinct(), "label")
    taken = []
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("c"), F.col("b").alias("to"), "key", "turn").unionAll(left.select(F.col("b").alias("c"), F.col("a").alias("to"), "key", "turn"))
        best = materialise(ends.groupBy("c").agg(F.min(F.struct("key", "to", "turn")).alias("m")).select("c", "m.key", "m.to", "m.turn"), "best")
        taken.append(best.select("key.ka", "key.kb").distinct())
        # Two trees that take the same link would point at each other: the lesser id is the root.
        root = F.col("back").isNotNull() & (F.col("c") < F.col("to"))
        up = best.join(best.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(1).alias("back")), ["c", "to"], "left")
        up = materialise(up.select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("to"), F.when(root, 0).otherwise(F.col("turn")).alias("turn")), "up")
        while True:
            above = up.select(F.col("c").alias("to"), F.col("to").alias("top"), F.col("turn").alias("more"))
            step = materialise(up.join(above, "to").select("c", F.col("top").alias("to"), F.col("turn").bitwiseXOR(F.col("more")).alias("turn"), (F.col("top") != F.col("to")).alias("moved")), "up")
            moved = step.where("moved").limit(1).count()
            discard(up)
            up = step.drop("moved")
            up.shared_path = step.shared_path
            if not moved:
                break
        tree = lambda c, t: up.select(F.col("c").alias(c), F.col("to").alias(f"{c}_to"), F.col("turn").alias(t))
        new = materialise(label.join(tree("root", "t"), "root", "left").select("id", F.coalesce("root_to", "root").alias("root"), F.col("turn").bitwiseXOR(F.coalesce("t", F.lit(0))).alias("turn")), "label")
        between = left.join(tree("a", "ta"), "a").join(tree("b", "tb"), "b").where("a_to <> b_to")
        turn = F.col("turn").bitwiseXOR(F.col("ta")).bitwiseXOR(F.col("tb"))
        rest = between.groupBy(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).agg(F.min(F.struct("key", turn.alias("turn"))).alias("m"))
        rest = materialise(rest.select("a", "b", "m.key", "m.turn"), "links")
        discard(left, label, up)
        left, label = rest, new
    forest = left.select("key.ka", "key.kb")
    for t in taken:
        forest = forest.unionAll(t)
    return label, forest.select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def coherent(directions: DataFrame, near: DataFrame, least: float = COSINE) -> DataFrame:
    """(id, nx, ny, nz, root): directions (id, nx, ny, nz) turned so that they agree along a minimum spanning forest.

    Links are neighbours (q, p) whose directions have a cosine of `least` or more, whatever their signs; the nearer to 1 the
    lighter.  Of each tree the root, one of its points, keeps its sign.  Points without links keep theirs.
    """
    unit = materialise(directions.select("id", "nx", "ny", "nz"), "directions")
    side = lambda s: unit.select(F.col("id").alias(s), *(F.col(f"n{c}").alias(f"{s}{c}") for c in "xyz"))
    pairs = near.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    cosine = G.dot(G.vec("a"), G.vec("b"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", cosine.alias("cos")).where(F.abs("cos") >= least)
    label, _ = spanning_forest(unit, links.select("a", "b", (1 - F.abs("cos")).alias("weight"), F.when(F.col("cos") < 0, 1).otherwise(0).alias("turn")))
    sign = F.when(F.col("turn") == 1, -1.0).otherwise(1.0)
    return unit.join(label, "id").select("id", *((F.col(f"n{c}") * sign).alias(f"n{c}") for c in "xyz"), "root")


def towards(points: DataFrame, directions: DataFrame, viewpoint: tuple[float, float, float]) -> DataFrame:
    """directions (id, nx, ny, nz) with the sign that looks at the viewpoint."""
    n = tuple(F.col(f"n{c}") for c in "xyz")
    to = G.dot(n, G.sub(tuple(F.lit(float(v)) for v in viewpoint), G.vec()))
    sign = F.when(to < 0, -1.0).otherwise(1.0)
    return directions.join(points.select("id", *"xyz"), "id").select("id", *((c * sign).alias(f"n{k}") for c, k in zip(n, "xyz", strict=True)))


def _score(v: Column) -> Column:
    below = F.lit(0.0)
    for k in reversed(SCORE):
        below = below * v + k
    return F.greatest(F.lit(0.0), 1 - F.try_divide(F.lit(1.0), below))


def outlier_scores(points: DataFrame, k: int, radius: float = 1.0) -> DataFrame:
    """(id, score): how much sparser a point's neighbourhood is than its k nearest points' (itself included), 0 to 1.

    The root mean square distance to them is set against the mean of theirs; the excess goes by its root mean square
    over all points.  Where all are alike, or all in one place, every score is 0.
    """
    near = materialise(nearest(points, points, k, radius).select("q", "p", "d2"), "near")
    sigma = materialise(near.groupBy("q").agg(F.sqrt(F.avg("d2")).alias("sigma")), "sigma")
    other = near.join(sigma.select(F.col("q").alias("p"), "sigma"), "p").groupBy("q").agg(F.avg("sigma").alias("around"))
    excess = materialise(sigma.join(other, "q").select("q", F.coalesce(F.try_divide("sigma", "around") - 1, F.lit(0.0)).alias("excess")), "excess")
    size = excess.agg(F.sqrt(F.avg(F.col("excess") * F.col("excess"))).alias("s")).first()["s"] or 0.0
    v = F.col("excess") / (size * 2**0.5) if size else F.lit(0.0)
    return excess.select(F.col("q").alias("id"), _score(v).alias("score"))


def without_outliers(points: DataFrame, k: int, threshold: float, radius: float = 1.0) -> DataFrame:
    """points whose score is not over the threshold."""
    return points.join(outlier_scores(points, k, radius).where(F.col("score") > threshold).select("id"), "id", "left_anti")
