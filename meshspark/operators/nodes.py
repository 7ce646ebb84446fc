"""What belongs to a node of a level-of-detail graph: sphere, cone of normals, descriptor; saturation of the graph.

A node holds a bounded number of vertices and faces, so a group of one node is a bounded task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import discard, materialise
from .mesh import face_normal

#: Rings around the mean normal, and the share of normals a cone must hold.
RINGS, SHARE = 50, 0.95


def _through(points: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The smallest sphere through all of up to four points; None if there is none."""
    rest = points[1:] - points[0]
    if not len(rest):
        return points[0], 0.0
    gram = 2 * rest @ rest.T
    if np.linalg.matrix_rank(gram) < len(rest):
        return None
    step = np.linalg.solve(gram, (rest**2).sum(1)) @ rest
    return points[0] + step, float(np.sqrt((step**2).sum()))


def _support(points: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The smallest sphere around up to five points, by trying all sets of up to four, and the set it stands on."""
    best = None
    for k in range(1, min(4, len(points)) + 1):
        for some in combinations(range(len(points)), k):
            got = _through(points[list(some)])
            if got is None or (best is not None and got[1] >= best[1]):
                continue
            if (np.linalg.norm(points - got[0], axis=1) <= got[1] * (1 + 1e-12) + 1e-300).all():
                best = (*got, points[list(some)])
    return best if best is not None else _roughly(points)


def _roughly(points: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """For points that rounding leaves without such a set: around the middle of the two farthest apart."""
    apart = np.linalg.norm(points[:, None] - points[None], axis=2)
    pair = points[list(np.unravel_index(apart.argmax(), apart.shape))]
    center = pair.mean(0)
    return center, float(np.linalg.norm(points - center, axis=1).max()), pair


def tight_sphere(points: np.ndarray, least: float = 1e-9) -> tuple[np.ndarray, float]:
    """The smallest sphere around points, but for a share `least` of its radius.

    It stands on four points at most.  Of a sphere on some the farthest point outside joins them, and the
    smallest sphere of those, five at most, is larger; when none is outside, it is the smallest of all.
    """
    center, radius, on = _support(points[:1])
    for _ in range(1000):  # each sphere is larger than the last; a few dozen do
        away = ((points - center) ** 2).sum(1)
        far = int(away.argmax())
        reach = float(np.sqrt(away[far]))
        if reach <= radius * (1 + least):
            break
        center, radius, on = _support(np.concatenate([on, points[far : far + 1]]))
    return center, max(radius, float(np.sqrt(((points - center) ** 2).sum(1).max()))) * (1 + 1e-12)


def enclosing_sphere(points: DataFrame, least: float = 1e-9) -> DataFrame:
    """One row (cx, cy, cz, radius, passes): the smallest sphere around all points (x, y, z); no row if there are none.

    The steps of tight_sphere with the farthest point found by an aggregate: every pass over the points gives the
    driver one point.  It starts from the extremes along the axes.  Points with null coordinates don't count.
    """
    points = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).dropna()
    row = F.struct(*"xyz")
    ends = points.agg(*(f(row, F.col(c)).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min_by, F.max_by))).first()
    kind = "cx double, cy double, cz double, radius double, passes int"
    if ends[0] is None:
        return points.sparkSession.createDataFrame([], kind)
    known = np.unique(np.array([tuple(e) for e in ends]), axis=0)
    center, radius = tight_sphere(known)
    on = known[np.linalg.norm(known - center, axis=1) >= radius * (1 - 1e-9)]
    on, passes = _support(on[:5])[2], 1
    while True:
        center, radius, _ = _support(on)
        away = sum((F.col(c) - F.lit(float(m))) ** 2 for c, m in zip("xyz", center, strict=True))
        far = points.agg(F.max_by(row, away).alias("p"), F.sqrt(F.max(away)).alias("reach")).first()
        passes += 1
        if far["reach"] <= radius * (1 + least) or passes > 200:
            break
        on = _support(np.concatenate([on, [tuple(far["p"])]]))[2]
    return points.sparkSession.createDataFrame([(*map(float, center), max(radius, far["reach"]), passes)], kind)


def spheres(vertices: DataFrame, by: str = "node") -> DataFrame:
    """(by, cx, cy, cz, radius) of vertices (by, x, y, z)."""

    def run(table: pa.Table) -> pa.Table:
        p = np.stack([table.column(c).to_numpy() for c in "xyz"], 1).astype(float)
        center, radius = tight_sphere(p)
        return pa.table({by: table.column(by).slice(0, 1).combine_chunks(), **{f"c{a}": [float(v)] for a, v in zip("xyz", center, strict=True)}, "radius": [radius]})

    kind = vertices.schema[by].dataType.simpleString()
    return vertices.select(by, *"xyz").groupBy(by).applyInArrow(run, f"{by} {kind}, cx double, cy double, cz double, radius double")


def sturdy(faces: DataFrame) -> DataFrame:
    """faces with unit normals and areas, without those too thin to have a normal: the doubled area is
    nothing beside the longer of the first corner's edges, in single precision."""
    n = face_normal(faces)
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    p = [G.vec(suffix=str(k)) for k in range(3)]
    longer = F.greatest(G.norm(G.sub(p[1], p[0])), G.norm(G.sub(p[2], p[0])))
    n = n.withColumn("_l", size).withColumn("_b", longer).where(F.col("_l") * 100_000 > F.least("_b", F.col("_b") + F.col("_l")))
    return n.withColumns({c: F.col(c) / F.col("_l") for c in ("nx", "ny", "nz")}).withColumn("area", F.col("_l") / 2).drop("_l", "_b")


def cones(normals: DataFrame, by: str = "node", weight: Column | None = None) -> DataFrame:
    """(by, ax, ay, az): each group's mean normal, over the cosine of the angle that holds SHARE of the weight.

    Zero where normals spread over too wide an angle.  normals: (by, nx, ny, nz) of length one.
    """
    w = F.lit(1.0) if weight is None else weight
    n = normals.select(by, "nx", "ny", "nz", w.alias("w"))
    mean = n.groupBy(by).agg(*(F.avg(c).alias(f"m{c[1]}") for c in ("nx", "ny", "nz")), F.sum("w").alias("all"))
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    mean = mean.withColumn("_l", size).select(by, "all", *(F.when(F.col("_l") > 0, F.col(c) / F.col("_l")).otherwise(F.lit(0.0)).alias(c) for c in ("mx", "my", "mz")))
    cos = F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz")
    ring = F.floor((RINGS - 1) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(cos, 12)))) / F.pi()).cast("int")
    rings = n.join(mean, by).groupBy(by, ring.alias("ring")).agg(F.sum("w").alias("w"), *(F.first(c).alias(c) for c in ("all", "mx", "my", "mz")))
    held = rings.withColumn("held", F.sum("w").over(W.partitionBy(by).orderBy("ring")))  # RINGS rows a group at most
    best = held.where(F.col("held") >= SHARE * F.col("all")).groupBy(by).agg(F.min("ring").alias("ring"), *(F.first(c).alias(c) for c in ("mx", "my", "mz")))
    alpha = F.pi() * (F.col("ring") + 1) / RINGS
    wide = alpha >= F.pi() / 2 - 0.1
    return best.select(by, *(F.when(wide, F.lit(0.0)).otherwise(F.col(f"m{c}") / F.cos(F.pi() / 2 - alpha)).alias(f"a{c}") for c in "xyz"))


def anchors(vertices: DataFrame, axes: DataFrame, by: str = "node") -> DataFrame:
    """(by, front, back): vertices of least and greatest projection on the group's axis (ax, ay, az); ties by vid."""
    v = vertices.join(axes, by)
    along = G.dot(G.vec(), (F.col("ax"), F.col("ay"), F.col("az")))
    row = F.struct("vid", "x", "y", "z")
    return v.groupBy(by).agg(F.min_by(row, F.struct(along, "vid")).alias("front"), F.max_by(row, F.struct(along, -F.col("vid"))).alias("back"))


def descriptors(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(node, nvert, nface, cx, cy, cz, radius, n0 .. n3) of vertices (node, vid, x, y, z) and faces (node, x0 .. z2)."""
    counts = vertices.groupBy("node").agg(F.count("*").alias("nvert")).join(faces.groupBy("node").agg(F.count("*").alias("nface")), "node", "left").fillna(0, ["nface"])
    packed = G.pack_cone(tuple(F.col(f"a{c}") for c in "xyz"))
    cone = cones(sturdy(faces)).select("node", *(v.alias(f"n{i}") for i, v in enumerate(packed)))
    return counts.join(spheres(vertices), "node").join(cone, "node", "left").fillna(0, [f"n{i}" for i in range(4)])


def heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, height): steps of the longest way down; edges (src, dst) between nodes, one join per level."""
    level, parts = materialise(nodes.select("node").join(edges.select(F.col("src").alias("node")), "node", "left_anti").withColumn("height", F.lit(0)), "heights"), []
    height = 0
    while level.limit(1).count():
        parts.append(level)
        height += 1
        up = edges.join(level.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        level = materialise(up.withColumn("height", F.lit(height)), "heights")
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionAll(p)
    return all_.groupBy("node").agg(F.max("height").alias("height"))


def saturated(nodes: DataFrame, edges: DataFrame, growth: float = 1.01) -> DataFrame:
    """nodes (node, error, cx, cy, cz, radius) with error and radius such that no parent has less than a child.

    From the leaves up: an error no greater than a child's becomes `growth` times that, child after
    child in order of `ordinal`; a radius grows to hold the children's spheres, then by `growth`.  Leaves
    stay.  edges: (src, ordinal, dst).
    """
    nodes = materialise(nodes.select("node", "error", "cx", "cy", "cz", "radius"), "nodes")  # every level reads them and the edges
    edges = materialise(edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("node").alias("src")), "src", "left_semi"), "edges")
    tall = materialise(nodes.join(heights(nodes, edges), "node"), "saturate")
    top = tall.agg(F.max("height").alias("h")).first()["h"] or 0
    done = tall.where("height = 0").drop("height")
    for h in range(1, top + 1):
        mine = tall.where(F.col("height") == h).drop("height")
        child = done.select(F.col("node").alias("dst"), F.col("error").alias("e"), *(F.col(c).alias(f"k{c}") for c in ("cx", "cy", "cz")), F.col("radius").alias("kr"))
        met = mine.join(edges, F.col("node") == F.col("src")).join(child, "dst")
        reach = G.norm(tuple(F.col(f"k{c}") - F.col(c) for c in ("cx", "cy", "cz"))) + F.col("kr")
        rows = met.groupBy("node", "error", "cx", "cy", "cz", "radius").agg(F.array_sort(F.collect_list(F.struct("ordinal", "e"))).alias("kids"), F.max(reach).alias("reach"))
        error = F.aggregate("kids", F.col("error"), lambda acc, k: F.when(acc <= k["e"], k["e"] * growth).otherwise(acc))
        new = rows.select("node", error.alias("error"), "cx", "cy", "cz", (F.greatest("radius", "reach") * growth).alias("radius"))
        done = materialise(done.unionAll(new), "saturate")
    return done


def unify_normals(vertices: DataFrame, levels: DataFrame) -> DataFrame:
    """(node, vid, nx, ny, nz): vertices of equal place get one normal.

    Of the nodes of level 0 (the finest) that share a place the normals are added up and packed anew; nodes above take the
    normal of the finest node there.  vertices: (node, vid, x, y, z, nx, ny, nz), levels: (node, level).
    """
    v = vertices.join(levels, "node")
    place = ["x", "y", "z"]
    sums = v.where("level = 0").groupBy(*place).agg(*(F.sum(c).alias(f"s{c}") for c in ("nx", "ny", "nz")), F.count("*").alias("n"))
    size = F.sqrt(F.col("snx") * F.col("snx") + F.col("sny") * F.col("sny") + F.col("snz") * F.col("snz"))
    made = [F.when(F.col("n") > 1, (F.col(f"s{c}") * 32766 / F.col("_l")).cast("int")).otherwise(F.col(f"s{c}")).alias(f"u{c}") for c in ("nx", "ny", "nz")]
    leaf = sums.withColumn("_l", size).select(*place, *made)
    finest = v.groupBy(*place).agg(F.min_by(F.struct("nx", "ny", "nz"), F.struct("level", "node")).alias("f"))
    both = finest.join(leaf, place, "left")
    at = both.select(*place, *(F.coalesce(F.col(f"u{c}"), F.col(f"f.{c}")).alias(f"w{c}") for c in ("nx", "ny", "nz")))
    return v.join(at, place).select("node", "vid", *(F.col(f"w{c}").alias(c) for c in ("nx", "ny", "nz")))


__all__ = ["anchors", "cones", "descriptors", "discard", "enclosing_sphere", "heights", "saturated", "spheres", "sturdy", "tight_sphere", "unify_normals"]
