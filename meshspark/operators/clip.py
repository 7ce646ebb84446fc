"""Clipping by planes and boxes: faces become several, and both sides of a cut edge share its new vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import discard, materialise

Plane = tuple[tuple[float, float, float], float]


def outcode(p: G.Vector, low: tuple, high: tuple) -> Column:
    """Six bits: below low and above high on x, y and z; a null coordinate sets none."""
    out = F.lit(0)
    for i, (v, a, b) in enumerate(zip(p, low, high, strict=True)):
        out = out + F.when(v < a, 1 << (2 * i)).when(v > b, 2 << (2 * i)).otherwise(0)
    return out


def _cut(faces: DataFrame, vertices: DataFrame, plane: Plane, carried: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((of, v0, v1, v2), new vertices, tables to discard) of faces (fid, of, v0, v1, v2): what lies on the plane's inner side."""
    n, offset = plane
    side = vertices.select("vid", (G.dot(G.vec(), tuple(F.lit(float(v)) for v in n)) - offset).alias("d"))
    at = faces
    for k in range(3):
        at = at.join(side.select(F.col("vid").alias(f"v{k}"), F.col("d").alias(f"d{k}")), f"v{k}")
    d = [F.col(f"d{k}") for k in range(3)]
    at = materialise(at.where((F.least(*d) < 0) | (F.greatest(*d) <= 0)), "sides")
    whole = at.where(F.greatest(*d) <= 0).select("of", "v0", "v1", "v2")
    # The ring of what is left: corners inside, and places on edges whose ends lie on different sides.
    ring = []
    for k in range(3):
        a, b = F.col(f"v{k}"), F.col(f"v{(k + 1) % 3}")
        none = F.lit(None).cast("long")
        ring.append(F.when(d[k] <= 0, F.struct(a.alias("vid"), none.alias("low"), none.alias("high"))))
        crossed = ((d[k] < 0) & (d[(k + 1) % 3] > 0)) | ((d[k] > 0) & (d[(k + 1) % 3] < 0))
        ring.append(F.when(crossed, F.struct(none.alias("vid"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))))
    parts = at.where(F.greatest(*d) > 0).select("fid", "of", F.filter(F.array(*ring), lambda r: r.isNotNull()).alias("ring"))
    parts = parts.select("fid", "of", "ring", F.explode(F.sequence(F.lit(1), F.size("ring") - 2)).alias("piece"))
    corner = F.posexplode(F.array(F.col("ring")[0], F.get("ring", F.col("piece")), F.get("ring", F.col("piece") + 1))).alias("k", "r")
    corners = materialise(parts.select("fid", "of", "piece", corner).select("fid", "of", "piece", "k", "r.*"), "corners")
    base = vertices.agg(F.max("vid").alias("m")).first()["m"] or 0
    edges = corners.where("low IS NOT NULL").select("low", "high").distinct()
    ids = materialise(edges.select("low", "high", (F.monotonically_increasing_id() + base + 1).alias("vid")), "cuts")
    ends = vertices.join(side.withColumnRenamed("vid", "_v"), F.col("vid") == F.col("_v")).select("vid", "d", *carried)
    end = lambda s: ends.select(F.col("vid").alias(s), *(F.col(c).cast("double").alias(f"{c}_{s}") for c in ("d", *carried)))
    t = F.col("d_low") / (F.col("d_low") - F.col("d_high"))
    new = ids.join(end("low"), "low").join(end("high"), "high").select("vid", *((F.col(f"{c}_low") + t * (F.col(f"{c}_high") - F.col(f"{c}_low"))).alias(c) for c in carried))
    named = corners.where("vid IS NOT NULL").select("fid", "of", "piece", "k", "vid").unionAll(corners.where("low IS NOT NULL").drop("vid").join(ids, ["low", "high"]).select("fid", "of", "piece", "k", "vid"))
    made = named.groupBy("fid", "of", "piece").agg(*(F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3))).select("of", "v0", "v1", "v2")
    return whole.unionAll(made), new, [at, corners, ids]


def by_planes(faces: DataFrame, vertices: DataFrame, planes: list[Plane], attributes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(faces (fid, of, v0, v1, v2), vertices (vid, x, y, z, attributes)): what lies where n . p <= offset for all planes.

    of: the face that a piece comes from; fid is new and distinct.  Pieces turn as their face does.  A cut edge gets one new
    vertex, whose place and attributes (numbers) are worked out from its lesser end on, so faces on both sides agree.
    Faces that only touch a plane from outside go; faces in it stay.  Faces with a missing or null corner go.
    Vertices that no face uses any more stay in the table.
    """
    carried = [*"xyz", *attributes]
    at = vertices.select("vid", *(F.col(c).cast("double").alias(c) for c in carried)).dropna(subset=[*"xyz"])
    left = faces.select("fid", F.col("fid").alias("of"), "v0", "v1", "v2")
    before: list[DataFrame] = []
    for plane in planes:
        kept, new, used = _cut(left, at, plane, carried)
        # Numbers of rows are fixed by writing them.
        left, more = materialise(kept.select(F.monotonically_increasing_id().alias("fid"), "of", "v0", "v1", "v2"), "clipped"), materialise(new, "cut")
        at = at.unionAll(more)
        discard(*before, *used)
        before = [left]
    return left, at


def box(faces: DataFrame, vertices: DataFrame, low: tuple, high: tuple, attributes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The same for a box; faces inside it pass, and those beyond one of its sides go, without being cut."""
    code = vertices.dropna(subset=[*"xyz"]).select("vid", outcode(G.vec(), low, high).alias("c"))
    at = faces.select("fid", "v0", "v1", "v2")
    for k in range(3):
        at = at.join(code.select(F.col("vid").alias(f"v{k}"), F.col("c").alias(f"c{k}")), f"v{k}")
    c = [F.col(f"c{k}") for k in range(3)]
    met = materialise(at.where(c[0].bitwiseAND(c[1]).bitwiseAND(c[2]) == 0), "met")
    unit = [tuple(float(i == k) for i in range(3)) for k in range(3)]
    planes = [(unit[k], float(high[k])) for k in range(3)] + [(tuple(-v for v in unit[k]), -float(low[k])) for k in range(3)]
    cut, at = by_planes(met.where(F.greatest(*c) > 0), vertices, planes, attributes)
    out = met.where(F.greatest(*c) == 0).select("fid", F.col("fid").alias("of"), "v0", "v1", "v2").unionAll(cut)
    return materialise(out.select(F.monotonically_increasing_id().alias("fid"), "of", "v0", "v1", "v2"), "boxed"), at
