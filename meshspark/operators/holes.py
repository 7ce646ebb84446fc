"""Border loops of a surface put in order, and filled with faces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dag import components
from ..tables import discard, materialise
from .mesh import edges


def border(faces: DataFrame) -> DataFrame:
    """(a, b): directed edges of one face only, as the face runs along them."""
    e = edges(faces).where("a <> b")
    u = e.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return u.where("n = 1").select("a", "b")


def simple_border(faces: DataFrame) -> DataFrame:
    """(loop, a, b) of loops that pass each of their vertices once; others, and open ends, are left out whole.

    loop: the least vertex of the loop.
    """
    b = materialise(border(faces), "border")
    comp = materialise(components(b).select("id", F.col("comp").alias("loop")), "loops")
    e = b.join(comp.withColumnRenamed("id", "a"), "a")
    out, into = (e.groupBy("loop", F.col(c).alias("v")).agg(F.count("*").alias(n)) for c, n in (("a", "go"), ("b", "come")))
    bad = out.join(into, ["loop", "v"], "full_outer").where("coalesce(go, 0) <> 1 OR coalesce(come, 0) <> 1").select("loop").distinct()
    return materialise(e.join(bad, "loop", "left_anti").select("loop", "a", "b"), "border")


def ranked(loops: DataFrame) -> DataFrame:
    """(loop, v, place) of loops (loop, a, b): places from 0 at the loop's least vertex, along its edges.

    List ranking: every vertex knows one further on and how far that is; in each round it takes what that one
    knows, so a loop of n vertices takes log2(n) rounds, all loops together.
    """
    first = F.col("a") == F.col("loop")
    at = materialise(loops.select("loop", F.col("a").alias("v"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("left")), "ranks")
    while at.where("to <> loop").limit(1).count():
        far = at.select("loop", F.col("v").alias("to"), F.col("to").alias("next"), F.col("left").alias("more"))
        before, at = at, materialise(at.join(far, ["loop", "to"]).select("loop", "v", F.col("next").alias("to"), (F.col("left") + F.col("more")).alias("left")), "ranks")
        discard(before)
    size = loops.groupBy("loop").agg(F.count("*").alias("n"))
    return at.join(size, "loop").select("loop", "v", F.when(F.col("left") == 0, F.lit(0)).otherwise(F.col("n") - F.col("left")).cast("long").alias("place"))


def triangulation(p: np.ndarray, barred: set[tuple[int, int]]) -> tuple[float, list[tuple[int, int, int]]]:
    """(area, triangles of places i < j < k) of least area over a closed polygon p (n, 3), by intervals.

    barred: pairs of places i < k that no side may join.  Without any triangulation: (inf, []).
    """
    n = len(p)
    cost, cut = np.zeros((n, n)), np.zeros((n, n), int)
    for width in range(2, n):
        for i in range(n - width):
            k = i + width
            j = np.arange(i + 1, k)
            area = np.linalg.norm(np.cross(p[j] - p[i], p[k] - p[i]), axis=1) / 2
            total = cost[i, j] + cost[j, k] + area
            best = int(total.argmin())
            cost[i, k], cut[i, k] = total[best], j[best]
            if (i, k) in barred and width < n - 1:
                cost[i, k] = np.inf
    if not np.isfinite(cost[0, n - 1]):
        return float("inf"), []
    out, todo = [], [(0, n - 1)]
    while todo:
        i, k = todo.pop()
        if k - i > 1:
            j = int(cut[i, k])
            out.append((i, j, k))
            todo += [(i, j), (j, k)]
    return float(cost[0, n - 1]), out


def _shortened(loops: DataFrame, all_edges: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """Loops cut down to `longest` edges, and the faces (loop, v0, v1, v2) that this made.

    In rounds, ears go whose vertex comes first, by a hash, of itself and its two neighbours, so a round takes about
    a third of a long loop at once and no task holds a loop.  An ear whose new side is an edge already stays.
    """
    made: list[DataFrame] = []
    while True:
        long = loops.groupBy("loop").agg(F.count("*").alias("n")).where(F.col("n") > longest)
        here = loops.join(long, "loop", "left_semi")
        ears = here.select("loop", F.col("a").alias("u"), F.col("b").alias("v")).join(here.select("loop", F.col("a").alias("v"), F.col("b").alias("w")), ["loop", "v"])
        turn = lambda c: F.struct(F.xxhash64(c, F.lit(len(made))), F.col(c))
        ears = ears.where((turn("v") < turn("u")) & (turn("v") < turn("w"))).withColumns({"p": F.least("u", "w"), "q": F.greatest("u", "w")})
        ears = materialise(ears.join(all_edges, ["p", "q"], "left_anti").select("loop", "u", "v", "w"), "ears")
        if not ears.limit(1).count():
            return loops, made
        # Of an ear's two sides its vertex stands at the end of one and at the start of the other.
        rest = loops.join(ears.select("loop", F.col("v").alias("a")), ["loop", "a"], "left_anti").join(ears.select("loop", F.col("v").alias("b")), ["loop", "b"], "left_anti")
        loops = materialise(rest.select("loop", "a", "b").unionAll(ears.select("loop", F.col("u").alias("a"), F.col("w").alias("b"))), "border")
        all_edges = materialise(all_edges.unionAll(ears.select(F.least("u", "w").alias("p"), F.greatest("u", "w").alias("q"))), "edges")
        made.append(ears.select("loop", F.col("w").alias("v0"), F.col("v").alias("v1"), F.col("u").alias("v2")))


def fill_holes(faces: DataFrame, vertices: DataFrame, longest: int = 128, largest: int | None = None) -> DataFrame:
    """(loop, v0, v1, v2): faces that close the holes of a mesh, turned as the faces around them.

    A loop of at most `longest` edges gets the triangulation of least area that uses no edge the mesh has already; of
    longer ones ears are cut first until they are that short.  Loops of more than `largest` edges, if given, stay
    open (as an outer border should), as do those that pass a vertex twice or have no such triangulation.
    """
    loops = simple_border(faces)
    if largest is not None:
        loops = materialise(loops.join(loops.groupBy("loop").agg(F.count("*").alias("n")).where(F.col("n") <= largest), "loop", "left_semi"), "border")
    every = edges(faces).where("a <> b").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    loops, made = _shortened(loops, materialise(every, "edges"), longest)
    # The least vertex names a loop for the ranks; an ear may have taken it.
    names = materialise(loops.groupBy("loop").agg(F.min("a").alias("low")), "names")
    places = materialise(ranked(loops.join(names, "loop").select(F.col("low").alias("loop"), "a", "b")).join(names.withColumnRenamed("loop", "of").withColumnRenamed("low", "loop"), "loop").select(F.col("of").alias("loop"), "v", "place"), "places")
    side = lambda s, e: places.select(F.col("loop"), F.col("v").alias(e), F.col("place").alias(s))
    sides = every.join(side("i", "p"), "p").join(side("k", "q"), ["q", "loop"]).select(F.col("loop").alias("of"), F.least("i", "k").alias("i"), F.greatest("i", "k").alias("k"))
    corner = places.join(vertices.select(F.col("vid").alias("v"), *"xyz"), "v").select("loop", "place", "v", *(F.col(c).cast("double").alias(c) for c in "xyz"))

    def fill(points: pa.Table, barred: pa.Table) -> pa.Table:
        points = points.sort_by("place")
        n = len(points)
        p = np.stack([points.column(c).to_numpy() for c in "xyz"], 1) if n else np.zeros((0, 3))
        v = points.column("v").to_numpy()
        pairs = {(i, k) for i, k in zip(barred.column("i").to_pylist(), barred.column("k").to_pylist(), strict=True) if 1 < k - i < n - 1}
        _, tri = triangulation(p, pairs) if n >= 3 else (0.0, [])
        cols = np.array([[v[k], v[j], v[i]] for i, j, k in tri], np.int64).reshape(-1, 3)
        return pa.table({"loop": pa.array([points.column("loop")[0].as_py()] * len(cols) if len(cols) else [], pa.int64()), **{f"v{k}": pa.array(np.ascontiguousarray(cols[:, k])) for k in range(3)}})

    out = corner.groupBy("loop").cogroup(sides.groupBy("of")).applyInArrow(fill, "loop long, v0 long, v1 long, v2 long")
    for m in made:
        out = out.unionAll(m)
    return out
