"""Building a level-of-detail graph from triangles: partition, simplify with locked borders, repeat.

Every level is a few Spark jobs: the triangles are dealt into cells of a KD tree of bounded size, each cell
becomes a node, and its simplified triangles, whose border vertices don't move, are the next level's
input.  A triangle remembers the node it came from: those pairs are the graph's patches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import discard, materialise

CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]
#: The split's place by level parity, the margin around all, and where a build gives up.
RATIOS, MARGIN, SHRINK = (0.6666, 0.3333), 0.01, 0.7
CELL = "cell long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"


#: Of one pass over the triangles: leaves made at most, and sampled triangles for each.
PASS_LEAVES, SAMPLES, DEEPEST = 8192, 64, 60


@dataclass
class Tree:
    """Split cells as arrays: `axis` is -1 at a leaf; children `low` and `high`; half-open `box` (n, 2, 3); `cell`, a leaf's number."""

    axis: np.ndarray
    mid: np.ndarray
    low: np.ndarray
    high: np.ndarray
    box: np.ndarray
    cell: np.ndarray

    def leaves(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf of each triangle p (n, 3, 3) from node `at` on: the side with more of its corners that are in the
        cell; on a tie the upper one."""
        at = at.copy()
        going = np.flatnonzero(self.axis[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = np.where(self.upper(p[going], node), self.high[node], self.low[node])
            going = going[self.axis[at[going]] >= 0]
        return at

    def upper(self, p: np.ndarray, node: np.ndarray) -> np.ndarray:
        inside = ((p >= self.box[node, None, 0]) & (p < self.box[node, None, 1])).all(2)
        along = np.take_along_axis(p, self.axis[node][:, None, None], 2)[:, :, 0] >= self.mid[node][:, None]
        return (inside & along).sum(1) >= (inside & ~along).sum(1)


def _grow(p: np.ndarray, of: np.ndarray, full: dict[int, tuple[np.ndarray, int]], rate: float, capacity: int, ratio: float, adaptivity: float, first: int) -> tuple[Tree, set[int]]:
    """A tree over sampled triangles p of full cells, (box, triangles) by number; new leaves are numbered from `first`.

    A cell is split while it is too full by the sample, along the longest side of what it holds, at the place
    below which `ratio` of the first corners lie, held near the middle.  Also the leaves that can't be split.
    """
    stuck: set[int] = set()
    order = np.argsort(of, kind="stable")
    at = {cell: order[slice(*np.searchsorted(of, [cell, cell + 1], sorter=order))] for cell in full}
    todo = [(at[cell], box, n, 0) for cell, (box, n) in full.items()]
    rows: list[list] = [[-1, 0.0, -1, -1, box, cell] for cell, (box, _) in full.items()]
    waiting = list(zip(range(len(rows)), todo, strict=True))
    most = capacity if rate >= 1 else capacity * 0.85
    while waiting:
        k, (mine, box, n, depth) = waiting.pop()
        if n <= most or len(mine) < (2 if rate >= 1 else SAMPLES // 8) or depth > DEEPEST:
            if n > most and (rate >= 1 or depth > DEEPEST):
                stuck.add(k)
            continue
        q = p[mine]
        span = q.max((0, 1)) - q.min((0, 1))
        axis = int(span.argmax())
        low, high = box[0, axis], box[1, axis]
        first_corners = q[:, 0, axis]
        place = np.partition(first_corners, int(ratio * len(q)))[int(ratio * len(q))]
        middle, reach = (low + high) / 2, (high - low) / 2 * adaptivity
        mid = min(max(place, middle - reach), middle + reach)
        if not span[axis] or not low < mid < high:
            stuck.add(k)
            continue
        sides = [box.copy(), box.copy()]
        sides[0][1, axis] = sides[1][0, axis] = mid
        inside = ((q >= box[0]) & (q < box[1])).all(2)
        along = q[:, :, axis] >= mid
        up = (inside & along).sum(1) >= (inside & ~along).sum(1)
        rows[k][:4] = [axis, mid, len(rows), len(rows) + 1]
        for side, chosen in ((0, ~up), (1, up)):
            waiting.append((len(rows), (mine[chosen], sides[side], int(chosen.sum() / max(rate, 1e-300)) if rate < 1 else int(chosen.sum()), depth + 1)))
            rows.append([-1, 0.0, -1, -1, sides[side], first])
            first += 1
    cols = list(zip(*rows, strict=True))
    tree = Tree(*(np.array(c, t) for c, t in zip(cols[:4], (np.int64, float, np.int64, np.int64), strict=True)), np.array(cols[4]), np.array(cols[5], np.int64))
    return tree, {int(tree.cell[k]) for k in stuck if tree.axis[k] < 0}


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in CORNERS], 1).astype(float, copy=False).reshape(-1, 3, 3)


def partition(triangles: DataFrame, capacity: int, level: int = 0, adaptivity: float = 0.333) -> tuple[DataFrame, DataFrame]:
    """(triangles with `cell`, cells): a KD tree whose leaves hold `capacity` triangles at most.

    One pass finds the box of all, one draws a sample of bounded size, from which the tree is grown on the
    driver; it goes to the tasks as a few arrays (PASS_LEAVES * 8 leaves at most) and every triangle walks down
    it in one more pass.  Cells that the sample left too full, or that the bound kept from splitting, go
    through further passes of the same kind, PASS_LEAVES of them at a time.  Where all triangles fit the
    sample the tree is exact and no pass checks it.  A cell that no plane parts (equal triangles) stays
    too full.  Boxes are half open.  Without triangles there are no cells.
    """
    spark = triangles.sparkSession
    corner = [G.vec(suffix=str(k)) for k in range(3)]
    ends = [f(*(corner[k][i] for k in range(3))) for i in range(3) for f in (F.least, F.greatest)]
    whole = triangles.agg(F.count("*").alias("n"), *((F.max if i % 2 else F.min)(e).alias(f"e{i}") for i, e in enumerate(ends))).first()
    at = triangles.withColumn("cell", F.lit(0).cast("long"))
    if not whole["n"]:
        return at, spark.createDataFrame([], CELL)
    box = np.array([[whole[f"e{2 * i + j}"] for i in range(3)] for j in range(2)], float)
    margin = float(np.sqrt(((box[1] - box[0]) ** 2).sum())) * MARGIN or MARGIN
    cells = _cells(spark, {0: box + np.array([[-margin], [margin]])}, set())
    full, first = [(0, whole["n"], *_row(0, box + np.array([[-margin], [margin]]))[1:])] if whole["n"] > capacity else [], 1
    while full:
        room, chosen = PASS_LEAVES, {}
        for c, n, *sides in full:  # the fullest first, as many as one tree has room for, and always one
            if chosen and room <= 0:
                break
            chosen[c], room = (np.array(sides[:6], float).reshape(3, 2).T, n), room - 2 * n // capacity
        rate = min(1.0, PASS_LEAVES * SAMPLES / sum(n for _, n in chosen.values()))
        drawn = at.where(F.col("cell").isin(list(chosen))).select("cell", *CORNERS)
        sample = (drawn.where(F.rand(11) < rate) if rate < 1 else drawn).toArrow()
        p, of = _matrix(sample), sample.column("cell").to_numpy()
        del sample  # the driver's memory holds the sample once
        tree, stuck = _grow(p, of, chosen, rate, capacity, RATIOS[level % 2], adaptivity, first)
        del p, of
        leaf = np.flatnonzero(tree.axis < 0)
        grown = {int(tree.cell[k]): tree.box[k] for k in leaf}
        first += len(tree.cell)
        before, at = at, materialise(_walked(at, tree, list(chosen)), "cells")
        made = _cells(spark, grown, stuck | (set(chosen) & set(grown)))  # a cell that didn't split won't
        cells = made if len(chosen) == 1 and 0 in chosen else materialise(cells.where(~F.col("cell").isin(list(chosen))).unionAll(made), "boxes")
        if hasattr(before, "shared_path"):
            discard(before)
        if rate == 1 and len(chosen) == len(full) < PASS_LEAVES:
            break
        counts = at.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > capacity)
        sides = [f.name for f in cells.schema if f.name not in ("cell", "final")]
        full = [tuple(r) for r in counts.join(cells.where(~F.col("final")), "cell").orderBy(F.desc("n"), "cell").select("cell", "n", *sides).limit(PASS_LEAVES).collect()]
    return at, cells.drop("final")


def _row(cell: int, box: np.ndarray) -> tuple:
    return (cell, *(float(box[j, i]) for i in range(3) for j in range(2)))


def _cells(spark: SparkSession, boxes: dict[int, np.ndarray], final: set[int]) -> DataFrame:
    return spark.createDataFrame([(*_row(c, b), c in final) for c, b in boxes.items()], f"{CELL}, final boolean")


def _walked(at: DataFrame, tree: Tree, roots: list[int]) -> DataFrame:
    """Triangles with the cells they come to; those of other cells stay."""
    kept, keys = [f.name for f in at.schema if f.name != "cell"], np.array(roots, np.int64)
    order = np.argsort(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            place = np.minimum(np.searchsorted(keys[order], cell), len(keys) - 1)
            mine = np.flatnonzero(keys[order][place] == cell)
            cell = cell.copy()
            cell[mine] = tree.cell[tree.leaves(_matrix(b)[mine], order[place[mine]])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(cell, pa.int64())], names=[*kept, "cell"])

    return at.select(*kept, "cell").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema if f.name != "cell") + ", cell long")


def _inside(k: int) -> Column:
    """The k-th corner lies in the box of the row's cell."""
    return G.in_box(G.vec(suffix=str(k)), tuple(F.col(f"min_{c}") for c in "xyz"), tuple(F.col(f"max_{c}") for c in "xyz"))


def weld(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, faces) of corners (n, 3, 3): equal places become one vertex; faces of two corners go."""
    v, f = np.unique(p.reshape(-1, 3), axis=0, return_inverse=True)
    f = f.reshape(-1, 3)
    return v, f[(f[:, 0] != f[:, 1]) & (f[:, 1] != f[:, 2]) & (f[:, 0] != f[:, 2])]


#: Places of a symmetric 4 x 4 matrix's ten numbers.
UPPER = np.triu_indices(4)
WHOLE = np.array([[0, 1, 2, 3], [1, 4, 5, 6], [2, 5, 7, 8], [3, 6, 8, 9]])


def _planes(v: np.ndarray, f: np.ndarray) -> np.ndarray:
    n = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    return np.concatenate([n, -(n * v[f[:, 0]]).sum(1, keepdims=True)], 1)


def vertex_quadrics(v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """(n, 10): of each vertex, the sum of its faces' squared plane distances."""
    planes = _planes(v, f)
    of = planes[:, UPPER[0]] * planes[:, UPPER[1]]
    return np.stack([np.bincount(f.ravel(), np.repeat(of[:, k], 3), len(v)) for k in range(10)], 1)


def _value(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, y, z = p.T
    return x * (q[:, 0] * x + 2 * (q[:, 1] * y + q[:, 2] * z + q[:, 3])) + y * (q[:, 4] * y + 2 * (q[:, 5] * z + q[:, 6])) + z * (q[:, 7] * z + 2 * q[:, 8]) + q[:, 9]


def _places(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, error) of least quadric error for each edge: the minimum, else an end or the middle."""
    tries = np.stack([a, b, (a + b) / 2])
    errors = np.stack([_value(q, t) for t in tries])
    best = errors.argmin(0)
    place, error = tries[best, np.arange(len(a))], errors.min(0)
    m = q[:, WHOLE[:3, :3]]
    across = np.stack([np.cross(m[:, 1], m[:, 2]), np.cross(m[:, 2], m[:, 0]), np.cross(m[:, 0], m[:, 1])], 1)
    det = (m[:, 0] * across[:, 0]).sum(1)
    fit = np.flatnonzero(np.abs(det) > 1e-9)
    p = -(across[fit] * q[fit][:, WHOLE[3, :3], None]).sum(1) / det[fit, None]
    near = np.linalg.norm(p - tries[2][fit], axis=1) <= 2 * np.linalg.norm(a[fit] - b[fit], axis=1)
    place[fit[near]], error[fit[near]] = p[near], _value(q[fit[near]], p[near])
    return place, error


def _least(of: np.ndarray, value: np.ndarray, n: int, none: int) -> np.ndarray:
    """Smallest value of each of n keys."""
    out = np.full(n, none)
    np.minimum.at(out, of, value)
    return out


def _common_neighbours(keys: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many vertices are joined to both ends of each pair; keys: sorted low * n + high of all edges."""
    both = np.sort(np.concatenate([keys, keys % n * n + keys // n]))
    first = np.searchsorted(both, np.stack([a, a + 1]) * n)
    size = first[1] - first[0]
    total = np.append(0, np.cumsum(size))
    pair = np.repeat(np.arange(len(a)), size)
    near = both[np.repeat(first[0] - total[:-1], size) + np.arange(total[-1])] % n
    want = b[pair] * n + near
    at = np.minimum(np.searchsorted(both, want), len(both) - 1)
    return np.bincount(pair[both[at] == want], minlength=len(a))


def simplify(v: np.ndarray, f: np.ndarray, locked: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Quadric edge collapse, in rounds: of all edges without a locked end, those cheapest around all
    their faces collapse together, down to `target` faces or until none may.

    An edge may collapse if its ends share as many neighbours as faces (the surface stays one), and no
    face around turns over.  locked: vertices that neither move nor go.  A round is a few array
    operations over all edges: faces around two chosen edges are never the same, so each is judged by itself.
    """
    v, f, n = v.copy(), f.copy(), len(v)
    q = vertex_quadrics(v, f)
    refused = np.zeros(0, np.int64)
    while len(f) > target:
        half = np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1)
        keys, sides = np.unique(half[:, 0] * n + half[:, 1], return_counts=True)
        ok = ~(locked[keys // n] | locked[keys % n])
        if len(refused):
            ok &= ~np.isin(keys, refused)
        a, b, share = keys[ok] // n, keys[ok] % n, sides[ok]
        if not len(a):
            break
        place, error = _places(q[a] + q[b], v[a], v[b])
        rank = np.empty(len(a), np.int64)
        rank[np.argsort(error, kind="stable")] = np.arange(len(a))
        none = len(a)
        least = _least(np.concatenate([a, b]), np.concatenate([rank, rank]), n, none)
        face = least[f].min(1)
        around = _least(f.ravel(), np.repeat(face, 3), n, none)
        chosen = np.flatnonzero((around[a] == rank) & (around[b] == rank))
        # Faces with an end of a chosen edge, by that edge; none has ends of two.
        own = np.full(n, -1)
        own[a[chosen]] = own[b[chosen]] = np.arange(len(chosen))
        edge = own[f].max(1)
        near = np.flatnonzero(edge >= 0)
        mine, edge = f[near], edge[near]
        ends = (mine == a[chosen][edge][:, None]) | (mine == b[chosen][edge][:, None])
        before = v[mine]
        after = np.where(ends[:, :, None], place[chosen][edge][:, None], before)
        turned = (np.cross(before[:, 1] - before[:, 0], before[:, 2] - before[:, 0]) * np.cross(after[:, 1] - after[:, 0], after[:, 2] - after[:, 0])).sum(1) <= 0
        stay = ends.sum(1) == 1
        bad = np.bincount(edge[stay & turned], minlength=len(chosen)) > 0
        bad |= _common_neighbours(keys, n, a[chosen], b[chosen]) != share[chosen]
        refused = np.union1d(refused, keys[ok][chosen[bad]])
        good = chosen[~bad]
        good = good[np.argsort(rank[good])]
        good = good[len(f) - np.cumsum(share[good]) + share[good] > target]
        v[a[good]], q[a[good]] = place[good], q[a[good]] + q[b[good]]
        to = np.arange(n)
        to[b[good]] = a[good]
        f = to[f]
        f = f[(f[:, 0] != f[:, 1]) & (f[:, 1] != f[:, 2]) & (f[:, 0] != f[:, 2])]
    return v, f


def edge_error(v: np.ndarray, f: np.ndarray) -> float:
    """Root mean square of edge lengths."""
    p = v[f]
    return float(np.sqrt(((p - np.roll(p, -1, 1)) ** 2).sum(2).mean())) if len(f) else 0.0


def simplified(cells: DataFrame, boxes: DataFrame, scaling: float) -> DataFrame:
    """(cell, error, x0 .. z2) of triangles (cell, ...): each cell at `scaling` of its faces; those not wholly in its box are locked."""
    met = cells.select("cell", *CORNERS).join(boxes, "cell")
    sides = [f"{n}_{c}" for n in ("min", "max") for c in "xyz"]

    def run(table: pa.Table) -> pa.Table:
        p = np.stack([table.column(c).to_numpy() for c in CORNERS], 1).reshape(-1, 3, 3)
        low, high = np.split(np.array([table.column(s)[0].as_py() for s in sides]), 2)
        v, f = weld(p)
        outside = ~((v >= low) & (v < high)).all(1)
        locked = np.zeros(len(v), bool)
        locked[f[outside[f].any(1)].ravel()] = True
        v, f = simplify(v, f, locked, int(len(f) * scaling))
        error, flat = edge_error(v, f), v[f].reshape(-1, 9)
        cell = np.full(len(f), table.column("cell")[0].as_py(), np.int64)
        return pa.table([pa.array(cell), pa.array(np.full(len(f), error)), *(pa.array(np.ascontiguousarray(flat[:, i])) for i in range(9))], names=["cell", "error", *CORNERS])

    return met.groupBy("cell").applyInArrow(run, "cell long, error double, " + ", ".join(f"{c} double" for c in CORNERS))


@dataclass
class Graph:
    """nodes (node, level, cell, nface, error), patches (src, dst, nface), faces (node, x0 .. z2), boxes (node, min_x ..)."""

    nodes: DataFrame
    patches: DataFrame
    faces: DataFrame
    boxes: DataFrame


def build(triangles: DataFrame, capacity: int = 32768, top: int = 4096, scaling: float = 0.5) -> Graph:
    """Levels until one node of `top` triangles or fewer is left, or a level no longer shrinks.

    Node numbers: level * 2 ** 40 + the cell's number, so a parent's is above its children's; the finest
    nodes, which came from no other, have no patches.
    """
    stream = materialise(triangles.select(*CORNERS, F.lit(-1).cast("long").alias("child")), "stream")
    parts: dict[str, list[DataFrame]] = {n: [] for n in ("nodes", "patches", "faces", "boxes")}
    level, before = 0, None
    while True:
        cells, boxes = partition(stream, capacity, level)
        number = (F.lit(level << 40) + F.col("cell")).alias("node")
        made = materialise(simplified(cells, boxes, scaling), "simplified")
        came = materialise(cells.groupBy(number, "cell", F.col("child").alias("dst")).agg(F.count("*").alias("nface")), "patches")
        errors = made.groupBy("cell").agg(F.max("error").alias("error"))
        counts = came.groupBy("node", "cell").agg(F.sum("nface").alias("nface"))
        parts["nodes"].append(counts.join(errors, "cell", "left").select("node", F.lit(level).alias("level"), "cell", "nface", F.coalesce("error", F.lit(0.0)).alias("error")))
        parts["patches"].append(came.where("dst >= 0").select(F.col("node").alias("src"), "dst", "nface"))
        parts["faces"].append(cells.select(number, *CORNERS))
        parts["boxes"].append(boxes.select(number, *(f"{n}_{c}" for c in "xyz" for n in ("min", "max"))))
        stream = made.select(*CORNERS, number.alias("child"))
        leaves, size = came.select("cell").distinct().count(), made.count()
        if not size or (before and size / before > SHRINK) or (leaves == 1 and before):
            break
        if leaves == 1:
            before = size
            if size <= top:
                break
        level += 1
    joined = {}
    for name, tables in parts.items():
        joined[name] = tables[0]
        for t in tables[1:]:
            joined[name] = joined[name].unionAll(t)
    return Graph(**joined)
