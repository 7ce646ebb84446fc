"""Queries over a level-of-detail graph: nodes (node, error, ...), patches (src, ordinal, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialise


def children(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(src, dst) joined with both ends' columns, as src_* and dst_*."""
    a = nodes.select(*(F.col(c).alias(f"src_{c}") for c in nodes.columns))
    b = nodes.select(*(F.col(c).alias(f"dst_{c}") for c in nodes.columns))
    return patches.join(a, F.col("src") == F.col("src_node")).join(b, F.col("dst") == F.col("dst_node"))


def by_error(nodes: DataFrame, least: float) -> DataFrame:
    """A cut of saturated errors: nodes of at least this error."""
    return nodes.where(F.col("error") >= least).select("node")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    return materialise(df, "graph")


def closed_cut(nodes: DataFrame, patches: DataFrame, expand: Column) -> DataFrame:
    """Nodes reached from the roots over nodes that `expand` accepts: one join per level of the graph.

    Works for errors that aren't saturated too.  Each level is checkpointed, so plans stay short.
    """
    accepted = checkpointed(nodes.where(expand).select("node"))
    inner = checkpointed(patches.select("src", F.col("dst").alias("node")).join(accepted, "node", "left_semi"))
    roots = accepted.join(patches.select(F.col("dst").alias("node")), "node", "left_anti")
    return reached(roots, inner.withColumnRenamed("node", "dst"))


def reached(start: DataFrame, patches: DataFrame) -> DataFrame:
    """(node) of start and all that patches lead to from there, each once: one join per level."""
    seen = [checkpointed(start.distinct())]
    while True:
        below = patches.join(seen[-1].withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        for level in seen:
            below = below.join(level, "node", "left_anti")
        front = checkpointed(below)
        if not front.limit(1).count():
            return reduce(DataFrame.unionAll, seen)
        seen.append(front)


def exposed(patches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen nodes with a patch into a node that isn't chosen."""
    src, dst = chosen.select(F.col("node").alias("src")), chosen.select(F.col("node").alias("dst"))
    return patches.join(src, "src", "left_semi").join(dst, "dst", "left_anti").select(F.col("src").alias("node")).distinct()


def finest_level(nodes: DataFrame, patches: DataFrame, sink: int) -> DataFrame:
    """Nodes with a patch into the sink."""
    last = patches.where(F.col("dst") == sink).select(F.col("src").alias("node")).distinct()
    return nodes.join(last, "node", "left_semi")


def drop_finest(nodes: DataFrame, patches: DataFrame, sink: int) -> DataFrame:
    last = patches.where(F.col("dst") == sink).select(F.col("src").alias("node"))
    return nodes.join(last, "node", "left_anti")


def unsaturated(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches whose child has as large an error as its parent."""
    return children(nodes, patches).where("dst_error >= src_error").select("src", "ordinal", "dst")


def saturate_once(nodes: DataFrame, patches: DataFrame, factor: float = 1.01) -> DataFrame:
    """Each inner node's error is raised above its largest child's."""
    most = children(nodes, patches).groupBy("src").agg(F.max("dst_error").alias("m")).withColumnRenamed("src", "node")
    return nodes.join(most, "node", "left").select("node", F.greatest("error", F.coalesce(F.col("m") * factor, F.col("error"))).alias("error"))


def remap(patches: DataFrame, chosen: DataFrame, sink: int) -> DataFrame:
    """Patches of chosen nodes with ends renumbered; ends that weren't chosen become the sink.

    chosen: (node, new).
    """
    src = chosen.select(F.col("node").alias("src"), F.col("new").alias("new_src"))
    dst = chosen.select(F.col("node").alias("dst"), F.col("new").alias("new_dst"))
    out = patches.join(src, "src").join(dst, "dst", "left")
    return out.select(F.col("new_src").alias("src"), "ordinal", F.coalesce("new_dst", F.lit(sink).cast("long")).alias("dst"))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over undirected edges (a, b); lineage is cut by checkpoints."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    before = label = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id")
        step = label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        root = label.select(F.col("id").alias("to"), F.col("comp").alias("root"))
        turn = checkpointed(step.join(root, "to").select("id", F.least("to", "root").alias("comp"), (F.least("to", "root") != F.col("old")).alias("moved")))
        discard(before)
        before, label = turn, turn.select("id", "comp")
        if not turn.where("moved").limit(1).count():
            discard(both)
            return label
