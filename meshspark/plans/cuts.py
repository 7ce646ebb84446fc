"""Cuts of a level-of-detail graph: choose nodes under a budget, then the patches to emit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running


def by_budget(nodes: DataFrame, column: str, budget: float) -> DataFrame:
    """Nodes in order of falling error while `column` sums to `budget` at most."""
    return running(nodes, ["error", "node"], {"running": column}, descending=True).where(F.col("running") <= budget).select("node")


def by_size(nodes: DataFrame, budget: int) -> DataFrame:
    return by_budget(nodes, "size_bytes", budget)


def emitted_patches(patches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Patches out of chosen nodes into nodes that are not chosen."""
    src, dst = chosen.select(F.col("node").alias("src")), chosen.select(F.col("node").alias("dst"))
    return patches.join(src, "src", "left_semi").join(dst, "dst", "left_anti").select("src", "ordinal", "dst")
