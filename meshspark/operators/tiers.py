"""A two-tier cache of nodes in priority order, as queries over token rows.

tokens: (node, frame, error, size).  Later frames come first, then larger errors, then smaller ids.
Priorities are applied per micro-batch; a tier keeps the longest prefix of the order that fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running


def latest(tokens: DataFrame) -> DataFrame:
    """The last request of each node: (node, frame, error)."""
    last = F.max(F.struct("frame", "error")).alias("p")
    return tokens.groupBy("node").agg(last).select("node", "p.frame", "p.error")


def ranked(tokens: DataFrame) -> DataFrame:
    """Tokens with their place from 1 in priority order."""
    order = tokens.withColumn("_f", -F.unix_micros("frame")).withColumn("_e", -F.col("error"))
    return running(order, ["_f", "_e", "node"], number="place").drop("_f", "_e")


def resident(tokens: DataFrame, capacity: int) -> DataFrame:
    """Nodes that a tier of `capacity` bytes holds: the sizes of the first ones sum to it at most."""
    order = tokens.withColumn("_f", -F.unix_micros("frame")).withColumn("_e", -F.col("error"))
    return running(order, ["_f", "_e", "node"], {"held": "size"}).where(F.col("held") <= capacity).drop("_f", "_e")


def evicted(tokens: DataFrame, capacity: int, locked: DataFrame) -> DataFrame:
    """What must leave; nodes in `locked` stay whatever their place."""
    order = tokens.withColumn("_f", -F.unix_micros("frame")).withColumn("_e", -F.col("error"))
    over = running(order, ["_f", "_e", "node"], {"held": "size"}).where(F.col("held") > capacity)
    return over.join(locked, "node", "left_anti").select("node")
