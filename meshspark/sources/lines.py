"""Text files as numbered lines, and numbered lines as text files.

A path is one file, or a folder whose files follow each other by name (as `save` writes them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import new_folder


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value), lines from 0 in file order.

    Rows of one split have consecutive ids, so only a row of counts per split is put in order.
    """
    split = ["_path", "_block"]
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = raw.groupBy(*split).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)  # one row per split
    bases = sizes.select(*split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return raw.join(bases, split).select((F.col("_id") + F.col("_base")).alias("line"), "value")


def save(lines: DataFrame, path: str) -> None:
    """Write (block, id, value) in order of block and id; the parts in order of name are the file."""
    lines.orderBy("block", "id").select("value").write.mode("overwrite").text(path)


def words(col: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return new_folder(spark, name)
