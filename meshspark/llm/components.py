"""Connected components of a link table: smallest label of the neighbours, then a jump to the label's label.

Every turn halves, about, the way of a label; the links and each turn's labels are tables in the shared
folder, so lineage stays short.  A node with very many links is no single group: its minimum is
combined before the shuffle, and the joins are ones whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of each id in links (a, b); comp is the smallest id that can be reached."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b"), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        root = labels.select(F.col("id").alias("to"), F.col("comp").alias("root"))
        turn = materialise(step.join(root, "to").select("id", F.least("to", "root").alias("comp"), (F.least("to", "root") != F.col("old")).alias("moved")), "labels")
        labels = turn.select("id", "comp")
        if not turn.where("moved").limit(1).count():
            return labels
