"""The priority cache fed by a stream of requests.

Each micro-batch (a frame) updates the last priority per node, held as the state of a streaming
aggregation; what changed goes to a table in the shared folder, one folder a batch, so that a batch
that runs again replaces its own rows.  Tiers are read off that table (`operators.tiers`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "node long, frame timestamp, error double, batch long"


def follow(requests: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query from a streaming DataFrame (node, frame, error) to `table`; `once`: what is there, then stop."""
    last = F.max(F.struct("frame", "error")).alias("p")
    state = requests.groupBy("node").agg(last).select(F.col("node").cast("long").alias("node"), "p.frame", F.col("p.error").cast("double").alias("error"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def priorities(spark: SparkSession, table: str) -> DataFrame:
    """(node, frame, error): the last priority of each node, of all batches so far."""
    changes = spark.read.schema(CHANGES).parquet(table)
    last = F.max_by(F.struct("frame", "error"), "batch").alias("p")
    return changes.groupBy("node").agg(last).select("node", "p.frame", "p.error")
