"""Tables and files that the driver and all executors can see."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from inspect import signature

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, materialise, new_folder, shared_dir

__all__ = ["arrow_batches", "discard", "load", "materialise", "new_folder", "shared_dir", "small_batches", "text_bytes", "tidy"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as rows here are whole texts; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Within: Arrow batches of at most `rows` rows and `size` bytes; settings are put back behind."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0


def tidy(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f of one or two Arrow tables; behind it the worker gives memory it doesn't use back to the system, so that
    waiting workers hold little beside the executor's JVM."""

    def free(out: pa.Table) -> pa.Table:
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
        return out

    if len(signature(f).parameters) == 1:
        return lambda table: free(f(table))
    return lambda table, other: free(f(table, other))
