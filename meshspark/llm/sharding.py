"""Reproducible shuffle into shards: a keyed Feistel permutation over global row numbers.

Row r of n goes to place p = permute(r); its shard is p mod shards and its slot p div shards, so
shard sizes differ by one row at most and every reader can compute, without the data, which row
stands at a place (`unpermute`).  A permutation of the smallest power of two of at least n is
walked along its cycles until it falls below n.

Rows are numbered by (id, size, crc of the text); nulls come first, and equal rows are numbered in
any order, as they can't be told apart.  A null text has size 8 (no bytes) and the crc of no bytes, 0.

An empty table gives no rows.  `shard_documents` reads doc_id and text alone, whatever other columns are called; a
text's length has no part but in its size and crc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise
from .words import mix

U64 = np.uint64
ROUNDS = 6
_IN_PARTITION = (1 << 33) - 1


def _round_keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ mix(np.array([key], U64)))


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, int(n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _once(x: np.ndarray, n: int, keys: np.ndarray, back: bool) -> np.ndarray:
    """One pass: the two halves take turns in being masked by a keyed hash of the other."""
    low, high = _halves(n)
    left, right = x >> U64(low), x & U64((1 << low) - 1)
    for i in range(ROUNDS)[:: -1 if back else 1]:
        if i % 2:
            left = left ^ (mix(right + keys[i]) & U64((1 << high) - 1))
        else:
            right = right ^ (mix(left + keys[i]) & U64((1 << low) - 1))
    return (left << U64(low)) | right


def _walk(rows: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    keys, out = _round_keys(key), _once(rows.astype(U64), n, _round_keys(key), back)
    while len(out_of := np.flatnonzero(out >= U64(n))):
        out[out_of] = _once(out[out_of], n, keys, back)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of row numbers 0 .. n - 1."""
    return _walk(np.asarray(rows), n, key, False)


def unpermute(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Row numbers at places 0 .. n - 1."""
    return _walk(np.asarray(places), n, key, True)


def row_numbers(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """df with gapless numbers from 0 in the given order, and their count.

    Rows are range-partitioned and sorted; only one count per partition is gathered.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumn("_mid", F.monotonically_increasing_id()), "rows")
    ordered = ordered.withColumn("_part", F.shiftright("_mid", 33))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # one row per partition
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["_n"]
    base = spark.createDataFrame(before or [(0, 0)], "_part long, _before long")
    out = ordered.join(F.broadcast(base), "_part").withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(_IN_PARTITION))
    return out.drop("_part", "_mid", "_before"), total


def shard(df: DataFrame, order: list[str], shards: int, key: int = 0) -> DataFrame:
    """df with shard int and slot long; see the module's text."""
    numbered, n = row_numbers(df, order, "_row")
    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column(b.schema.get_field_index("_row")).to_numpy(), n, key)
            keep = [i for i, f in enumerate(b.schema.names) if f != "_row"]
            cols = [pa.array((p % shards).astype(np.int32)), pa.array(p // shards)]
            names = [b.schema.names[i] for i in keep] + schema.names
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + cols, names=names)

    out = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], "_row").mapInArrow(place, out)


def shard_documents(docs: DataFrame, shards: int = 24, key: int = 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law `rows`."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = shard(slim, ["doc_id", "size", "text_crc32"], shards, key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
