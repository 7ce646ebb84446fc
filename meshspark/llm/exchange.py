"""Which keys of one part of the texts also occur in other parts: an exchange of packed keys.

Texts are dealt into chunks by a hash of their id.  At each level every chunk sends its different keys
(sorted 64-bit hashes, in binary blocks by key range, "buckets"; with a value each where the level
asks for one).  A bucket's task compares the blocks it got and answers each with one bit per key.  The
chunk makes its keys again, lines them up with the bits, and goes on to the next level or to the end.

A key that every text shares is sent once per chunk, however often it stands there; no task gathers
the places of a key; chunks and buckets are sized by the bytes of the input (CHUNK_BYTES and
BUCKET_BYTES of text each), so their number grows with it and their size doesn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes
from .words import U64

CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
BLOCKS = "bucket long, chunk long, level int, n long, keys binary, vals binary"
ANSWERS = "chunk long, level int, bucket long, n long, bits binary, less binary"

Bits = list[np.ndarray]


@dataclass
class Level:
    """keys(table, bits of earlier levels) -> (sorted different keys, a value each or None).

    The bit says that another chunk has the key too (`less`, where there are values: that another chunk
    has it with a smaller value).
    """

    keys: Callable[[pa.Table, Bits], tuple[np.ndarray, np.ndarray | None]]


def send(chunk: int, level: int, buckets: int, keys: np.ndarray, vals: np.ndarray | None) -> pa.Table:
    own = ((keys >> U64(32)) * U64(buckets)) >> U64(32)  # rises with the key
    some, first = np.unique(own, return_index=True)
    ends = np.append(first[1:], len(keys))[: len(some)]
    rows = {
        "bucket": some.astype(np.int64),
        "chunk": np.full(len(some), chunk, np.int64),
        "level": np.full(len(some), level, np.int32),
        "n": (ends - first).astype(np.int64),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
        "vals": pa.array([None if vals is None else vals[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
    }
    return pa.table(rows)


def _answer(table: pa.Table) -> pa.Table:
    blocks = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(blocks)
    valued = table.column("vals")[0].is_valid
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    ends = np.cumsum([len(b) for b in blocks])

    def pack(hit: np.ndarray) -> pa.Array:
        bits = np.empty(len(keys), bool)
        bits[order] = hit
        return pa.array([np.packbits(bits[e - len(b) : e]).tobytes() for b, e in zip(blocks, ends, strict=True)], pa.binary())

    out = {c: table.column(c).combine_chunks() for c in ("chunk", "level", "bucket", "n")}
    out["bits"] = pack(np.diff(np.append(at, len(s)))[group] > 1)
    if valued:
        vals = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("vals").to_pylist()])[order]
        out["less"] = pack(vals > np.minimum.reduceat(vals, at)[group])
    else:
        out["less"] = pa.nulls(len(table), pa.binary())
    return pa.table(out)


def answer(sent: DataFrame) -> DataFrame:
    """ANSWERS to BLOCKS: which of a chunk's keys other chunks have too."""
    return sent.groupBy("bucket").applyInArrow(_answer, ANSWERS)


def masks(answers: pa.Table, levels: int, column: str | None = None) -> Bits:
    """One mask per level, in order of the keys sent: `column`, or `less` where there is one and else `bits`."""
    out: list[list[np.ndarray]] = [[] for _ in range(levels)]
    for r in sorted(answers.to_pylist(), key=lambda r: (r["level"], r["bucket"])):
        out[r["level"]].append(np.unpackbits(np.frombuffer(r[column or ("bits" if r["less"] is None else "less")], np.uint8), count=r["n"]).astype(bool))
    return [np.concatenate(x) if x else np.zeros(0, bool) for x in out]


def _first(level: Level, buckets: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: send(t.column("_chunk")[0].as_py(), 0, buckets, *level.keys(t, []))


def _later(level: Level, k: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda t, a: send(t.column("_chunk")[0].as_py(), k, buckets, *level.keys(t, masks(a, k)))


def counts(texts: DataFrame, text_col: str) -> tuple[int, int]:
    """Chunks and buckets for texts of this size."""
    total = text_bytes(texts, text_col)
    return max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // BUCKET_BYTES))


def dealt(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """df with `_chunk`, the chunk of a key."""
    return df.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(chunks)))


def run(texts: DataFrame, key: str, text_col: str, levels: list[Level], finish: Callable[[pa.Table, Bits], pa.Table], schema: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """finish(table of a chunk, bits of all levels), over all chunks of texts (key, text and what else it has).

    The tables have texts' columns and `_chunk`.
    """
    chunks, buckets = sizes or counts(texts, text_col)
    parts = dealt(texts, key, chunks).groupBy("_chunk")
    answers = None
    for k, level in enumerate(levels):
        sent = parts.applyInArrow(_first(level, buckets), BLOCKS) if answers is None else parts.cogroup(answers.groupBy("chunk")).applyInArrow(_later(level, k, buckets), BLOCKS)
        answers = answer(sent) if answers is None else answers.unionAll(answer(sent))
    n = len(levels)
    return parts.cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: finish(t, masks(a, n)), schema)
