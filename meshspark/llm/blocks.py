"""Sorting whole numbers that lie in binary blocks: rank them over all chunks, and send the ranks back.

A table of chunks has one row per chunk (`chunk`, and binary columns that numpy reads).  `ranked` lets
each chunk make keys (columns of whole numbers, the most significant first) for some of its places,
cuts the order of all keys into even ranges, sorts each range in one task, and gives each chunk a number
per place.  Keys are made total by chunk and place, so however common a key is, it fills as many ranges
as it needs.  The driver gets SAMPLE keys a chunk at most and one row a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, tidy

SAMPLE, RANGE = 24, 1 << 17  # keys a chunk, rows a range
Row = dict[str, np.ndarray]
Keys = Callable[[Row], tuple[np.ndarray, list[np.ndarray]]]


def unpack(value: object) -> object:
    return np.frombuffer(value, np.int64) if isinstance(value, bytes) else value


def rows_of(batch: pa.RecordBatch | pa.Table) -> list[dict]:
    return [{k: unpack(v) for k, v in r.items()} for r in batch.to_pylist()]


def _total(places: np.ndarray, keys: list[np.ndarray], chunk: int) -> list[np.ndarray]:
    """Keys with chunk and place behind them."""
    return [*keys, np.full(len(places), chunk, np.int64), places]


def _order(keys: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _cuts(chunks: DataFrame, keys: Keys) -> np.ndarray:
    """Rising keys (a row each) that cut all into ranges of about RANGE rows."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                places, cols = keys(r)
                n = len(places)
                pick = np.unique(np.random.default_rng(r["chunk"] & 0xFFFF).integers(0, n, SAMPLE)) if n else np.zeros(0, np.int64)
                got = np.array([c[pick] for c in _total(places, cols, r["chunk"])], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([got.T.tobytes()], pa.binary()), pa.array([len(cols) + 2], pa.int64())], names=["n", "keys", "width"])

    got = chunks.mapInArrow(sample, "n long, keys binary, width long").toArrow().to_pydict()
    ranges = max(1, -(-sum(got["n"]) // RANGE))
    width = max(got["width"], default=1)
    found = np.concatenate([np.frombuffer(k, np.int64).reshape(-1, width) for k in got["keys"]]) if got["keys"] else np.zeros((0, width), np.int64)
    found = found[_order(list(found.T))]
    return found[[len(found) * i // ranges for i in range(1, ranges)]] if len(found) else found


SENT = "part long, chunk long, places binary, keys binary, width long"
GOT = "part long, chunk long, places binary, vals binary, state binary"


def ranked(chunks: DataFrame, keys: Keys, mode: str, name: str) -> tuple[DataFrame, dict[int, int], int, int]:
    """(answers, what is before each range, the last number, rows).

    keys(row of a chunk) -> (places, key columns).  Numbers count, up to and with a row in the order:
    all rows (`number`), different keys (`names`), or rows whose last key isn't 0 (`marked`).
    """
    cuts = _cuts(chunks, keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                places, cols = keys(r)
                total = _total(places, cols, r["chunk"])
                at = _order(total)
                total = [c[at] for c in total]
                if len(cuts):
                    both = [np.concatenate([c, k]) for c, k in zip(total, cuts.T, strict=True)]
                    order = np.lexsort([np.repeat([1, 0], [len(places), len(cuts)]), *both[::-1]])
                    part = np.empty(len(order), np.int64)
                    part[order] = np.cumsum(order >= len(places))
                    part = part[: len(places)]
                else:
                    part = np.zeros(len(places), np.int64)
                some, first = np.unique(part, return_index=True)
                ends = np.append(first[1:], len(part))[: len(some)]
                made = [(int(p), r["chunk"], total[-1][s:e].tobytes(), np.concatenate([c[s:e] for c in total[:-2]]).tobytes(), len(cols)) for p, s, e in zip(some, first, ends, strict=True)]
                names, types = [x.split()[0] for x in SENT.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 5, types, strict=True)], names=names)

    def sort(table: pa.Table) -> pa.Table:
        got = rows_of(table)
        width, n = got[0]["width"], [len(r["places"]) for r in got]
        cols = [np.concatenate([r["keys"].reshape(width, -1)[k] for r in got]) for k in range(width)]
        chunk, places = np.repeat([r["chunk"] for r in got], n), np.concatenate([r["places"] for r in got])
        order = _order([*cols, chunk, places])
        first, last = [np.array([c[order[i]] for c in cols], np.int64) for i in (0, -1)]
        if mode == "number":
            step = np.ones(len(order), bool)
        elif mode == "names":
            step = np.zeros(len(order), bool)
            step[0] = True
            for c in cols:
                step[1:] |= c[order[1:]] != c[order[:-1]]
        else:
            step = cols[-1][order] != 0
        vals = np.empty(len(order), np.int64)
        vals[order] = np.cumsum(step)
        ends = np.cumsum(n)
        part = got[0]["part"]
        made = [(part, r["chunk"], r["places"].tobytes(), vals[e - k : e].tobytes(), None) for r, k, e in zip(got, n, ends, strict=True)]
        made.append((part, None, None, None, np.concatenate([[int(step.sum()), len(order)], first, last]).astype(np.int64).tobytes()))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=[x.split()[0] for x in GOT.split(", ")])

    answers = materialise(chunks.mapInArrow(send, SENT).groupBy("part").applyInArrow(tidy(sort), GOT), name)
    states = answers.where("state IS NOT NULL").select("part", "state").orderBy("part").collect()
    bases, total, rows, before = {}, 0, 0, None
    for r in states:
        steps, n, *ends = np.frombuffer(r["state"], np.int64).tolist()
        first, last = ends[: len(ends) // 2], ends[len(ends) // 2 :]
        if mode == "names" and first == before:
            total -= 1  # the range goes on with the key that the one before ended with
        bases[r["part"]] = total
        total, rows, before = total + steps, rows + n, last
    return answers, bases, total, rows


def attach(chunks: DataFrame, answers: DataFrame, bases: dict[int, int], then: Callable[[Row, np.ndarray], Row], size: Callable[[Row], int], schema: str, name: str) -> DataFrame:
    """then(row of a chunk, its numbers by place; 0 where there are none) -> row of the new table."""
    fields = [x.split() for x in schema.split(", ")]

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        made = []
        for r in rows_of(table):
            numbers = np.zeros(size(r), np.int64)
            for a in rows_of(got):
                numbers[a["places"]] = a["vals"] + bases[a["part"]]
            new = then(r, numbers)
            made.append([new[f].astype(np.int64).tobytes() if t == "binary" else new[f] for f, t in fields])
        types = [pa.binary() if t == "binary" else pa.int64() for _, t in fields]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(fields), types, strict=True)], names=[f for f, _ in fields])

    out = materialise(chunks.groupBy("chunk").cogroup(answers.where(F.col("chunk").isNotNull()).groupBy("chunk")).applyInArrow(tidy(run), schema), name)
    discard(answers)
    return out


def each(chunks: DataFrame, then: Callable[[Row, np.ndarray], Row], schema: str, name: str) -> DataFrame:
    """then(row of a chunk, nothing) -> row of the new table."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                new = then(r, np.zeros(0, np.int64))
                cols = [pa.array([new[f].astype(np.int64).tobytes()], pa.binary()) if t == "binary" else pa.array([new[f]], pa.int64()) for f, t in fields]
                yield pa.RecordBatch.from_arrays(cols, names=[f for f, _ in fields])

    return materialise(chunks.mapInArrow(run, schema), name)


def total(chunks: DataFrame, of: Callable[[Row], int], how: Callable[[str], Column]) -> int:
    """An aggregate (F.sum, F.max) over the chunks' numbers of(row); 0 without chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                yield pa.RecordBatch.from_arrays([pa.array([of(r)], pa.int64())], names=["n"])

    return chunks.mapInArrow(run, "n long").agg(how("n").alias("n")).first()["n"] or 0
