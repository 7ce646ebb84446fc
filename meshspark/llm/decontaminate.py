"""Benchmark passages in documents: Wu-Manber multi-pattern search over words.

A pattern is a run of item words; symbols are words (by their hashes), blocks are two words.  Within
one pattern length m, the shift table says for a block of text how far the search window may move
on before any pattern can end there; blocks that occur in no pattern move it by m - 1.  Where the
shift is 0, the hash of the window's last SUFFIX words selects a bucket of patterns, and a comparison of
all m words, byte for byte, confirms.  Many places are searched in step: texts are cut into lanes of
LANE words that overlap by m - 1, and each turn moves every lane's window by its own shift.

The items reach the executors in blocks of bounded size (`block_bytes` of item text), one after another:
with more than one block the documents are scanned once per block, the marks of texts with a hit are
written, and marks are united per document in the end.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z.  A null text has no words,
in items as in documents; items without words match nothing; items with a null id mark words but are
not counted or listed; repeated items count by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, small_batches, text_bytes
from .words import ALNUM, LOWER, U64, Words, cover, find_words, mix, per_doc, slices, text_buffer

LANE, SUFFIX = 256, 4


@dataclass
class Patterns:
    """Patterns of one length with their tables."""

    m: int
    words: np.ndarray  # patterns x m
    texts: list[bytes]  # the patterns' words, joined by one space
    owners: list[list]  # item ids of each pattern
    block: int
    block_keys: np.ndarray  # sorted; shift of each
    shifts: np.ndarray
    last: np.ndarray  # sorted bucket keys (hashes of the last words); patterns in that order

    @classmethod
    def build(cls, m: int, words: np.ndarray, texts: list[bytes], owners: list[list]) -> Patterns:
        block = min(2, m)
        ends = _blocks(words, block)  # patterns x (m - block + 1)
        keys, shift = ends.ravel(), np.broadcast_to(m - block - np.arange(m - block + 1), ends.shape).ravel()
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        last = _blocks(words[:, -min(SUFFIX, m) :], min(SUFFIX, m))[:, 0]
        order = np.argsort(last, kind="stable")
        return cls(m, words[order], [texts[i] for i in order], [owners[i] for i in order], block, keys[first], shift[first], last[order])

    def find(self, w: Words, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of each occurrence in texts with words w of the bytes raw."""
        text, first = w.hashes, w.first
        m, step = self.m, LANE - self.m + 1 if LANE > 2 * self.m else LANE
        counts = np.maximum(np.diff(first) - m + 1, 0)  # windows of each text
        lanes = -(-counts // step)
        if not lanes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(counts)), lanes)
        number = np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[own] + number * step
        stop = np.minimum(at + step, first[own] + counts[own])
        ends = _blocks(text[None], self.block)[0]  # block that starts at each word
        found_at, found = [], []
        while len(at):
            key = ends[at + m - self.block]
            i = np.minimum(np.searchsorted(self.block_keys, key), len(self.block_keys) - 1)
            shift = np.where(self.block_keys[i] == key, self.shifts[i], m - self.block + 1)
            if len(hit := np.flatnonzero(shift == 0)):
                size = min(SUFFIX, m)
                last = _blocks(text[at[hit][:, None] + np.arange(m - size, m)], size)[:, 0]
                low, high = (np.searchsorted(self.last, last, s) for s in ("left", "right"))
                which = np.repeat(hit, high - low)
                pattern = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
                same = (text[at[which][:, None] + np.arange(m)] == self.words[pattern]).all(1)
                where, pattern = at[which[same]], pattern[same]
                same = [raw[w.starts[a] : w.ends[a + m - 1]] == self.texts[p] or b" ".join(raw[s:e] for s, e in zip(w.starts[a : a + m], w.ends[a : a + m], strict=True)) == self.texts[p] for a, p in zip(where.tolist(), pattern.tolist(), strict=True)]
                found_at.append(where[same])
                found.append(pattern[same])
            at = at + np.maximum(shift, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


def _blocks(words: np.ndarray, block: int) -> np.ndarray:
    """Key of the block that starts at each word of each row."""
    out = words
    for k in range(1, block):
        out = mix(out[:, :-1] * U64(0x9E3779B97F4A7C15) + words[:, k:])
    return out


def compile_items(items: list[tuple], window: int) -> list[Patterns]:
    """items: (item_id, text)."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, dict]]] = {}
    for item, text in items:
        buf = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        raw, w = buf.tobytes(), find_words(buf, np.array([0, len(buf)]), ALNUM)
        words = [raw[s:e] for s, e in zip(w.starts, w.ends, strict=True)]
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            _, owners = by_length.setdefault(m, {}).setdefault(b" ".join(words[k : k + m]), (w.hashes[k : k + m], {}))
            if item is not None:
                owners[item] = True
    return [Patterns.build(m, np.array([h for h, _ in p.values()]), list(p), [list(o) for _, o in p.values()]) for m, p in sorted(by_length.items())]


def search(buf: np.ndarray, off: np.ndarray, patterns: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """(mask of hit words, first word of each text, items that occur in each text)."""
    buf = LOWER[buf]
    w, raw = find_words(buf, off, ALNUM), buf.tobytes()
    hit, items = np.zeros(len(w.hashes), bool), [set() for _ in range(len(off) - 1)]
    for p in patterns:
        at, which = p.find(w, raw)
        if len(at):
            hit |= cover(at, p.m, len(hit))
            doc = np.searchsorted(w.first, at, "right") - 1
            for d, k in set(zip(doc.tolist(), which.tolist(), strict=True)):
                items[d].update(p.owners[k])
    return hit, w.first, items


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """RESULT of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = max(1, -(-text_bytes(benchmark) // block_bytes))
    if blocks > 1:
        return _in_blocks(docs, benchmark, window, blocks)
    patterns = spark.sparkContext.broadcast([(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()])  # block_bytes at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = compile_items(patterns.value, window)
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in slices(off, 1 << 21):
                hit, first, items = search(buf[off[i] : off[j]], off[i : j + 1] - off[i], tables)
                n_hit = per_doc(hit, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array(n_hit > 0)],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, RESULT)


def _in_blocks(docs: DataFrame, benchmark: DataFrame, window: int, blocks: int) -> DataFrame:
    """One scan per block of items; only texts with a hit leave marks."""
    spark, parts = docs.sparkSession, []
    # Rows are told apart by id and text; copies of a row get the same marks.
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k1"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("k2"))
    base = benchmark.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        items = spark.sparkContext.broadcast([(r[0], r[1]) for r in base.where(F.col("block") == k).collect()])  # a block

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            tables = compile_items(items.value, window)
            for b in batches:
                buf, off = text_buffer(b.column(0))
                for i, j in slices(off, 1 << 21):
                    hit, first, found = search(buf[off[i] : off[j]], off[i : j + 1] - off[i], tables)
                    some = np.flatnonzero(per_doc(hit, first))
                    marks = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in some]
                    ids = [sorted(map(str, found[d])) for d in some]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(some + i)) for c in (1, 2)), pa.array(marks, pa.binary()), pa.array(ids, pa.list_(pa.string()))], names=["k1", "k2", "marks", "items"])

        parts.append(materialise(keyed.select("text", "k1", "k2").mapInArrow(scan, "k1 long, k2 string, marks binary, items array<string>"), "marks"))
        items.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)

    def unite(table: pa.Table) -> pa.Table:
        """Of one document: a row per block at most."""
        marks = [np.frombuffer(x, np.uint8) for x in table.column("marks").to_pylist()]
        n_hit = int(np.unpackbits(np.bitwise_or.reduce(marks)).sum())
        items = {x for row in table.column("items").to_pylist() for x in row}
        keys = {c: table.column(c).slice(0, 1).combine_chunks() for c in ("k1", "k2")}
        return pa.table(keys | {"n_hit": pa.array([n_hit]), "n_items": pa.array([len(items)]), "items_sha256": pa.array([_digest(items)])})

    hits = every.dropDuplicates().groupBy("k1", "k2").applyInArrow(unite, "k1 long, k2 string, n_hit long, n_items long, items_sha256 string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in slices(off, 1 << 21):
                w = find_words(buf[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, lower=True)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(w.counts), b.column(2)[i:j], b.column(3)[i:j]], names=["doc_id", "n_words", "k1", "k2"])

    counted = keyed.mapInArrow(count, "doc_id long, n_words long, k1 long, k2 string").join(hits, ["k1", "k2"], "left")
    zero, none = F.lit(0).cast("long"), F.lit(_digest([]))
    return counted.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
