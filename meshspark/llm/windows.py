"""Substring deduplication over words, by level-wise doubling of window lengths.

A window is a run of words of one text.  Lengths double from `start` words on and stop at `window` on the
way: 4, 8, 13.  Up to `window`, the windows of a level stand for the full ones: of each full window one
shorter one, that of smallest hash, which is the same wherever the full window occurs; a full window
whose shorter one no other text has can't repeat and is out.  A word is removed if a window of `window`
words that covers it also starts in a text with a smaller id; all windows are judged on the input.

`longest_repeats` goes on from there: two windows of one level that both repeat and stand one behind the
other make one of the next (26, 52, ...), until no window survives.

Levels compare 64-bit hashes, each level with its own; a window is removed only if those of all levels
agree.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A null text has no words.  A null id counts as larger
than any other; rows of equal ids don't remove each other's words, and count as one text.  Columns of docs
named like the result's are replaced.

An empty table gives no rows.  A text of any length belongs to one task, with all its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .shared import discard, materialise, small_batches
from .words import U64, cover, find_words, mix, slices, text_buffer

LAST, FIRST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
STATE = "k long, id long, chunk long, at binary, keys binary"
RESULT = ("n_words", "n_removed", "kept_sha256")


def lengths(window: int, start: int = 4) -> list[int]:
    """The levels before `window`."""
    out = []
    while start < window:
        out.append(start)
        start *= 2
    return out


class Windows:
    """Windows of one chunk, with the keys that stand for them at each level."""

    def __init__(self, table: pa.Table, window: int, levels: list[int]):
        self.buf, self.off = text_buffer(table.column("text"))
        ids = table.column("id").to_numpy()
        at, row, full, stand = [], [], [], [[] for _ in levels]
        for i, j in slices(self.off):
            w = find_words(self.buf[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i])
            pos, h = w.windows(window)
            doc = w.doc()[pos]
            for out, n in zip(stand, levels, strict=True):
                short = w.hashes_of(n)
                low = short[pos]
                for k in range(1, window - n + 1):
                    low = np.minimum(low, short[pos + k])
                out.append(mix(low))  # least hashes lie close together; keys are to fill all buckets alike
            at.append(pos - w.first[doc])
            row.append(doc + i)
            full.append(h)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.at, self.row, self.full = join(at, np.int64), join(row, np.int64), join(full, U64)
        self.stand = [join(x, U64) for x in stand]
        self.doc = ids[self.row]

    def survivors(self, bits: exchange.Bits) -> np.ndarray:
        """Windows whose stand-ins of the levels so far all occur in another text."""
        left = np.arange(len(self.at))
        for stand, elsewhere in zip(self.stand, bits, strict=False):
            left = left[shared(stand[left], self.doc[left], elsewhere)]
        return left

    def level(self, k: int, bits: exchange.Bits) -> tuple[np.ndarray, None]:
        return np.unique(self.stand[k][self.survivors(bits)]), None

    def last(self, bits: exchange.Bits) -> tuple[np.ndarray, np.ndarray]:
        """Full keys of the survivors, with the smallest id that has each."""
        left = self.survivors(bits)
        return smallest(self.full[left], self.doc[left])

    def removed(self, bits: exchange.Bits) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of each window to remove."""
        left = self.survivors(bits[:-1])
        keys, docs = smallest(self.full[left], self.doc[left])
        k = np.searchsorted(keys, self.full[left])
        gone = left[bits[-1][k] | (docs[k] < self.doc[left])]
        return self.row[gone], self.at[gone]


def shared(keys: np.ndarray, doc: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Which windows have a key that another text of this chunk or (elsewhere, by key) another has."""
    some, back = np.unique(keys, return_inverse=True)
    low, high = np.full(len(some), LAST), np.full(len(some), FIRST)
    np.minimum.at(low, back, doc)
    np.maximum.at(high, back, doc)
    return (elsewhere | (low != high))[back]


def smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the smallest id of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return keys[head], docs[head]


class State:
    """Windows of a chunk that are left at a level: rows of texts with their places and keys."""

    def __init__(self, table: pa.Table):
        self.k, self.id = (table.column(c).to_numpy() for c in ("k", "id"))
        self.chunk = table.column("chunk")[0].as_py()
        at = [np.frombuffer(x, np.int32) for x in table.column("at").to_pylist()]
        n = np.array([len(x) for x in at], np.int64)
        self.row = np.repeat(np.arange(len(at)), n)
        self.at = np.concatenate(at).astype(np.int64)
        self.keys = np.concatenate([np.frombuffer(x, U64) for x in table.column("keys").to_pylist()])
        self.doc = self.id[self.row]

    def send(self, buckets: int) -> pa.Table:
        return exchange.send(self.chunk, 0, buckets, np.unique(self.keys), None)

    def repeated(self, answers: pa.Table) -> pa.Table:
        """STATE of the windows that another text has too."""
        keep = shared(self.keys, self.doc, exchange.masks(answers, 1)[0])
        self.row, self.at, self.keys = self.row[keep], self.at[keep], self.keys[keep]
        return self.table()

    def table(self) -> pa.Table:
        rows = []
        for r in np.unique(self.row).tolist():
            mine = slice(*np.searchsorted(self.row, [r, r + 1]))
            rows.append((int(self.k[r]), int(self.id[r]), self.chunk, self.at[mine].astype(np.int32).tobytes(), self.keys[mine].tobytes()))
        return state_table(rows)

    def doubled(self, length: int) -> pa.Table:
        """STATE of the windows of twice the length whose halves are both here."""
        order = np.lexsort((self.at, self.row))
        row, at, keys = self.row[order], self.at[order], self.keys[order]
        place = row << 32 | at
        other = np.searchsorted(place, place + length)
        ok = other < len(place)
        ok[ok] = place[other[ok]] == place[ok] + length
        self.row, self.at, self.keys = row[ok], at[ok], mix(keys[ok] * U64(0x9E3779B97F4A7C15) + keys[other[ok]])
        return self.table()


def state_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["k", "id", "chunk", "at", "keys"])


def _levels(window: int, start: int) -> list[exchange.Level]:
    levels = lengths(window, start)
    of = lambda k: exchange.Level(lambda t, bits: Windows(t, window, levels[: k + 1]).level(k, bits))
    return [of(k) for k in range(len(levels))]


def _candidates(texts: DataFrame, window: int, start: int, sizes: tuple[int, int]) -> DataFrame:
    """STATE of the full windows that the levels before let pass."""
    levels = lengths(window, start)

    def finish(table: pa.Table, bits: exchange.Bits) -> pa.Table:
        w, rows = Windows(table, window, levels), []
        left = w.survivors(bits)
        k, ids, chunk = (table.column(c).to_pylist() for c in ("k", "id", "_chunk"))
        for r in np.unique(w.row[left]).tolist():
            mine = left[slice(*np.searchsorted(w.row[left], [r, r + 1]))]
            rows.append((k[r], ids[r], chunk[r], w.at[mine].astype(np.int32).tobytes(), w.full[mine].tobytes()))
        return state_table(rows)

    if not levels:
        return exchange.dealt(texts, "k", sizes[0]).groupBy("_chunk").applyInArrow(lambda t: finish(t, []), STATE)
    return exchange.run(texts, "k", "text", _levels(window, start), finish, STATE, sizes)


def _repeated(table: pa.Table, answers: pa.Table) -> pa.Table:
    return State(table).repeated(answers)


def _doubled(length: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: State(t).doubled(length)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """A row's key (of id and text), its id with nulls last, and its text without nulls."""
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.xxhash64(ident, text).alias("k"), F.coalesce(ident.cast("long"), F.lit(LAST)).alias("id"), text.alias("text")


def longest_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", start: int = 4) -> DataFrame:
    """(doc_id, longest) of the texts with a window that another text has too: the last level reached."""
    small_batches(docs.sparkSession)
    texts = docs.select(*_keyed(docs, id_col, text_col))
    sizes = exchange.counts(texts, "text")
    state, longest, length = materialise(_candidates(texts, window, start, sizes), "windows"), None, window
    while True:
        answers = exchange.answer(state.groupBy("chunk").applyInArrow(_sender(sizes[1]), exchange.BLOCKS))
        found = materialise(state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_repeated, STATE), "windows")
        reached = found.select("id", F.lit(length).cast("long").alias("longest"))
        longest = reached if longest is None else longest.unionAll(reached)
        last, state = state, materialise(found.groupBy("chunk").applyInArrow(_doubled(length), STATE), "windows")
        discard(last)
        if not state.limit(1).count():
            ident = F.when(F.col("id") != LAST, F.col("id")).alias("doc_id")
            return longest.groupBy(ident).agg(F.max("longest").alias("longest"))
        length *= 2


def _sender(buckets: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: State(t).send(buckets)


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, start: int = 4) -> DataFrame:
    """docs' columns but the text, with n_words, n_removed, kept_sha256 and, if asked for, the text that is kept.

    kept_sha256 is that of the kept words joined by one space.  The text keeps its own white space; a
    removed word goes with the white space behind it, and a text that loses nothing stays as it is.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col and c not in RESULT]
    levels = [*_levels(window, start), exchange.Level(lambda t, bits: Windows(t, window, lengths(window, start)).last(bits))]

    def finish(table: pa.Table, bits: exchange.Bits) -> pa.Table:
        found = Windows(table, window, lengths(window, start))
        row, first = found.removed(bits)
        begin = np.searchsorted(row, np.arange(len(table) + 1))
        buf, off = found.buf, found.off
        digests, kept_texts, n_words, n_removed = [], [], [], []
        for i, j in slices(off):
            raw, base = buf[off[i] : off[j]].tobytes(), off[i]
            w = find_words(buf[off[i] : off[j]], off[i : j + 1] - base, hashed=False)
            for d in range(j - i):
                body, a, b = raw[off[i + d] - base : off[i + d + 1] - base], w.first[d], w.first[d + 1]
                at = first[begin[i + d] : begin[i + d + 1]]
                gone = cover(at, window, int(b - a))
                n_words.append(int(b - a))
                n_removed.append(int(gone.sum()))
                parts = body.split()
                digests.append(hashlib.sha256(b" ".join([x for x, g in zip(parts, gone.tolist(), strict=True) if not g] if len(at) else parts)).hexdigest())
                if with_text:
                    edges = np.concatenate([[0], w.starts[a:b] - (off[i + d] - base), [len(body)]])
                    runs = np.flatnonzero(np.append(True, ~gone))  # what stands before the first word stays
                    kept_texts.append(b"".join([body[edges[k] : edges[k + 1]] for k in runs]).decode() if len(at) else table.column("_given")[i + d].as_py())
        names = [f"_{n}" for n in range(len(others))]
        more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept_texts, pa.string())] * with_text
        return pa.table([*(table.column(n) for n in names), *more], names=[*names, *RESULT, *(["_text"] * with_text)])

    # docs' columns go by number, so that they may have any name.
    given = [F.col(f"`{text_col}`").alias("_given")] if with_text else []
    wide = docs.select(*_keyed(docs, id_col, text_col), *given, *(F.col(f"`{c}`").alias(f"_{n}") for n, c in enumerate(others)))
    kinds = [f"_{n} {docs.schema[c].dataType.simpleString()}" for n, c in enumerate(others)]
    schema = ", ".join([*kinds, "n_words long", "n_removed long", "kept_sha256 string", *(["_text string"] * with_text)])
    done = exchange.run(wide, "k", "text", levels, finish, schema)
    return done.select(*(F.col(f"_{n}").alias(c) for n, c in enumerate(others)), *RESULT, *([F.col("_text").alias(text_col)] * with_text))
