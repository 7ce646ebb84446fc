"""How the sources of a language differ in their words.

1. Terms.  A table over the 256 byte values marks the bytes of terms (`[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`:
   letters and everything beyond ASCII; only A-Z fold) in the UTF-8 buffer of many texts at once; where the
   mark changes a term begins or ends.  Slices are grouped by XXH64, computed for all slices together,
   and each is compared byte for byte with the first of its group (`group_slices`); those that differ get
   groups of their own.  A batch's texts are put in order of language and source and counted in runs of
   RUN_BYTES; a run sends one row per (language, source, term): its occurrences and documents.
2. Spark adds these up, keeps the terms in at least `min_docs` documents of a language, and deals a
   language's terms into blocks by hash: as many as keep a block near BLOCK cells, so no term, source or
   language stands in one task as a whole.
3. A block is a sparse matrix, rows sources and columns terms (row pointers, columns, counts).  Every source's
   smoothed share of each term, p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)), is worked out in
   integers; a pair's difference |p - q|, summed over the block, is `reduceat` over the row pointers for
   cells plus what the empty cells give, which needs their number only.  A block gives one row per pair of
   sources and the `top` terms of each source; Spark adds the pairs up and ranks.

Null text, language and source are ''.  Repeated rows are documents of their own.  A source without terms
takes part with no counts.  A language without kept terms (V = 0) has pairs of value 0 and no terms.  An
empty table gives no rows.  Ties go by the item's bytes, ascending.  Other columns are not read.  A text
longer than RUN_BYTES is counted in parts that end at term boundaries and is still one document; a single term
is never cut.  Counts are exact while N + 5 * V stays below 9 * 10**15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise
from .words import LOWER, U64, slices, text_buffer

#: Bytes of terms, after A-Z became a-z.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
RUN_BYTES, BLOCK, FEW_LANGS, SCALE_STEPS = 2 << 20, 1 << 16, 10_000, (1000, 1000, 1000)
CELLS = "lang string, source string, term binary, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice: those below 32 bytes for all slices together, longer ones by the library."""
    size = ends - starts
    h = P5 + size.astype(U64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    short = size < 32
    for k in range(3):
        at = np.flatnonzero(short & (size >= 8 * (k + 1)))
        h[at] = _turn(h[at] ^ (_turn(words[starts[at] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    place = starts + (size & ~7)
    at = np.flatnonzero(short & (size & 4 > 0))
    h[at] = _turn(h[at] ^ ((words[place[at]] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    place = place + (size & 4)
    for j in range(3):
        at = np.flatnonzero(short & ((size & 3) > j))
        h[at] = _turn(h[at] ^ (padded[place[at] + j].astype(U64) * P5), 11) * P1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    h ^= h >> U64(32)
    if not short.all():
        import xxhash

        for i in np.flatnonzero(~short).tolist():
            h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def term_slices(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the terms of texts buf[off[i]:off[i + 1]]; buf is folded."""
    mark = IN_TERM[buf]
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    filled = off[1:] > off[:-1]
    head, tail = off[:-1][filled], off[1:][filled] - 1
    first[head], last[tail] = mark[head], mark[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a + size] and buf[b:b + size] agree, for each."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    out = np.ones(len(a), bool)
    at, k = np.flatnonzero((size > 0) & (a != b)), 0
    while len(at) and k < 64:
        left = np.minimum(size[at] - k, 8).astype(U64)
        differ = ((words[a[at] + k] ^ words[b[at] + k]) & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - left * U64(8)))) != 0
        out[at[differ]] = False
        k += 8
        at = at[~differ & (size[at] > k)]
    for i in at.tolist():
        out[i] = np.array_equal(buf[a[i] : a[i] + size[i]], buf[b[i] : b[i] + size[i]])
    return out


def group_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): equal bytes are one group, others never."""
    _, first, group = np.unique(digest(buf, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    like = first[group]
    odd = np.flatnonzero((size != size[like]) | ~_same(buf, starts, starts[like], np.minimum(size, size[like])))
    more: dict[bytes, int] = {}
    extra = []
    for i in odd.tolist():
        raw = buf[starts[i] : ends[i]].tobytes()
        if raw not in more:
            more[raw] = len(first) + len(extra)
            extra.append(i)
        group[i] = more[raw]
    return group, np.append(first, np.array(extra, np.int64)).astype(np.int64)


def _bytes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    off = np.append(0, np.cumsum(size))
    raw = buf[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])


def _run(buf: np.ndarray, off: np.ndarray, groups: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of a run of texts, each of one group."""
    buf = LOWER[buf]
    starts, ends = term_slices(buf, off)
    term, of = group_slices(buf, starts, ends)
    doc = np.searchsorted(off, starts, "right") - 1
    cells, n = np.unique(doc * max(len(of), 1) + term, return_counts=True)
    keys, back = np.unique(groups[cells // max(len(of), 1)] * max(len(of), 1) + cells % max(len(of), 1), return_inverse=True)
    total = np.bincount(back, n, len(keys)).astype(np.int64)
    which = of[keys % max(len(of), 1)]
    return pa.table({"group": keys // max(len(of), 1), "term": _bytes_of(buf, starts[which], ends[which]), "n": total, "docs": np.bincount(back, minlength=len(keys)).astype(np.int64)})


def _long(buf: np.ndarray, group: int, most: int) -> pa.Table:
    """The same for one text longer than a run, in parts that end where a term does."""
    done, at = [], 0
    while at < len(buf):
        size = most
        while at + size < len(buf):
            gaps = np.flatnonzero(~IN_TERM[LOWER[buf[at : at + size]]])
            if len(gaps):
                size = int(gaps[-1]) + 1
                break
            size *= 2
        part = buf[at : at + size]
        done.append(_run(part, np.array([0, len(part)]), np.array([group])))
        at += size
    t = _added(pa.concat_tables(done))
    return t.set_column(t.column_names.index("docs"), "docs", pa.array(np.ones(len(t), np.int64)))


def _added(t: pa.Table) -> pa.Table:
    return t.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["group", "term", "n", "docs"])


def count_terms(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """CELLS: (lang, source, term, occurrences, documents), added up per run only."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = pc.dictionary_encode(pc.binary_join_element_wise(b.column(0).cast(pa.binary()), b.column(1).cast(pa.binary()), b"\xff"))  # no byte of UTF-8
            names = [x.split(b"\xff") for x in pairs.dictionary.to_pylist()]
            lang, source = (pa.array([x[k].decode() for x in names], pa.string()) for k in (0, 1))
            group = pairs.indices.to_numpy().astype(np.int64)
            order = np.argsort(group, kind="stable")  # so that a run holds few groups, and most groups are in one run
            group = group[order]
            buf, off = text_buffer(b.column(2).take(pa.array(order)))
            for i, j in slices(off, run_bytes):
                part = buf[off[i] : off[j]]
                t = _long(part, int(group[i]), run_bytes) if len(part) > run_bytes else _run(part, off[i : j + 1] - off[i], group[i:j])
                own = t.column("group").combine_chunks()
                out = pa.table({"lang": lang.take(own), "source": source.take(own), "term": t.column("term").cast(pa.binary()), "n": t.column("n"), "docs": t.column("docs")})
                yield from out.to_batches(max_chunksize=1 << 16)

    return named.mapInArrow(count, CELLS)


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 5) / whole) by long division, three digits at a time."""
    rest, out = counts + 5, np.zeros_like(counts)
    for step in SCALE_STEPS:
        rest = rest * step
        out = out * step + rest // whole
        rest = rest % whole
    return out + 1


def _block(cells: pa.Table, sources: pa.Table, top: int) -> pa.Table:
    """Pairs and top terms of one block of a language's terms; `sources` names all sources of the language."""
    lang, names = sources.column("lang")[0].as_py(), sources.column("source").combine_chunks()
    order = pc.sort_indices(names)
    names, total = names.take(order), sources.column("total").combine_chunks().take(order).to_numpy()
    kept = int(sources.column("kept")[0].as_py())
    rows = len(names)
    if kept:
        whole = total + 5 * kept
        coded = cells.column("term").combine_chunks().dictionary_encode()
        by_bytes = pc.sort_indices(coded.dictionary).to_numpy()
        terms = coded.dictionary.take(pa.array(by_bytes))
        place = np.empty(len(by_bytes), np.int64)
        place[by_bytes] = np.arange(len(by_bytes))
        col = place[coded.indices.to_numpy()] if len(cells) else np.zeros(0, np.int64)
        row = pc.index_in(cells.column("source").combine_chunks(), names).to_numpy() if len(cells) else np.zeros(0, np.int64)
        turn = np.lexsort((col, row))
        row, col, n = row[turn].astype(np.int64), col[turn], cells.column("n").to_numpy()[turn]
        start = np.searchsorted(row, np.arange(rows + 1))
        p, bare = shares(n, whole[row]), shares(np.zeros(rows, np.int64), whole)
        q = shares(_column_sums(col, n, len(terms)), int(total.sum()) + 5 * kept)
        pairs = _pair_sums(start, col, p, bare, len(terms))
        more = p - q[col]
        best = np.flatnonzero(more > 0)
        best = best[np.lexsort((col[best], -more[best], row[best]))]
        begin = np.searchsorted(row[best], row[best])
        best = best[np.arange(len(best)) - begin < top]
    else:
        terms, best, pairs = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros((rows, rows), np.int64)
        row = col = more = best
    a, b = np.nonzero(~np.eye(rows, dtype=bool))
    owner, item = np.concatenate([a, row[best]]), [names.take(pa.array(b)), terms.take(pa.array(col[best]))]
    return pa.table({
        "lang": pa.array([lang] * len(owner), pa.string()),
        "source": names.take(pa.array(owner)),
        "part": pa.array(["pair"] * len(a) + ["term"] * len(best), pa.string()),
        "item": pa.chunked_array(item, pa.string()),
        "value": np.concatenate([pairs[a, b], more[best]]),
    })


def _column_sums(col: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    np.add.at(out, col, n)
    return out


def _pair_sums(start: np.ndarray, col: np.ndarray, p: np.ndarray, bare: np.ndarray, width: int) -> np.ndarray:
    """Sum of |p - q| over the columns for each pair of rows; a row has `bare` where it has no cell."""
    rows, size = len(bare), np.diff(start)
    out = np.zeros((rows, rows), np.int64)
    some = np.flatnonzero(size)
    of = np.repeat(np.arange(rows), size)
    for g in range(rows):
        own = p[start[g] : start[g + 1]]
        line = np.full(width, bare[g], np.int64)
        line[col[start[g] : start[g + 1]]] = own
        # as if every row had no cell at all: its bare share against this line, from the sorted cells
        rising = np.sort(own)
        sums = np.append(0, np.cumsum(rising))
        below = np.searchsorted(rising, bare)
        out[g] = (width - len(own)) * np.abs(bare - bare[g]) + bare * below - sums[below] + (sums[-1] - sums[below]) - bare * (len(own) - below)
        # and what its cells change
        if len(some):
            at = line[col]
            out[g, some] += np.add.reduceat(np.abs(at - p) - np.abs(at - bare[of]), start[some])
    return out


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, run_bytes: int = RUN_BYTES, block: int = BLOCK) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank; see above."""
    each = count_terms(docs, run_bytes).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    known = each.withColumn("all_docs", F.sum("docs").over(term)).where(F.col("all_docs") >= min_docs)
    known = known.withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
    cells = materialise(known.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "first"), "terms")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = cells.groupBy("lang").agg(F.sum("first").alias("kept"), F.count("*").alias("cells"))
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "cells")))
    # Blocks of a language: as its cells ask for, and no more than its pairs of sources make worth while.
    pairs = groups.groupBy("lang").agg((F.count("*") * F.count("*")).alias("pairs"))
    blocks = pairs.join(langs, "lang", "left").select("lang", F.greatest(F.lit(1), F.ceil(F.coalesce("cells", F.lit(0)) / F.greatest(F.lit(block), "pairs"))).cast("long").alias("blocks"))
    blocks = materialise(blocks, "blocks")
    if blocks.limit(FEW_LANGS + 1).count() <= FEW_LANGS:  # else a join by language, which AQE splits where it is skewed
        blocks = F.broadcast(blocks)
    left = cells.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    right = sources.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>"))).select("lang", "block", "source", "total", "kept")
    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(lambda a, b: _block(a, b, top), PARTS)
    parts = materialise(parts, "divergences")
    pair = parts.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    falling = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pair.withColumn("rank", F.row_number().over(falling))
    terms = parts.where(F.col("part") == "term").withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
