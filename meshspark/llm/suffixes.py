"""Substring deduplication over bytes, by a distributed difference-cover suffix sort.

1. Only bytes that can repeat are sorted: of each window (`length` bytes) the PIECE-byte piece of smallest
   hash must occur elsewhere too, which an exchange of keys tells (`exchange`); equal strings always pass.
   What is left is a set of runs.  Where a run repeats its own last bytes over and over (a period of
   less than a window), the windows behind the first period equal the ones before them, byte for byte:
   they are marked at once and cut out.  Equal runs (128-bit digest) become one, and a run that stands
   there twice is covered as a whole.
2. Runs are cut into phrases at anchors, places that their next bytes decide (`Anchors`).  So equal windows
   hold the same anchors and the same phrases between them; each window belongs to one anchor.  Phrases
   get names in rising byte order.  Anchors keep a distance, so few phrases cover a window, and a few
   steps of the next sort are enough.
3. The suffixes that start at anchors are sorted by the difference cover {1, 2} modulo 3 over phrases:
   triples of names at places 1 and 2 modulo 3 get names in rising order; the strings of names are sorted
   the same way, until they cover `length` bytes (three names that do are sorted as they are) or are all
   different; then the remaining suffixes
   (0 modulo 3) are merged in by their first names and the rank that follows, by counts of smaller
   sampled suffixes.  Every sort is cut into ranges of its whole order, so no phrase or triple stays in
   one task.
4. The suffixes that start between anchors are merged in by the bytes that lead to the next anchor and
   that anchor's rank; neighbours that agree on `length` bytes start elsewhere too.  This is done in
   even ranges of ranks, on the bytes themselves; windows that may go on in the next range are told
   apart by a 128-bit digest.  The bytes of all repeated windows are removed.

A null or empty text has no bytes.  Matches never cross texts.  Rows of equal texts are all removed if
they have `length` bytes or more, whatever their ids.  Other columns of docs are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, exchange
from .shared import arrow_batches, discard, materialise, text_bytes, tidy
from .words import BYTE_POWERS, BYTE_VALUES, U64, byte_window_hashes, mix, per_doc, prefix_sums, slices, text_buffer

PIECE, GRAM, RADIUS = 100, 16, 16
RANGE = 1 << 15  # anchors a task
SEGMENT = 1 << 20  # bytes of runs a chunk
PART = 1 << 16  # bytes that are looked at together: columns of them fit the processor's caches
BATCH = 4 << 20  # bytes of rows that go to a Python worker at once
LAST = np.iinfo(U64).max


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def _starts(off: np.ndarray, length: int) -> np.ndarray:
    counts = np.maximum(np.diff(off) - length + 1, 0)
    return np.repeat(off[:-1] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())


def _segments(off: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, offsets from there) of runs of texts of PART bytes together; a longer text comes in
    parts of PART windows, which share the bytes that windows of both hold."""
    part = min(PART, SEGMENT)
    for i, j in slices(off, part):
        n = int(off[j] - off[i])
        if j > i + 1 or n <= part + length:
            yield int(off[i]), off[i : j + 1] - off[i]
        else:
            yield from ((int(off[i]) + s, np.array([0, min(n - s, part + length - 1)])) for s in range(0, n - length + 1, part))


class Candidates:
    """Windows of one chunk and the pieces that stand for them."""

    def __init__(self, table: pa.Table, length: int):
        self.buf, self.off = text_buffer(table.column("text"))
        piece = min(PIECE, length)
        width = length - piece + 1  # pieces of a window
        at, n, stand, pieces = [], [], [], []
        for base, o in _segments(self.off, length):
            b = self.buf[base : base + o[-1]]
            w = _starts(o, length)
            if not len(w):
                continue
            p = _starts(o, piece)
            g = np.full(len(b) + length, LAST, U64)
            g[p] = byte_window_hashes(prefix_sums(BYTE_VALUES[b], BYTE_POWERS), p, piece)
            low = _lowest(g, width)[w]
            # Neighbouring windows mostly share their piece: they go on as one row.
            head = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (np.diff(w) != 1)))
            at.append(w[head] + base)
            n.append(np.diff(np.append(head, len(w))))
            stand.append(low[head])
            # Pieces that stand for a window: the greatest least hash of the windows around is theirs.
            least = np.zeros(len(b) + length, U64)
            least[w + width - 1] = low
            pieces.append(g[p][~_lowest(~least, width)[p] == g[p]])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.at, self.n = join(at, np.int64), join(n, np.int64)
        # Least hashes lie close together; mixed again, keys fill all buckets alike.
        self.stand = mix(join(stand, U64))
        self.keys = np.sort(self.stand)
        self.keys = self.keys[np.append(True, self.keys[1:] != self.keys[:-1])[: len(self.keys)]]
        every = np.sort(mix(join(pieces, U64)))
        self.own = np.searchsorted(every, self.keys, "right") - np.searchsorted(every, self.keys, "left") > 1

    def runs(self, elsewhere: np.ndarray, length: int) -> list[tuple[int, int, int]]:
        """(text, first byte, end) of what may repeat."""
        ok = (self.own | elsewhere)[np.searchsorted(self.keys, self.stand)] if len(self.keys) else np.zeros(0, bool)
        at, end = self.at[ok], (self.at + self.n)[ok]
        doc = np.searchsorted(self.off, at, "right") - 1
        head = np.flatnonzero(np.append(True, (at[1:] != end[:-1]) | (np.diff(doc) != 0))[: len(at)])
        tail = np.append(head[1:], len(at))[: len(head)] - 1
        return [(int(doc[a]), int(at[a] - self.off[doc[a]]), int(end[b] - 1 - self.off[doc[a]]) + length) for a, b in zip(head, tail, strict=True)]


def _looks(length: int) -> tuple[int, int]:
    """(radius, bytes that decide on a trigger) for windows of `length` bytes."""
    radius = min(RADIUS, (length - GRAM - 1) // 8)
    return radius, GRAM + 2 * radius


def most_triggers(length: int) -> int:
    """Triggers that start in a window of `length` bytes and end in it or at its end, at most: two are more than a radius apart."""
    radius, looks = _looks(length)
    return -(-(length - looks) // (radius + 1))


def _triggers(buf: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Places p where, of the hashes of the GRAM bytes from p to p + 2 * radius on, the middle one is the first of the least."""
    radius, looks = _looks(length)
    w, hit = _starts(off, looks), np.zeros(len(buf), bool)
    if len(w) and radius:
        p, g = _starts(off, GRAM), np.full(len(buf), LAST, U64)
        g[p] = byte_window_hashes(prefix_sums(BYTE_VALUES[buf], BYTE_POWERS), p, GRAM)
        low, middle = _lowest(g, radius), g[w + radius]
        hit[w] = (middle < low[w]) & (middle <= low[w + radius + 1])
    else:
        hit[w] = True
    return hit


def without_periods(x: bytes, hits: np.ndarray | None, length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(runs to keep, spans that are covered): long stretches without a trigger are nearly always periodic.

    hits: places of triggers in x, where it has 2 * length bytes or more.
    """
    buf = np.frombuffer(x, np.uint8)
    n, keep, covered, begin = len(x), [], [], 0
    if n >= 2 * length:
        edges = np.concatenate([[-1], hits, [n]])
        for u, v in zip(edges[:-1] + 1, edges[1:], strict=True):
            at = int(max(u, begin))
            while at + length < v:
                step = x.find(x[at : at + length], at + 1, at + 2 * length) - at
                if step <= 0:
                    at += length // 4
                    continue
                unlike = np.flatnonzero(buf[at + length : n - step] != buf[at + length + step :])
                end = at + length + (int(unlike[0]) if len(unlike) else n - step - at - length)  # bytes at..end - 1 come again
                covered.append((at, end + step))
                # Windows at + step .. end - length + step equal those before them.
                keep.append((begin, at + step - 1 + length))
                begin = end - length + step + 1
                at = begin
    if begin + length <= n:
        keep.append((begin, n))
    return keep, covered


def _with_triggers(runs: list[tuple], data: list[bytes], length: int) -> Iterator[tuple[tuple, bytes, np.ndarray | None]]:
    """Each run with its bytes, and its triggers if it is long: made for many runs at once."""
    off = np.append(0, np.cumsum([len(x) if len(x) >= 2 * length else 0 for x in data])).astype(np.int64)
    for i, j in slices(off, PART):
        own = off[i : j + 1] - off[i]
        hits = np.flatnonzero(_triggers(np.frombuffer(b"".join(x for x in data[i:j] if len(x) >= 2 * length), np.uint8), own, length))
        cut = np.searchsorted(hits, own)
        yield from ((runs[k], data[k], hits[cut[k - i] : cut[k - i + 1]] - own[k - i]) for k in range(i, j))


def candidate_runs(texts: DataFrame, length: int) -> DataFrame:
    """(k, start, end, run, bytes) of texts (k, text); run is a digest of the bytes.

    Rows without run and bytes are spans that repeat in their own text.
    """

    def finish(table: pa.Table, bits: exchange.Bits) -> pa.Table:
        c, ids = Candidates(table, length), table.column("k").to_pylist()
        raw = c.buf.tobytes()
        rows = []
        runs = c.runs(bits[0], length)
        for (d, a, _), x, hits in _with_triggers(runs, [raw[c.off[d] + a : c.off[d] + b] for d, a, b in runs], length):
            keep, covered = without_periods(x, hits, length)
            # A long run comes in parts, each window in one of them.
            keep = [(at, min(q, at + SEGMENT + length - 1)) for p, q in keep for at in range(p, q - length + 1, SEGMENT)]
            rows += [(ids[d], a + p, a + q, hashlib.blake2b(x[p:q], digest_size=16).digest(), x[p:q]) for p, q in keep]
            rows += [(ids[d], a + p, a + q, None, None) for p, q in covered]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, (*[pa.int64()] * 3, *[pa.binary()] * 2), strict=True)], names=["k", "start", "end", "run", "bytes"])

    level = exchange.Level(lambda t, _: (Candidates(t, length).keys, None))
    return materialise(exchange.run(texts, "k", "text", [level], finish, "k long, start long, end long, run binary, bytes binary"), "runs")


class Anchors:
    """Anchors of a batch of runs (buf[off[r]:off[r + 1]], `length` bytes each at least), in order.

    A trigger is a place whose next `looks` bytes have their least hash in the middle (`_triggers`).  Every
    trigger is an anchor, and a window belongs to its first trigger.  The start of a window without triggers
    is an anchor of its own.  low and high: the windows of an anchor start that many bytes before it.

    A trigger's phrase goes up to the end of the next one, or for `length` bytes where that is farther: then
    no window needs what follows, and the string of phrases ends.  The phrase of a window without triggers is
    a mark with a digest of the window, a string of its own.  size: anchors of each string.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int):
        looks = _looks(length)[1]
        reach = length - looks
        first, end = (np.repeat(x, np.diff(off)) for x in (off[:-1], off[1:]))
        place = np.arange(len(buf))
        hit = _triggers(buf, off, length)
        ahead = np.minimum.accumulate(np.where(hit, place, len(buf) + length)[::-1])[::-1] if len(buf) else place
        alone = (ahead > place + reach) & (place <= end - length)
        self.at = at = np.flatnonzero(hit | alone)
        self.hit = hit = hit[at]
        self.run = np.searchsorted(off, at, "right") - 1
        self.first, self.end = first[at], end[at]
        trigger = np.flatnonzero(hit)
        before, behind = np.full(len(at), -1), np.full(len(at), len(buf) + length)
        before[trigger[1:]], behind[trigger[:-1]] = at[trigger[:-1]], at[trigger[1:]]
        before, behind = np.maximum(before, self.first - 1), np.where(behind < self.end, behind, len(buf) + length)
        self.high = np.where(hit, np.minimum(reach, at - before - 1), 0)
        self.low = np.where(hit, np.maximum(0, at - (self.end - length)), 0)
        self.phrase_end = np.minimum(np.minimum(behind + looks, at + length), self.end)
        starts = np.ones(len(at), bool)
        starts[trigger[1:]] = behind[trigger[:-1]] > at[trigger[:-1]] + reach
        self.size = np.diff(np.append(np.flatnonzero(starts), len(at)))

    def phrases(self, raw: bytes) -> list[bytes]:
        mark = lambda x: b"\x00" * GRAM + hashlib.blake2b(x, digest_size=16).digest()
        return [raw[p:q] if hit else mark(raw[p:q]) for p, q, hit in zip(self.at.tolist(), self.phrase_end.tolist(), self.hit.tolist(), strict=True)]


CHUNK = "chunk long, s binary, n binary, bytes binary"


def chunked(runs: DataFrame, total: int) -> DataFrame:
    """CHUNK of runs (s, bytes): about SEGMENT bytes in a row, one run behind the other."""

    def pack(table: pa.Table) -> pa.Table:
        buf, off = text_buffer(table.column("bytes"))
        made = [table.column("_chunk")[0].as_py(), table.column("s").to_numpy().tobytes(), np.diff(off).astype(np.int64).tobytes(), buf.tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(made, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "s", "n", "bytes"])

    chunks = max(1, -(-total // SEGMENT))
    return materialise(exchange.dealt(runs.select("s", "bytes"), "s", chunks).groupBy("_chunk").applyInArrow(tidy(pack), CHUNK), "chunks")


def _parsed(n: np.ndarray, data: bytes, length: int) -> Iterator[tuple[int, int, Anchors, bytes]]:
    """Of runs of n bytes each, for slices (i, j): their anchors and bytes."""
    buf, off = np.frombuffer(data, np.uint8), np.append(0, np.cumsum(n))
    for i, j in slices(off, PART):
        x = buf[off[i] : off[j]]
        yield i, j, Anchors(x, off[i : j + 1] - off[i], length), x.tobytes()


PHRASES = "part long, chunk long, n binary, bytes binary"
NAMES = "part long, chunk long, c binary, different long"


def _distinct(phrases: list[bytes] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different phrases in rising byte order, the place of each given one among them)."""
    coded = (phrases if isinstance(phrases, pa.Array) else pa.array(phrases, pa.large_binary())).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _sized(n: np.ndarray, data: bytes) -> pa.Array:
    """Texts of n bytes each that lie one behind the other."""
    off = np.append(0, np.cumsum(n)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _phrases(row: dict, length: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different phrases of a chunk, the place of each anchor's among them, anchors of each string)."""
    found, sizes = [], [np.zeros(0, np.int64)]
    for _, _, a, raw in _parsed(np.frombuffer(row["n"], np.int64), row["bytes"], length):
        found += a.phrases(raw)
        sizes.append(a.size)
    return *_distinct(found), np.concatenate(sizes)


def named_phrases(chunks: DataFrame, length: int) -> DataFrame:
    """(chunk, n, c): the strings of phrase names of the chunks' runs, names in rising byte order.

    The order of all phrases is cut into even ranges.  Each chunk sends its different phrases to them in
    one block a range and gets their numbers there back.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(r["n"], np.int64)
                i = next(iter(slices(np.append(0, np.cumsum(n)), 2 * PART)), (0, 0))[1]
                some, _, _ = _phrases({"n": n[:i].tobytes(), "bytes": r["bytes"][: n[:i].sum()]}, length)
                pick = np.unique(np.random.default_rng(r["chunk"] & 0xFFFF).integers(0, len(some), blocks.SAMPLE)) if len(some) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(some) * len(r["bytes"]) // max(int(n[:i].sum()), 1)], pa.int64()), pa.array([some.take(pa.array(pick)).to_pylist()], pa.list_(pa.binary()))], names=["n", "some"])

    got = chunks.select("chunk", "n", "bytes").mapInArrow(sample, "n long, some array<binary>").toArrow().to_pydict()
    ranges = max(1, -(-sum(got["n"]) // blocks.RANGE))
    found = sorted(x for some in got["some"] for x in some)
    cuts = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                phrases, _, _ = _phrases(r, length)
                buf, off = text_buffer(phrases)
                listed, n = phrases.to_pylist(), np.diff(off)
                edges = [0, *(bisect_left(listed, x) for x in cuts), len(listed)]
                rows = [(k, r["chunk"], n[i:j].tobytes(), buf[off[i] : off[j]].tobytes()) for k, (i, j) in enumerate(pairwise(edges)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (*[pa.int64()] * 2, *[pa.binary()] * 2), strict=True)], names=["part", "chunk", "n", "bytes"])

    def name(table: pa.Table) -> pa.Table:
        n = [np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()]
        different, place = _distinct(_sized(np.concatenate(n), b"".join(table.column("bytes").to_pylist())))
        ends = np.cumsum([len(x) for x in n])
        c = [(place[e - len(x) : e] + 1).tobytes() for x, e in zip(n, ends, strict=True)]
        return pa.table([table.column("part"), table.column("chunk"), pa.array(c, pa.binary()), pa.array([len(different)] * len(n), pa.int64())], names=["part", "chunk", "c", "different"])

    names = materialise(chunks.select("chunk", "n", "bytes").mapInArrow(send, PHRASES).groupBy("part").applyInArrow(tidy(name), NAMES), "names")
    bases, total = {}, 0
    for r in names.groupBy("part").agg(F.first("different").alias("n")).orderBy("part").collect():  # one row a range
        bases[r["part"]] = total
        total += r["n"]

    def replace(table: pa.Table, got: pa.Table) -> pa.Table:
        # Names rise with the phrases: those of the ranges in order fit the chunk's.
        answers = sorted(got.to_pylist(), key=lambda r: r["part"])
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["c"], np.int64) + bases[r["part"]] for r in answers)])
        made = []
        for r in table.to_pylist():
            _, place, sizes = _phrases(r, length)
            made.append((r["chunk"], sizes.astype(np.int64).tobytes(), c[place].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "n", "c"])

    strings = materialise(chunks.select("chunk", "n", "bytes").groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(tidy(replace), "chunk long, n binary, c binary"), "strings")
    discard(names)
    return strings


def _inside(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in its string, end of its string) of each symbol of strings of n symbols."""
    ends = np.repeat(np.cumsum(n), n)
    return np.arange(len(ends)) - (ends - np.repeat(n, n)), ends


def _after(x: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The value k symbols on in the same string; 0 past its end."""
    at = np.arange(len(x)) + k
    return np.where(at < ends, x[np.minimum(at, len(x) - 1)], 0) if len(x) else x


def _shorter(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each string's places at 1 and at 2 modulo 3 as two strings: (their lengths, the places in order)."""
    i, _ = _inside(n)
    m, of = i % 3, np.repeat(np.arange(len(n)), n)
    places = np.flatnonzero(m)
    places = places[np.lexsort((places, m[places], of[places]))]
    return np.stack([(n + 1) // 3, n // 3], 1).ravel(), places


def suffix_ranks(strings: DataFrame, reach: int) -> DataFrame:
    """(chunk, r) of strings (chunk, n, c), c > 0: the rank of the suffix at each symbol, from 1 without gaps or ties.

    Ranks rise with the first `reach` symbols; what ends is smaller than what goes on.  Suffixes that
    agree on those may stand in any order, so a symbol or triple that is common fills several ranges.
    """

    short = reach <= 3

    def triples(r: blocks.Row) -> tuple[np.ndarray, list[np.ndarray]]:
        i, ends = _inside(r["n"])
        at = np.arange(len(i)) if short else np.flatnonzero(i % 3)
        return at, [_after(r["c"], ends, k)[at] for k in range(3)]

    size = lambda r: len(r["c"])
    answers, bases, different, rows = blocks.ranked(strings, triples, "number" if short else "names", "triples")
    if short:
        return _by_place(strings, answers, bases)
    keep = lambda r, v: {"chunk": r["chunk"], "n": r["n"], "c": r["c"], "r": v}
    named = blocks.attach(strings, answers, bases, keep, size, "chunk long, n binary, c binary, r binary", "named")
    if different < rows:

        def shorten(r: blocks.Row, _: np.ndarray) -> blocks.Row:
            n, places = _shorter(r["n"])
            return {"chunk": r["chunk"], "n": n, "c": r["r"][places]}

        ranks = suffix_ranks(blocks.each(named, shorten, "chunk long, n binary, c binary", "shorter"), -(-reach // 3))

        def lengthen(table: pa.Table, got: pa.Table) -> pa.Table:
            made = []
            for r, q in zip(blocks.rows_of(table), blocks.rows_of(got), strict=True):
                out = np.zeros(len(r["c"]), np.int64)
                out[_shorter(r["n"])[1]] = q["r"]
                made.append((r["chunk"], r["n"].tobytes(), r["c"].tobytes(), out.tobytes()))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["chunk", "n", "c", "r"])

        before, named = named, materialise(named.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(tidy(lengthen), "chunk long, n binary, c binary, r binary"), "named")
        discard(before, ranks)

    # How many sampled suffixes stand before a remaining one: by (c, rank of the next) among those at 1
    # modulo 3, by (c, next c, rank of the one after) among those at 2.  Both orders are one, kind first.
    def neighbours(r: blocks.Row) -> tuple[np.ndarray, list[np.ndarray]]:
        i, ends = _inside(r["n"])
        m, c = i % 3, r["c"]
        one, two = np.flatnonzero(m != 2), np.flatnonzero(m != 1)
        join = lambda x, y: np.concatenate([x[one], y[two]])
        kind, zero = np.repeat([1, 2], [len(one), len(two)]), np.zeros(len(c), np.int64)
        places = np.concatenate([one, two + len(c)])
        return places, [kind, join(c, c), join(_after(r["r"], ends, 1), _after(c, ends, 1)), join(zero, _after(r["r"], ends, 2)), join((m > 0).astype(np.int64), (m > 0).astype(np.int64))]

    answers, bases, _, _ = blocks.ranked(named, neighbours, "marked", "neighbours")
    first = blocks.total(named.select("n"), lambda r: int(((r["n"] + 1) // 3).sum()), F.sum)

    def placed(r: blocks.Row, v: np.ndarray) -> blocks.Row:
        i, _ = _inside(r["n"])
        n = len(r["c"])
        # Those of kind 2 come behind all of kind 1.
        return {"chunk": r["chunk"], "n": r["n"], "c": r["c"], "r": r["r"], "p": np.where(i % 3, r["r"] - 1, v[:n] + v[n:] - first)}

    full = blocks.attach(named, answers, bases, placed, lambda r: 2 * len(r["c"]), "chunk long, n binary, c binary, r binary, p binary", "placed")
    discard(named)

    # A remaining suffix goes before the sampled one that has as many before it.
    def order(r: blocks.Row) -> tuple[np.ndarray, list[np.ndarray]]:
        i, ends = _inside(r["n"])
        rest = i % 3 == 0
        zero = np.zeros(len(i), np.int64)
        return np.arange(len(i)), [r["p"], (~rest).astype(np.int64), np.where(rest, r["c"], zero), np.where(rest, _after(r["r"], ends, 1), zero)]

    answers, bases, _, _ = blocks.ranked(full, order, "number", "order")
    out = _by_place(full, answers, bases)
    discard(full)
    return out


def _by_place(strings: DataFrame, answers: DataFrame, bases: dict[int, int]) -> DataFrame:
    """(chunk, r): chunks get their numbers by place; of themselves only the number of symbols is needed."""
    sizes = strings.select("chunk", (F.octet_length("c") / 8).cast("long").alias("size"))
    return blocks.attach(sizes, answers, bases, lambda r, v: {"chunk": r["chunk"], "r": v}, lambda r: r["size"], "chunk long, r binary", "ranks")


COLUMNS = ("rank", "s", "at", "low", "high", "n")
CONTEXTS = f"part long, {', '.join(f'{c} binary' for c in COLUMNS)}, bytes binary"


def _contexts(chunks: DataFrame, ranks: DataFrame, length: int) -> DataFrame:
    """CONTEXTS: anchors that windows belong to, in even ranges of ranks; a block of a chunk's a row.

    bytes: of each anchor, `high` bytes before it and up to `length` from it on; n bytes together.
    """
    total = blocks.total(ranks.select("r"), lambda r: int(r["r"].max(initial=0)), F.max)
    parts = max(1, -(-total // RANGE))

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], pa.int64())] + [pa.array([], pa.binary())] * (len(COLUMNS) + 1), names=["part", *COLUMNS, "bytes"])]
        for r in table.to_pylist():
            s, rank, base = np.frombuffer(r["s"], np.int64), np.frombuffer(got.column("r")[0].as_py(), np.int64), 0
            for i, j, a, raw in _parsed(np.frombuffer(r["n"], np.int64), r["bytes"], length):
                mine = rank[base : base + len(a.at)]
                base += len(a.at)
                k = np.flatnonzero(a.low <= a.high)
                k = k[np.argsort(mine[k])]
                at, low, high = a.at[k], a.low[k], a.high[k]
                first, end = at - high, np.minimum(at + length, a.end[k])
                cols = [mine[k], s[i:j][a.run[k]], at - a.first[k], low, high, end - first]
                part = (mine[k] - 1) * parts // max(total, 1)
                some, begin = np.unique(part, return_index=True)
                first, end = first.tolist(), end.tolist()
                spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(k)], strict=False))
                packed = [pa.array([c[p:q].astype(np.int64).tobytes() for p, q in spans], pa.binary()) for c in cols]
                data = [b"".join([raw[x:y] for x, y in zip(first[p:q], end[p:q], strict=True)]) for p, q in spans]
                out.append(pa.table([pa.array(some, pa.int64()), *packed, pa.array(data, pa.binary())], names=out[0].column_names))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(tidy(run), CONTEXTS)


class Suffixes:
    """Anchors of one range of ranks, and the windows that belong to them."""

    def __init__(self, table: pa.Table, length: int):
        rank, s, at, low, high, size = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in COLUMNS)
        order = np.argsort(rank, kind="stable")
        self.s, self.at, self.low, self.high = (c[order] for c in (s, at, low, high))
        self.raw, self.length = _sized(size, b"".join(table.column("bytes").to_pylist())).take(pa.array(order)), length
        buf, off = text_buffer(self.raw)
        n = len(order)
        right = np.diff(off) - self.high
        self.left = self._matrix(buf, off[1:] - right - 1, self.high, -1)
        ahead = self._matrix(buf, off[1:] - right, right, 1)
        self.common = np.zeros(n, np.int64)  # with the neighbour before
        same = ahead[1:] == ahead[:-1]
        first = np.where(same.all(1), same.shape[1], same.argmin(1)) if same.size else np.zeros(max(n - 1, 0), np.int64)
        self.common[1:] = np.minimum(first, np.minimum(right[1:], right[:-1]))

    @staticmethod
    def _matrix(buf: np.ndarray, start: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
        """A row per anchor: n bytes from `start` on, forwards or backwards, and zeros behind them."""
        width = int(n.max(initial=0))
        padded = np.append(buf[::step], np.zeros(width + 1, np.uint8))
        out = np.lib.stride_tricks.sliding_window_view(padded, width)[start if step > 0 else len(buf) - 1 - start]
        out *= np.arange(width) < n[:, None]
        return out

    def _beside(self) -> np.ndarray:
        """Windows that an anchor beside theirs in the order of ranks shows to be repeated, by anchor and bytes before it."""
        n, most = self.left.shape
        d = np.arange(most + 1)
        same = self.left[1:] == self.left[:-1]
        back = np.where(same.all(1), most, same.argmin(1)) if same.size else np.zeros(max(n - 1, 0), np.int64)
        back = np.minimum(back, np.minimum(self.high[1:], self.high[:-1]))[:, None]
        # They have `back` bytes before them and `common` from them on alike.
        pair = (d <= back) & (d >= self.length - self.common[1:, None])
        found = np.zeros((n, most + 1), bool)
        found[1:] |= pair
        found[:-1] |= pair
        return found & (d >= self.low[:, None]) & (d <= self.high[:, None])

    def _unsettled(self, found: np.ndarray) -> np.ndarray:
        """Anchors of groups, alike as far as any window may ask, that have windows not found yet, or lie at an end of the range."""
        n, most = self.left.shape
        group = np.cumsum(self.common < self.length - most)
        left = found.sum(1) <= self.high - self.low
        left[[0, -1]] = True
        return np.flatnonzero(np.isin(group, group[left]))

    @staticmethod
    def _groups(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each anchor in the order of the bytes before it, read backwards; bytes in common with the one before in it)."""
        n, most = left.shape
        if not most:
            return np.arange(n), np.zeros(n, np.int64)
        order = np.argsort(np.ascontiguousarray(left).view(f"V{most}").ravel(), kind="stable")
        same = left[order[1:]] == left[order[:-1]]
        common = np.zeros(n, np.int64)
        common[1:] = np.where(same.all(1), most, same.argmin(1)) if n > 1 else 0
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return place, common

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(found, open): windows with an equal one in this range, by anchor and bytes before it; and (anchor,
        bytes before it) of windows that the ranges beside it may hold too, one of equal ones."""
        found, edge = self._beside(), [np.zeros((0, 2), np.int64)]
        # Of the others all windows are found, and none that another range may hold.
        own = self._unsettled(found) if len(self.s) else np.zeros(0, np.int64)
        common, low, high, n = self.common[own], self.low[own], self.high[own], len(own)
        place, alike = self._groups(self.left[own])
        rows = np.arange(n)
        for d in range(int(high.max(initial=-1)) + 1):
            rows = rows[high[rows] >= d]
            k = rows[low[rows] <= d]
            if not len(k):
                continue
            part = np.cumsum(common < self.length - d)  # suffixes that agree as far as a window needs
            key = part[k] * (n + 1) + np.cumsum(alike < d)[place[k]]  # and that have d bytes before them in common
            order = np.argsort(key, kind="stable")
            again = np.diff(key[order]) == 0
            twice = np.zeros(len(k), bool)
            twice[order[1:]] |= again
            twice[order[:-1]] |= again
            found[own[k], d] = twice
            beside = np.flatnonzero((part[k] == part[0]) | (part[k] == part[-1]))
            one = own[k[beside[np.unique(key[beside], return_index=True)[1]]]]
            edge.append(np.stack([one, np.full(len(one), d)], 1))
        return found, np.concatenate(edge)


MARKS = "s long, first long, end long, key binary"


def _resolve(table: pa.Table, length: int) -> pa.Table:
    """Spans of repeated windows (key is null), and one row per different window that another range may
    hold: with its place where it has no equal in this range."""
    x = Suffixes(table, length)
    found, edge = x.repeated()
    step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)  # found for first <= d < last
    rows = [x.s[row], x.at[row] - last + 1, x.at[row] - first + length]
    spans = pa.table([*map(pa.array, rows), pa.nulls(len(row), pa.binary())], names=["s", "first", "end", "key"])
    keys: dict[bytes, tuple] = {}
    for r, d in edge.tolist():
        h = int(x.high[r])
        key = hashlib.blake2b(x.raw[r].as_py()[h - d : h - d + length], digest_size=16).digest()
        keys[key] = (None, None, None) if found[r, d] else (int(x.s[r]), int(x.at[r]) - d, int(x.at[r]) - d + length)
    open_ = list(zip(*keys.values(), strict=True)) or [[]] * 3
    other = pa.table([*(pa.array(c, pa.int64()) for c in open_), pa.array(list(keys), pa.binary())], names=["s", "first", "end", "key"])
    return pa.concat_tables([spans, other])


def repeated_spans(runs: DataFrame, length: int) -> DataFrame:
    """(s, first, end) of runs (s, bytes): bytes of windows that start elsewhere too."""
    chunks = chunked(runs, text_bytes(runs, "bytes"))
    strings = named_phrases(chunks, length)
    ranks = suffix_ranks(strings, most_triggers(length))
    marks = materialise(_contexts(chunks, ranks, length).groupBy("part").applyInArrow(tidy(lambda t: _resolve(t, length)), MARKS), "marks")
    discard(chunks, strings, ranks)
    beside = marks.where("key IS NOT NULL")
    many = beside.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = beside.where("s IS NOT NULL").join(many, "key").select("s", "first", "end")
    return marks.where("key IS NULL").select("s", "first", "end").unionAll(met)


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    if length <= GRAM:
        raise ValueError(f"length must be greater than {GRAM}")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    with arrow_batches(docs.sparkSession, 500, BATCH):
        found = candidate_runs(texts.select("k", "text"), length)
        occurrences = found.where("run IS NOT NULL")
        runs = occurrences.groupBy("run").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
        runs = materialise(runs.withColumn("s", F.monotonically_increasing_id()), "distinct")
        spans = repeated_spans(runs, length)
    of = spans.groupBy("s").agg(F.collect_list(F.struct("first", "end")).alias("spans"))  # of one run
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.octet_length("bytes").cast("long").alias("end")))
    marked = runs.select("run", "s", "copies", whole.alias("whole")).join(of, "s", "left").where("copies > 1 OR spans IS NOT NULL")
    marked = marked.select("run", F.when(F.col("copies") > 1, F.col("whole")).otherwise(F.col("spans")).alias("spans"))
    marks = occurrences.select("k", "start", "run").join(marked, "run").select("k", "start", "spans")
    own = found.where("run IS NULL").select("k", F.lit(0).cast("long").alias("start"), F.array(F.struct(F.col("start").alias("first"), "end")).alias("spans"))
    marks = marks.unionAll(own)

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        buf, off = text_buffer(table.column("text"))
        ids = table.column("k").to_numpy()
        order = np.argsort(ids, kind="stable")
        spans_ = found.column("spans").combine_chunks()
        n = np.diff(spans_.offsets.to_numpy())
        flat = spans_.flatten()
        k, start = (np.repeat(found.column(c).to_numpy(), n) for c in ("k", "start"))
        first, end = (flat.field(c).to_numpy() + start for c in ("first", "end"))
        step = np.zeros(len(buf) + 1, np.int64)
        low, high = (np.searchsorted(ids[order], k, s) for s in ("left", "right"))
        for turn in range(int((high - low).max(initial=0))):  # rows with equal id and text
            some = low + turn < high
            base = off[order[(low + turn)[some]]]
            np.add.at(step, base + first[some], 1)
            np.add.at(step, base + end[some], -1)
        gone = np.cumsum(step[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = off[:-1][np.diff(off) > 0]
        begins[starts] = gone[starts]
        kept, raw = buf[~gone].tobytes(), np.append(0, np.cumsum(per_doc(~gone, off)))
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(raw[:-1].tolist(), raw[1:].tolist(), strict=True)]
        return pa.table({"doc_id": table.column("doc_id").combine_chunks(), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(per_doc(gone, off)), "n_spans": pa.array(per_doc(begins, off)), "kept_sha256": pa.array(digests, pa.string())})

    chunks, _ = exchange.counts(texts, "text")
    deal = lambda df: exchange.dealt(df, "k", chunks).groupBy("_chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    return deal(texts).cogroup(deal(marks)).applyInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
