"""Jaccard join of texts on word n-grams, by vertical partitioning.

1. Every text becomes its set of different n-grams (64-bit hashes).  Equal sets are one *class*.
2. N-grams are counted: chunks of texts send their n-grams to buckets (ranges of hashes, sized by the
   input), each once per chunk however often it stands there (with its count); those that occur once
   come back no more.  A class of n grams of which fewer than the least overlap are shared has no partner.
3. The global order is by rising count, then hash; counts of 65535 and more rank alike, which no link
   depends on.  Two classes that are similar enough share an n-gram
   of their prefixes in that order (prefix filter).
4. The global order is cut into FRAGMENTS ranges of about equal volume.  A pair's overlap is counted in
   each fragment on its own, and the counts are summed per pair: that decides a link, exactly.

Pairs that must be counted: first each class with one that leads most of its prefix n-grams (the likeliest
hub of near copies, or of a component drawn by hash), over LEADER_ROUNDS rounds, so that large groups of
near copies become one component by as many pairs as they have members.  Then *all* pairs of different
components that share a prefix n-gram, lie in neighbouring classes of size (a third apart, as much as
a link allows), and pass the filters on size and position.  Pairs inside a component can't change the result and are left out; no
other pair is.

A null or empty text has an empty set, links with nothing, and is its own component.  A text of fewer
words than the shingle has its whole word sequence as its one n-gram.  Rows of equal ids are told apart
by their sets; a null id never names a component that has another one.

An empty table gives no rows.  Columns other than id and text are not read.  Very long texts are cut into words by one
task and take part with all their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, small_batches, text_bytes
from .words import NON_SPACE, U64, find_words, mix, slices, text_buffer

CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
FRAGMENTS, LEADER_ROUNDS = 8, 3
MOVED = "bucket long, chunk long, info boolean, a binary, b binary, c binary"


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of each text in rising order, first of each text, a hash of each set)."""
    w = find_words(buf, off, NON_SPACE, lower=True)
    doc = w.doc()
    at, h = w.windows(k)
    docs, grams = [doc[at]], [h]
    for m in range(1, k):
        at, h = w.windows(m)
        whole = w.counts[doc[at]] == m
        docs.append(doc[at][whole])
        grams.append(h[whole])
    docs, grams = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((grams, docs))
    docs, grams = docs[order], grams[order]
    head = np.ones(len(docs), bool)
    head[1:] = (docs[1:] != docs[:-1]) | (grams[1:] != grams[:-1])
    docs, grams = docs[head], grams[head]
    first = np.searchsorted(docs, np.arange(len(off)))
    sums = np.zeros(len(grams) + 1, U64)
    np.cumsum(mix(grams), out=sums[1:])
    return grams, first, mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64))


def planes(x: np.ndarray) -> bytes:
    """Bytes of sorted keys, all first ones, then all second ones...: the leading ones compress well."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(U64)


def sets_of(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, sid); sid is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in slices(off):
                _, first, sid = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(n), pa.array(sid.view(np.int64), mask=n == 0)], names=["doc_id", "n_shingles", "sid"])

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_shingles long, sid long"), "sets")


def _rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "chunk", "info", "a", "b", "c"])


def _send(texts: list[pa.Array], chunk: int, buckets: int, k: int) -> pa.Table:
    buf, off = text_buffer(pa.chunked_array(texts))
    parts = [shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k) for i, j in slices(off)]
    sid = np.concatenate([p[2] for p in parts])
    n = np.concatenate([np.diff(p[1]) for p in parts])
    grams = np.concatenate([p[0] for p in parts])
    _, lead = np.unique(sid, return_index=True)  # equal sets of a chunk count once
    keep = np.zeros(len(sid), bool)
    keep[lead] = True
    keep &= n > 0
    place = np.cumsum(keep) - 1
    own = np.repeat(np.arange(len(sid)), n)
    grams, own = grams[keep[own]], place[own[keep[own]]].astype(np.uint32)
    order = np.argsort(grams, kind="stable")
    grams, own = grams[order], own[order]
    head = np.ones(len(grams), bool)
    head[1:] = grams[1:] != grams[:-1]
    at = np.flatnonzero(head)
    times, grams = np.diff(np.append(at, len(own))).astype(np.uint32), grams[at]
    bucket = ((grams >> U64(32)) * U64(buckets)) >> U64(32)
    some, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(grams))[: len(some)]
    small = np.uint16 if keep.sum() <= 1 << 16 else np.uint32
    # An n-gram of one set goes with the set; one of several goes once, with their number, and which sets
    # they are stays with the chunk.
    light = times == 1
    kind = np.dtype(small).str.encode()
    rows = [(chunk % buckets, chunk, True, planes(sid[keep]), n[keep].astype(np.uint32).tobytes(), kind + own[~np.repeat(light, times)].astype(small).tobytes())]
    single = own[at].astype(small)
    for x, s, e in zip(some, first, ends, strict=True):
        one, many = np.flatnonzero(light[s:e]) + s, np.flatnonzero(~light[s:e]) + s
        rows.append((int(x), chunk, False, planes(grams[one]), single[one].tobytes(), kind))
        if len(many):
            rows.append((int(x), chunk, False, planes(grams[many]), times[many].tobytes(), b"many"))
    return _rows(rows)


def _count(table: pa.Table) -> pa.Table:
    """What a bucket got: n-grams of two sets and more go back to their chunks, with their counts."""
    rows = table.select(["bucket", "chunk", "info", "a", "b", "c"]).to_pylist()
    back = [tuple(r.values()) for r in rows if r["info"]]
    sent = [r for r in rows if not r["info"]]
    if sent:
        blocks = [from_planes(r["a"]) for r in sent]
        keys = np.concatenate(blocks)
        here = np.concatenate([np.frombuffer(r["b"], np.uint32).astype(np.int64) if r["c"] == b"many" else np.ones(len(x), np.int64) for r, x in zip(sent, blocks, strict=True)])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        total = np.add.reduceat(here[order], np.flatnonzero(head)) if len(s) else here
        n = np.empty(len(keys), np.int64)
        n[order] = total[np.cumsum(head) - 1]
        ends = np.cumsum([len(x) for x in blocks])
        for r, keys, e in zip(sent, blocks, ends, strict=True):
            times = np.minimum(n[e - len(keys) : e], 65535).astype(np.uint16)
            if r["c"] == b"many":
                back.append((r["bucket"], r["chunk"], False, r["a"], r["b"], b"many" + times.tobytes()))
            elif (some := times > 1).any():
                own = np.frombuffer(r["b"], r["c"].decode())[some]
                back.append((r["bucket"], r["chunk"], False, planes(keys[some]), own.tobytes(), r["c"] + times[some].tobytes()))
    return _rows(back)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Grams of n that a partner must share."""
    return -(-percent * n // 100)


def _survivors(table: pa.Table, percent: int) -> pa.Table:
    rows = table.to_pylist()
    info = [r for r in rows if r["info"]][0]
    sid, n = from_planes(info["a"]).view(np.int64), np.frombuffer(info["b"], np.uint32).astype(np.int64)
    got = sorted((r for r in rows if not r["info"]), key=lambda r: r["bucket"])  # rising n-grams
    out = []
    if got:
        kind = info["c"][:3].decode()
        keys, own, times, kept = [], [], [], 0
        several = np.frombuffer(info["c"][3:], kind)  # sets of the n-grams that went once for several
        for r in got:
            g = from_planes(r["a"])
            if r["c"].startswith(b"many"):
                here = np.frombuffer(r["b"], np.uint32).astype(np.int64)
                keys.append(np.repeat(g, here))
                times.append(np.repeat(np.frombuffer(r["c"][4:], np.uint16), here))
                own.append(several[kept : kept + int(here.sum())])
                kept += int(here.sum())
            else:
                keys.append(g)
                times.append(np.frombuffer(r["c"][3:], np.uint16))
                own.append(np.frombuffer(r["b"], kind))
        keys, own, times = np.concatenate(keys), np.concatenate(own).astype(np.int64), np.concatenate(times)
        shared = np.bincount(own, minlength=len(n))
        fit = shared >= least_overlap(n, percent)
        keep = fit[own]
        keys, own, times = keys[keep], own[keep], times[keep]
        order = np.lexsort((keys, times, own))
        keys, own, times = keys[order], own[order], times[order]
        some = np.unique(own)
        first = np.searchsorted(own, some)
        ends = np.append(first[1:], len(own))[: len(some)]
        out = [(int(sid[d]), int(n[d]), keys[s:e].tobytes(), times[s:e].tobytes()) for d, s, e in zip(some, first, ends, strict=True)]
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["sid", "n", "grams", "times"])


def ordered_classes(docs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    """(sid, n, grams, times) of the classes that may have partners; grams in the global order."""
    buckets = max(1, -(-text_bytes(docs, text_col) // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            held.append(b.column(0))
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield from _send(held, part << 24 | number, buckets, k).to_batches()
                held, size, number = [], 0, number + 1
        if held:
            yield from _send(held, part << 24 | number, buckets, k).to_batches()

    sent = docs.select(text_col).mapInArrow(send, MOVED)
    back = sent.groupBy("bucket").applyInArrow(_count, MOVED)
    found = back.groupBy("chunk").applyInArrow(lambda t: _survivors(t, percent), "sid long, n long, grams binary, times binary")
    return materialise(found.dropDuplicates(["sid"]), "classes")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(g, sid, n, pos, hub): shared n-grams of each class's prefix; pos counts all grams before.

    hub is the mean logarithm of the counts of a class's grams: among near copies, the one with most
    of what the others share has the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            grams = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            have = np.array([len(g) for g in grams], np.int64)
            size = have - least_overlap(n, percent) + 1
            pos = [np.arange(s) + m - h for s, m, h in zip(size, n, have, strict=True)]
            g = np.concatenate([g[:s] for g, s in zip(grams, size, strict=True)]) if len(n) else np.zeros(0, np.int64)
            hub = np.array([np.log(np.frombuffer(t, np.uint16)).sum() for t in b.column(3).to_pylist()]) / n
            cols = [pa.array(g), *(pa.array(np.repeat(c, size)) for c in (b.column(0).to_numpy(), n)), pa.array(np.concatenate(pos) if pos else g), pa.array(np.repeat(hub, size))]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "sid", "n", "pos", "hub"])

    return materialise(classes.select("sid", "n", "grams", "times").mapInArrow(run, "g long, sid long, n long, pos long, hub double"), "prefixes")


def _places(grams: bytes, times: bytes) -> np.ndarray:
    """Places in the global order as whole numbers."""
    return (np.frombuffer(times, np.uint16).astype(np.int64) << 47) | (np.frombuffer(grams, U64) >> U64(17)).astype(np.int64)


def _fragments(classes: DataFrame) -> DataFrame:
    """(sid, fragment, part): each class's grams by range of the global order."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [_places(g, t) for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            x = np.sort(np.concatenate(every)) if every else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:: max(1, len(x) // 200)])], names=["place"])

    shares = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    cuts = classes.select("grams", "times").mapInArrow(spread, "place long").agg(F.percentile_approx("place", shares, 2000).alias("c")).first()["c"]
    cuts = np.array(sorted(set(cuts or [])), np.int64)  # FRAGMENTS - 1 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sid, grams, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g, own = np.frombuffer(grams, U64), np.searchsorted(cuts, _places(grams, times), "right")
                rows += [(sid, int(f), np.sort(g[own == f]).tobytes()) for f in np.unique(own)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["sid", "fragment", "part"])

    return materialise(classes.select("sid", "grams", "times").mapInArrow(run, "sid long, fragment int, part binary"), "fragments")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.zeros(b.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            if len(x) > len(y):
                x, y = y, x
            n[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n)], names=["a", "b", "na", "nb", "n"])


def _linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb) that are similar enough: partial overlaps, summed per pair."""
    left = fragments.select(F.col("sid").alias("a"), "fragment", F.col("part").alias("pa"))
    right = fragments.select(F.col("sid").alias("b"), "fragment", F.col("part").alias("pb"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", "pa", "pb")
    part = met.mapInArrow(_overlaps, "a long, b long, na long, nb long, n long")
    whole = part.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    return whole.where(100 * F.col("n") >= percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _pairs(df: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of (x, y, nx, ny), whose sizes allow a link, each once."""
    fits = df.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return fits.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb")).distinct()


def _relabel(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (sid, comp) with the components that links (a, b) of sids join."""
    a, b = comp.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("sid").alias("b"), F.col("comp").alias("cb"))
    joined = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    to = joined.select(F.col("id").alias("comp"), F.col("comp").alias("to"))  # one row per component
    return materialise(comp.join(to, "comp", "left").select("sid", F.coalesce("to", "comp").alias("comp")), "groups")


def link_classes(classes: DataFrame, percent: int) -> DataFrame:
    """(sid, comp) of the classes: the smallest sid that links reach."""
    prefixes, fragments = _prefixes(classes, percent), _fragments(classes)
    comp = materialise(classes.select("sid", F.col("sid").alias("comp")), "groups")
    for turn in range(LEADER_ROUNDS):
        p = prefixes.join(comp, "sid")
        lead = {"hub": F.struct("hub", "sid", "comp", "n"), "other": F.struct(F.xxhash64("comp", F.lit(turn)), "hub", "sid", "comp", "n")}
        ends = p.groupBy("g").agg(*(F.max(v).alias(k) for k, v in lead.items()), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        ends = ends.select("g", F.array(*(F.struct(f"{k}.sid", f"{k}.comp", f"{k}.n") for k in lead)).alias("ends"))
        met = p.join(ends, "g").select("sid", "n", "comp", F.explode("ends").alias("y")).where("y.comp <> comp")
        fits = met.where(100 * F.least("n", "y.n") >= percent * F.greatest("n", "y.n"))
        best = fits.groupBy("sid", "n", "y").agg(F.count("*").alias("times")).groupBy("sid", "n").agg(F.max(F.struct("times", "y")).alias("m"))
        pairs = _pairs(best.select(F.col("sid").alias("x"), F.col("m.y.sid").alias("y"), F.col("n").alias("nx"), F.col("m.y.n").alias("ny")), percent)
        links = materialise(_linked(pairs, fragments, percent), "pairs")
        if not links.limit(1).count():
            break
        comp = _relabel(comp, links)
    p = prefixes.join(comp, "sid")
    many = p.groupBy("g", "comp").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    p = materialise(p.join(many.where("comps > 1"), "g"), "mixed")
    # Of two different components one at least isn't the n-gram's main one; sizes lie in the same class
    # or in neighbouring ones.
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9) if percent < 100 else F.col("n")
    near_sizes = F.explode(F.sequence(size - 1, size + 1)).alias("size")
    x = p.where("comp <> main").select("g", near_sizes, *(F.col(c).alias(c + "x") for c in ("sid", "n", "pos", "comp")))
    y = p.select("g", size.alias("size"), "main", *(F.col(c).alias(c + "y") for c in ("sid", "n", "pos", "comp")))
    near = (F.col("compx") != F.col("compy")) & ((F.col("compy") == F.col("main")) | (F.col("sidx") < F.col("sidy")))
    near &= 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    near &= (100 + percent) * F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) >= percent * (F.col("nx") + F.col("ny"))
    met = x.join(y, ["g", "size"]).where(near).select(F.col("sidx").alias("x"), F.col("sidy").alias("y"), "nx", "ny")
    links = materialise(_linked(_pairs(met, percent), fragments, percent), "pairs")
    return _relabel(comp, links) if links.limit(1).count() else comp


def similar_groups(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links at 100 * overlap >= percent * union."""
    small_batches(docs.sparkSession)
    sets = sets_of(docs, shingle, id_col, text_col)
    comp = link_classes(ordered_classes(docs, shingle, percent, text_col), percent)
    named = sets.where("sid IS NOT NULL").join(comp, "sid", "left").select("doc_id", "n_shingles", F.coalesce("comp", "sid").alias("comp"))
    named = materialise(named, "members")
    # Written first, so that the join below has a shuffle of its own, of which Spark splits large parts.
    least = materialise(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    empty = sets.where("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(least, "comp").select("doc_id", "n_shingles", "component_id").unionAll(empty)
