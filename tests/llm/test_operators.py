"""Operators against brute force, round trips and properties, on whole small tables and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.llm import blocks, components, decontaminate, langid, packing, queries, quality, records, sharding, similarity, suffixes, warc, windows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, bucket string, chunk string"
PASSAGE = " ".join(f"word{i}" for i in range(40))
ODD = [
    (1, PASSAGE, "en"), (2, PASSAGE, "en"), (3, PASSAGE.upper(), None), (4, None, None), (5, "", "en"), (6, "   \n\t ", "fr"), (7, "one two three", "fr"), (8, "ONE two  three", "fr"),
    (9, "x " + PASSAGE + " y", "de"), (None, PASSAGE, "de"), (None, None, None), (10, "über straße naïve " * 30, "de"), (10, "über straße naïve " * 30, "de"), (11, "z" * 30000, "en"), (12, "1234 5678", None), (13, ("a b " * 4000).strip(), "en"), (14, "tail " + PASSAGE[:60] + " other end of it", "es"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", None, 1, "b", "c") for i, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups_by_force(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_op4_matches_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = sorted(map(tuple, similarity.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == groups_by_force(texts(df))


def test_op4_links_across_chains(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(base[k : k + 40])) for k in range(0, 12)] + [(100, " ".join(base[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, similarity.similar_groups(df).collect()), key=str)
    assert got == groups_by_force(rows)


def test_op4_empty_table(empty):
    assert similarity.similar_groups(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}


def removed_by_force(rows, k=13):
    first = {}
    for d, t in rows:
        w = words(t)
        d = float("inf") if d is None else d
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (float("inf") if d is None else d):
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_op8_matches_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = windows.substring_dedup(df.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed_by_force(texts(df))


def test_op8_doubles_until_nothing_survives(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(["a", *base[:120], "b"])), (3, " ".join(["c", *base[200:230]])), (4, " ".join(base[:12])), (5, " ".join(f"x{i}" for i in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["longest"] for r in windows.longest_repeats(df).collect()} == {1: 104, 2: 104, 3: 26}
    assert {r["doc_id"]: r["n_removed"] for r in windows.substring_dedup(df).collect()} == {1: 0, 2: 120, 3: 30, 4: 0, 5: 0}
    assert windows.lengths(13) == [4, 8] and windows.lengths(13, 2) == [2, 4, 8] and windows.lengths(13, 13) == []


def test_op8_keeps_text_and_other_columns(odd, empty):
    odd = odd.withColumn("_chunk", F.lit(1)).withColumn("_0", F.lit("x")).withColumn("k", F.lit(2.5))
    out = windows.substring_dedup(odd, with_text=True)
    assert sorted(out.columns) == sorted({*odd.columns, "n_removed", "kept_sha256"})
    for r in out.collect():
        assert (r["_chunk"], r["_0"], r["k"], r["bucket"]) == (1, "x", 2.5, "b")
        if r["n_removed"] == 0:
            assert (r["doc_id"], r["text"]) in [(i, t) for i, t, _ in ODD]
        else:
            assert len(words(r["text"])) == r["n_words"] - r["n_removed"]
    assert windows.substring_dedup(empty.select("doc_id", "text")).count() == 0


def hits_by_force(rows, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    patterns = {}
    for item, t in items:
        w = split(t)
        m = min(k, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for d, t in rows:
        w, found = split(t), set()
        hit = [False] * len(w)
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[i : i + m])):
                    found |= own
                    hit[i : i + m] = [True] * m
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), sum(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["odd", "docs"])
@pytest.mark.parametrize("block", [8 << 20, 300])
def test_op9_matches_brute_force(spark, table, block, request):
    df = request.getfixturevalue(table)
    if table == "odd":
        items = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (None, "straße naïve"), (5, "one two"), (6, "one Two three")], "item_id long, text string")
    else:
        items = spark.read.parquet(f"{SF}/benchmark.parquet")
        block = max(block, 1500)
    want = hits_by_force(texts(df), [tuple(r) for r in items.select("item_id", "text").collect()])
    got = decontaminate.contamination(df, items, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_op9_without_items(odd, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(odd, none).where("contaminated").count()
    assert decontaminate.contamination(empty, none).count() == 0


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        out[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return out


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_op1_round_trip(spark, table, request, tokenizers):
    df = request.getfixturevalue(table)
    got = records.token_records(df, queries.WORD_BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want = []
    for d, t in texts(df):
        ids = [*tokenizers["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_op1_empty_and_damaged(empty):
    assert records.token_records(empty, queries.WORD_BPE).count() == 0
    data = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(data)) == (b"payload", len(data))
    data[-6] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_op3_laws(table, request):
    df = request.getfixturevalue(table)
    got = sharding.shard_documents(df).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts(df)), key=str)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(24)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_op3_permutation(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.unpermute(p, n, 7) == np.arange(n)).all()


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_op5_pieces_and_places(table, request, tokenizers):
    df = request.getfixturevalue(table)
    got = packing.pack_documents(df, queries.BYTE_BPE).collect()
    want = []
    for d, t in texts(df):
        ids = np.array([*tokenizers["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    full = collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(full) <= total / 2048 * 1.15 + 2


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_op6_base_counts(spark, table, request):
    df = request.getfixturevalue(table)
    got = quality.quality(df, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    want = []
    for d, t in texts(df):
        w = words(t)
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = [False] * len(w)
        for i in range(len(w) - 7):
            if n[tuple(w[i : i + 8])] > 1:
                rep[i : i + 8] = [True] * 8
        failed = len(w) < 20 or 100 * sum(rep) > 30 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(rep), failed))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op6_separates_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).where("NOT base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) > 0.8 * len(rows)


def test_op6_viterbi_is_the_best_sequence():
    import itertools

    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    first = np.array([0, 4, 4, 5, 11])
    x = rng.normal(size=(11, 3))
    got = field.label(x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        s = x[a:b] @ field.weights
        score = lambda y: sum(s[i] * y[i] for i in range(len(y))) + sum(field.pairs[p, q] for p, q in zip(y, y[1:], strict=False))
        best = max(itertools.product((0, 1), repeat=int(b - a)), key=score)
        assert list(best) == got[a:b].tolist()


def test_op7_archives(spark):
    body = "<html>" + "x" * 200
    rows = [(3, "u3", body), (1, "u1", body), (2, "u2", "tiny"), (4, "u4", "tiny"), (5, None, None), (6, "u6", body), (None, "u", "y" * 150), (7, "u7", "y" * 150), (8, "\r\nodd url", "ü" * 60), (9, "u9", "ü" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.deduplicated(pages).collect()}
    kinds = {1: None, 3: 1, 6: 1, 2: None, 4: None, 5: None, 7: None, None: 7, 8: None, 9: 8}
    assert {k: v[1] for k, v in got.items()} == kinds
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i][2:] == (len(data), hashlib.sha256(data).hexdigest())
        assert got[i][0] == ("response" if kinds[i] is None else "revisit")
    assert warc.deduplicated(pages.limit(0)).count() == 0


def test_op10_accuracy_and_undetermined(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)
    got = collections.defaultdict(set)
    for r in langid.identify(odd).collect():
        got[r["doc_id"]].add((r["lang_pred"] == "und", r["score"] == 0))
        assert 0 <= r["score"] <= 1
    assert all((True, True) in got[d] for d in (4, 5, 6, 12)) and (False, False) in got[10]
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op10_many_languages_and_clashing_columns(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 4} {'uvwxyz'[i // 100 % 6] * 3} " * 6, f"l{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("x"), "score": F.lit("y")})
    got = langid.predict(docs, langid.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    assert got.where("lang_pred = 'und'").count() == 0


def repeats_by_force(rows, k):
    n = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        n.update(b[i : i + k] for i in range(len(b) - k + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - k + 1):
            if n[b[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_op2_matches_brute_force(spark, table, request):
    df = request.getfixturevalue(table)
    if table == "odd":
        rows = [(20, "ab" * 150), (21, "q" * 201), (22, "start " + "q" * 260), (23, PASSAGE[:205] + "!"), (24, "?" + PASSAGE[3:206])]
        df = df.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=str) == repeats_by_force(texts(df), 200)


def test_op2_small_ranges(spark, monkeypatch):
    """Windows that many ranges of ranks hold: a passage behind and before many different texts."""
    monkeypatch.setattr(suffixes, "RANGE", 16)
    monkeypatch.setattr(suffixes, "SEGMENT", 150)
    monkeypatch.setattr(blocks, "RANGE", 300)
    rng = np.random.default_rng(4)
    some = lambda n: "".join(rng.choice(list("abcd "), n))
    passage, other = some(300), some(230)
    rows = [(i, some(100) + passage + some(150)) for i in range(40)] + [(100 + i, other[i:] + passage[: 40 * i]) for i in range(8)] + [(200 + i, some(50) + "xy" * (120 + i)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=str) == repeats_by_force(rows, 200)


def test_op2_empty_table(empty):
    assert suffixes.remove_repeats(empty).count() == 0


def test_op2_ranks_follow_the_suffixes_in_even_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    strings = [[1] * 700, [1] * 400 + [2] + [1] * 299, rng.integers(1, 3, 600).tolist(), [2, 1] * 200, [1], [1, 1], [2, 1, 1]]
    pack = lambda x: np.array(x, np.int64).tobytes()
    rows = [(k, pack([len(x) for x in part]), pack([c for x in part for c in x])) for k, part in enumerate((strings[:3], strings[3:]))]
    monkeypatch.setattr(blocks, "RANGE", 400)
    monkeypatch.setattr(blocks, "SAMPLE", 200)
    most, real = [], blocks.ranked

    def watched(*a):
        out = real(*a)
        sizes = [np.frombuffer(r["state"], np.int64)[1] for r in out[0].where("state IS NOT NULL").collect()]
        if sum(sizes) > 4 * 400:
            most.append(max(sizes) / sum(sizes))
        return out

    monkeypatch.setattr(blocks, "ranked", watched)
    got = {r["chunk"]: np.frombuffer(r["r"], np.int64) for r in suffixes.suffix_ranks(spark.createDataFrame(rows, "chunk long, n binary, c binary"), 40).collect()}
    ranks = np.concatenate([got[0], got[1]])
    assert sorted(ranks.tolist()) == list(range(1, len(ranks) + 1))
    starts = [(s, i) for s, x in enumerate(strings) for i in range(len(x))]
    ordered = [tuple(strings[s][i : i + 40]) for _, (s, i) in sorted(zip(ranks.tolist(), starts, strict=True))]
    assert ordered == sorted(ordered)
    assert max(most) < 0.6


def test_op2_long_text_of_one_letter(spark):
    rows = [(1, "z" * 30000), (2, "a" + "z" * 250), (3, "no repeat " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=str) == repeats_by_force(rows, 200)


def test_op2_anchors_keep_a_distance_and_follow_the_window():
    rng = np.random.default_rng(8)
    window = bytes(rng.choice(list(b"abcd "), 200).tolist())
    runs = [bytes(rng.choice(list(b"abcd "), n).tolist()) + window + bytes(rng.choice(list(b"abcd "), 20_000).tolist()) for n in (0, 1, 77, 500)]
    off = np.append(0, np.cumsum([len(x) for x in runs]))
    a = suffixes.Anchors(np.frombuffer(b"".join(runs), np.uint8), off, 200)
    starts = off[:-1] + [0, 1, 77, 500]
    first = [a.at[np.searchsorted(a.at, s)] - s for s in starts]
    assert len(set(first)) == 1 and first[0] < 200
    assert np.diff(a.at[a.hit]).min() > 16


def test_op2_sends_blocks_and_sorts_few_times(spark, monkeypatch):
    """Of one chunk and one range: one row, not one an anchor; ranks of anchors in four sorts."""
    rng = np.random.default_rng(9)
    some = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = some(6000)
    rows = [(i, some(40) + passage + some(40)) for i in range(3)]
    sent, sorts, contexts, ranked = [], [], suffixes._contexts, blocks.ranked

    def watched(*a):
        out = contexts(*a)
        sent.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "_contexts", watched)
    monkeypatch.setattr(blocks, "ranked", lambda *a: sorts.append(a[3]) or ranked(*a))
    assert sorted(map(tuple, suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == repeats_by_force(rows, 200)
    assert sent == [1] and len(sorts) <= 4


@pytest.mark.parametrize("length", [17, 60])
def test_op2_shorter_windows(spark, length):
    rng = np.random.default_rng(length)
    some = lambda n: "".join(rng.choice(list("ab "), n))
    passage = some(90)
    rows = [(i, some(5 * i) + passage[i:] + some(30)) for i in range(6)] + [(10, "xyz" * 60), (11, "q" + "xyz" * 30), (12, passage[:length]), (13, passage[: length - 1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.remove_repeats(df, length).collect()), key=str) == repeats_by_force(rows, length)


def test_op5_program_covers_every_length(monkeypatch):
    rng = np.random.default_rng(5)
    histogram = {int(n): int(k) for n, k in enumerate(rng.integers(2000, 9000, 320), 1)}
    left, real = {}, packing.best_fit

    def watched(rest, capacity):
        left.update(rest)
        return real(rest, capacity)

    monkeypatch.setattr(packing, "best_fit", watched)
    plan = packing.solve(histogram, 320)
    held = collections.Counter()
    for c, m in plan:
        assert sum(n * k for n, k in c.items()) <= 320
        held.update({n: k * m for n, k in c.items()})
    assert held == collections.Counter(histogram)
    assert sum(left.values()) < 0.02 * sum(histogram.values())
    assert sum(m for _, m in plan) <= 1.05 * sum(n * k for n, k in histogram.items()) / 320
