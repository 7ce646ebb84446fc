"""Operators 11 to 13 against brute force, the tokenizers and xxhash libraries, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from meshspark.llm import counts, divergence, queries, whitening
from tests.llm.test_operators import SF, docs, empty, lower, odd  # noqa: F401


# ---- token counts


@pytest.fixture(scope="module", params=["BYTE_BPE", "WORD_BPE"])
def vocabulary(request):
    return getattr(queries, request.param)


def library_counts(vocabulary, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary.path())
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


@pytest.mark.parametrize("most", [1, 16, 64, 1 << 21])
def test_op12_matches_the_library(vocabulary, most):
    r = random.Random(most)
    bits = ["a", "the ", ". ", ", ", "\n", "  ", " ", "<|endoftext|>", "<|endof", "text|>", "<|startoftext|>", "x,y", "é", "ß ", "中文", "　", " ", "'s", " 123", "4,5", "\t", "ZED", "\r\n", "!!", "\x00"]
    texts = [None, "", "<|endoftext|>", "<|endoftext|><|endoftext|>", "z" * 5000, " " * 300, "word " * 3000] + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    size, n = counts.Lengths.of(vocabulary).count(pa.array(texts, pa.string()), most)
    assert n.tolist() == library_counts(vocabulary, texts)
    assert size.tolist() == [len((x or "").encode()) for x in texts]


def test_op12_names_across_texts_do_not_count(vocabulary):
    texts = ["<|endof", "text|>x<|endoftext|>", "<|endoftext|", ">"]
    assert counts.Lengths.of(vocabulary).count(pa.array(texts))[1].tolist() == library_counts(vocabulary, texts)


def test_op12_pieces_of_one_hash(vocabulary, monkeypatch):
    few = counts.span_hashes
    monkeypatch.setattr(counts, "span_hashes", lambda *a: few(*a) & np.uint64(3))
    texts = ["one two three four", "five six seven one", "eight nine ten, two"] * 3
    assert counts.Lengths(vocabulary.path(), vocabulary.drop_space).count(pa.array(texts))[1].tolist() == library_counts(vocabulary, texts)


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_op12_whole_tables(table, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    n = library_counts(queries.BYTE_BPE, [t for _, t in rows])
    want = [(d, len((t or "").encode()), k, k > 1024) for (d, t), k in zip(rows, n, strict=True)]
    got = counts.token_counts(df, queries.BYTE_BPE, run_bytes=5000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_op12_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, True), (1, "a b", 5, True)], "doc_id long, text string, n_tokens long, over_limit boolean")
    assert [tuple(r) for r in counts.token_counts(df, queries.BYTE_BPE, limit=1).collect()] == [(1, 3, 2, True)] * 2


# ---- source divergence


def divergence_by_force(rows, min_docs=30, top=50):
    """The contract in whole numbers, term by term."""
    occurrences, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        occurrences[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= min_docs)

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // whole for t in kept}

        all_of = shares(sum((occurrences[lang, s] for s in sources), Counter()))
        p = {s: shares(occurrences[lang, s]) for s in sources}
        for s in sources:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pair, 1)]
            term = sorted(((all_of[t] - p[s][t], t.encode()) for t in kept if occurrences[lang, s][t] and p[s][t] > all_of[t]))[:top]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(term, 1)]
    return sorted(out)


def audited(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("options", [{}, {"run_bytes": 700, "block": 50}])
def test_op13_whole_table(docs, options):  # noqa: F811
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert audited(docs, **options) == divergence_by_force(rows)


@pytest.mark.parametrize("options", [{"run_bytes": 1, "block": 1}, {"run_bytes": 64}])
def test_op13_odd_rows(spark, options):
    rows = [("The cat, the dog. ÄÖ über_x", "en", "a"), ("the the cat É é", "en", "b"), (None, "en", None), (None, None, None), ("", "fr", "x"), ("123 456", "fr", "y"), ("le le", "de", "only"), ("x" * 500 + " the " + "cat " * 400, "en", "a"), ("the cat", "en", "a"), ("the cat", "en", "a"), ("a\x00b Ωmega", "en", "é")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "text string, lang string, source string, term string, n long, value long")
    for least in (1, 2, 99):
        assert audited(df, min_docs=least, top=3, **options) == divergence_by_force(rows, least, 3)


def test_op13_empty_table(empty):  # noqa: F811
    assert audited(empty) == []


def test_op13_digest_is_xxh64():
    r = random.Random(5)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in range(80)] * 2
    buf, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert divergence.xxh64(buf, starts, ends).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]


def test_op13_groups_are_told_apart_by_bytes():
    words = ["a", "b", "ab", "ba", "a" * 70, "a" * 69 + "b", "abcdefgh", "abcdefgi"] * 3
    buf, ends = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w) for w in words])
    group, of = divergence.group_slices(buf, ends - [len(w) for w in words], ends, digest=lambda b, s, e: np.zeros(len(s), np.uint64))
    assert len({(g, w) for g, w in zip(group.tolist(), words, strict=True)}) == len(set(words)) == len(set(group.tolist()))
    assert [words[i] for i in of[group]] == words


def test_op13_shares_of_large_counts():
    n = np.array([0, 7, 10**15, 4 * 10**15], np.int64)
    whole = 4 * 10**15 + 12345
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in n]


# ---- whitening


def whitened_by_force(vectors, k=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    some = e > 1e-12 * e[0]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ u[:, some] / np.sqrt(e[some]), e[some] / (c**2).sum() * n


def check(df, ids, vectors):
    got = df.toPandas()
    n, deviation, white, explained = whitened_by_force(vectors)
    k = white.shape[1]
    assert len(got) == len(ids) * k and (got["n"] == n).all() and got["identity_error"].max() < 1e-9 and got["residual"].max() < 1e-12
    got = got.sort_values(["vec_id", "component"]).to_numpy().reshape(len(ids), k, -1)
    order = np.argsort(ids, kind="stable")
    assert (got[:, :, 3].astype(np.int64) == deviation[order][:, None]).all()
    assert np.allclose(got[:, :, 5].astype(float), explained, rtol=1e-9)
    w, v = got[:, :, 4].astype(float), white[order]
    assert np.allclose(w, v * np.sign((w * v).sum(0)), atol=1e-7)


def test_op11_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(queries.op11_lobpcg_whitening(spark, SF), np.array([r[0] for r in rows]), [r[1] for r in rows])


def test_op11_odd_rows(spark):
    r = np.random.default_rng(1)
    good = (r.standard_normal((200, 7)) * np.arange(1, 8)).tolist()
    good += good[:1] * 300  # a hot vector weighs once
    rows = [(i, v, 1, 0.5) for i, v in enumerate(good)]
    bad = [(900, None, 1, 0.5), (901, [1.0] * 6 + [None], 1, 0.5), (902, [1.0] * 6 + [float("nan")], 1, 0.5), (903, [float("inf")] * 7, 1, 0.5), (904, [1.0, 2.0], 1, 0.5), (905, [], 1, 0.5), (906, [1e30] * 7, 1, 0.5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int, whitened double")
    check(whitening.whiten(df), np.arange(500), good)


def test_op11_nothing_to_whiten(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (None, [0.5, 0.25])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    out = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (None, [1.0, 1.0])], kind)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9)) for r in sorted(out, key=str)] == [(1, 1, 2, 4096, 1.0), (None, 1, 2, 4096, 1.0)]


def test_op11_large_numbers():
    x = np.array([[5_000_000_000, 1], [1, 2]], np.int64)
    sums = np.array([5_000_000_001, 3], object)
    assert whitening.deviations(x, 2, sums).to_pylist() == [None, None]
    assert np.allclose(whitening.centred(x, 1 << 40, sums), x - np.array([5_000_000_001, 3]) / (1 << 40))


@pytest.mark.parametrize(("dim", "ties"), [(40, False), (300, False), (768, False), (100, True), (3, False), (1, False)])
def test_op11_lobpcg_against_dense(dim, ties):
    r = np.random.default_rng(dim)
    x = r.standard_normal((4 * dim, dim)) / np.sqrt(np.arange(1, dim + 1))
    v = np.diag([3.0] * 10 + [1.0] * (dim - 10)) if ties else x.T @ x / len(x)
    e, u, residual, taken = whitening.lobpcg(lambda b: v @ b, dim, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert residual < 1e-10 and taken < 120 and np.allclose(e, want, rtol=1e-10)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12) and np.linalg.norm(v @ u - u * e) < 1e-9 * want[0] * dim
