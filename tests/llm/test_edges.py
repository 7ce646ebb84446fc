"""Odd tables for operators 6, 7 and 9: none, clashing names, contradicting labels, long and repeated payloads."""

from __future__ import annotations

import hashlib

from meshspark.llm import decontaminate, quality, warc

WORDS = " ".join(f"w{i} and more of it" for i in range(12))
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_op6_clashing_columns_and_labels(spark):
    rows = [(1, WORDS, True, False, 5), (2, WORDS + "\nnav | menu | home", False, True, 6), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, base_failed boolean, n_words int")
    plain = docs.select("doc_id", "text")
    kind = "doc_id long, quality int, toxic int, text string"
    for labels in ([], [(1, 1, 0, "x")], [(1, 0, 0, "x")], [(1, 1, 0, "x"), (1, 0, 0, "x"), (2, 1, 1, "x"), (None, 1, 0, "x"), (2, None, 0, "x")]):
        given = spark.createDataFrame(labels, kind)
        got = quality.quality(docs, given)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, quality.quality(plain, given).collect()), key=str) and got.count() == 3
        assert quality.quality(docs.limit(0), given).count() == 0
        assert {tuple(r[c] for c in BASE[1:]) for r in got.where("doc_id IS NULL").collect()} == {(0, 0, 0, 0, 0, True)}


def test_op7_clashing_long_and_repeated_rows(spark):
    long = "<p>" + "long page " * 300_000 + "</p>"
    html = "<html>" + "x" * 200
    rows = [(3, "u3", html, "a"), (1, "u1", html, "b"), (1, "u1", html, "b"), (2, "u2", long, None), (5, "u5", long, None), (4, None, None, None), (None, "u", html, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.deduplicated(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    kind = {(3, html): ("revisit", 1), (1, html): ("response", None), (2, long): ("response", None), (5, long): ("revisit", 2), (4, None): ("response", None), (None, html): ("revisit", 1)}
    assert got == sorted(((i, len(t or ""), sha(t), *kind[i, t]) for i, _, t, _ in rows), key=str)
    assert warc.deduplicated(pages.limit(0)).count() == 0


def test_op9_without_documents(spark):
    items = spark.createDataFrame([(1, WORDS), (1, WORDS), (None, WORDS), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(7, WORDS, True)], "doc_id long, text string, contaminated boolean")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    (r,) = decontaminate.contamination(docs, items).collect()
    assert (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (7, 60, 60, 1, True)
