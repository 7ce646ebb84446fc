"""The pipeline's stages and its whole run against brute force, on odd rows and on a whole small table."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from meshspark.llm import langid, packing

from .test_operators import ODD, SF, groups_by_force, hits_by_force, removed_by_force, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]


def copies_by_force(rows):
    """One row per component: the smallest id, then any of equal rows."""
    rows = sorted(set(rows), key=str)
    label = groups_by_force([(k, t) for k, (_, t) in enumerate(rows)])
    best = {}
    for k, _, c in label:
        best[c] = min(best.get(c, (float("inf"),)), (rows[k][0], str(rows[k][1])))
    return sorted(best.values(), key=str)


def passages_by_force(rows):
    return {i: (n - gone, digest) for i, n, gone, digest in removed_by_force(rows) if gone < n}


def test_near_copies_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in ODD if i is not None] + [(3, "another text of the same number as one before")]
    got = texts(P.near_copies(spark, frame(spark, rows), SF))
    assert sorted(((i, str(t)) for i, t in got), key=str) == copies_by_force(rows)


def test_benchmark_drops_only_the_row_with_a_passage(spark, items):
    passage = max((t for _, t in items if t), key=len)
    rows = [(1, "clean text"), (1, f"x {passage} y"), (2, None), (3, "")]
    assert sorted(texts(P.benchmark(spark, frame(spark, rows), SF)), key=str) == [(1, "clean text"), (2, None), (3, "")]


def test_language_gives_ids_and_drops_the_undetermined(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    odd = spark.createDataFrame([(None, docs.first()["text"], None, "s", 1), (-5, None, "en", "s", 1), (-6, "1 2 3", "en", "s", 1)], SCHEMA)
    kept = texts(P.language(spark, docs.unionAll(odd), SF))
    assert not {-5, -6} & {i for i, _ in kept}
    assert all(i is not None for i, _ in kept) and sum(i >= 1 << 62 for i, _ in kept) <= 1
    want = langid.identify(docs.unionAll(odd)).where("lang_pred <> 'und' AND NOT ambiguous").count()
    assert len(kept) == want


def test_stages_of_an_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_matches_brute_force(spark, items):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = copies_by_force([(i, t) for i, t in texts(P.language(spark, docs, SF))])
    rows = [(i, t) for i, t in left]
    cut = passages_by_force(rows)
    stage = {r["doc_id"]: r["text"] for r in P.passages(spark, frame(spark, rows), SF).collect()}
    assert {i: len(words(t)) for i, t in stage.items()} == {i: n for i, (n, _) in cut.items()}
    clean = [r[0] for r in hits_by_force(list(stage.items()), items) if not r[5]]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i in clean:
        ids = np.array([*tokenizer.encode(stage[i], add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    got = P.run(spark, SF).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(want)
