"""Words that polynomial hashes modulo 2 ** 64 can't tell apart, and names of special tokens, in every operator."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meshspark.llm import decontaminate, quality, queries, similarity, windows
from meshspark.llm.words import find_words, text_buffer


def pair(n):
    """A word of the Thue-Morse sequence and its complement."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096])
def test_words_have_hashes_of_their_own(n):
    buf, off = text_buffer(pa.array([" ".join(pair(n))]))
    w = find_words(buf, off)
    assert len(w.hashes) == 2 and w.hashes[0] != w.hashes[1]
    again = find_words(*text_buffer(pa.array(["x " + " ".join(pair(n))])))
    assert (again.hashes[1:] == w.hashes).all()


@pytest.mark.parametrize("vocabulary, name", [(queries.WORD_BPE, "word_bpe_49k.json"), (queries.BYTE_BPE, "byte_bpe_50k.json")])
def test_ids_are_those_of_the_library(vocabulary, name):
    texts = [*pair(1024), *pair(2048), "see <|endoftext|> here", "<|startoftext|>a <|ENDOFTEXT|>", "", "plain. text, so on"]
    got = [x.tolist() for x in vocabulary.encoder().each(pa.array(texts, pa.large_string()))]
    assert got == [Tokenizer.from_file(public_tokenizers.path(name)).encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_of_different_pieces_are_noticed(monkeypatch):
    from meshspark.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    texts = ["one two three", "four", "one two three four"]
    got = [x.tolist() for x in encoder.each(pa.array(texts, pa.large_string()))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_operators_tell_them_apart(spark):
    one, other = pair(1024)
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert sorted(tuple(r) for r in similarity.similar_groups(docs).collect()) == [(1, 1, 1), (2, 1, 2)]
    lines = spark.createDataFrame([(1, f"{one}\n{other}\n{one}")], "doc_id long, text string")
    assert quality.judge(lines, quality.DEFAULT).first()["n_dup_lines"] == 1
    many = spark.createDataFrame([(1, " ".join([one] * 13)), (2, " ".join([other] * 13))], "doc_id long, text string")
    assert [r["n_removed"] for r in windows.substring_dedup(many).collect()] == [0, 0]
    items = spark.createDataFrame([(7, one)], "item_id long, text string")
    assert sorted((r["doc_id"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect()) == [(1, True), (2, False)]
