"""Language of whole texts by error-correcting output codes.

Each learned language has a codeword of +1 and -1.  For every bit a binary classifier over hashed
byte trigrams tells the languages with +1 from those with -1: its weights are the log odds of each
trigram under the two sides, each language counting alike however many texts it has.  A text's
margin for a bit is its mean weight.  Decoding is loss-weighted: each bit's exponential loss against
a language's codeword is weighted by how often that classifier was right on that language's
training texts; the language of least total loss is predicted, `score` is its share of
exp(-loss), and a text whose two best losses lie close together is flagged as ambiguous.

Trigram counts come from all training rows, added up by Spark, and so do the two sides of each bit; the
driver gets a total per language and a weight per bit and bin.  Bit weights are measured on a bounded sample of
training rows (`sample`, 4000 by default, about; drawn by a hash of the id).

A null text, or one without any letter, is `und` with score 0.  Rows with a null id count as
training rows and not as held out.  With nothing to learn from every text is `und`.

An empty table gives no rows.  `identify` reads doc_id, text and lang alone.  A text of any length counts whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, small_batches
from .words import per_doc, slices, text_buffer

BITS, UNDETERMINED = 15, "und"
BINS = 1 << BITS
TEMPERATURE, AMBIGUOUS = 3.0, 0.1


def _letters() -> np.ndarray:
    """Byte -> lower-case letter, part of a non-ASCII letter, or a space."""
    out = np.full(256, 32, np.uint8)
    out[0x80:] = np.arange(0x80, 256)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return out


LETTERS = _letters()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs (i, j) of texts: bin of each byte position (BINS: none), which count, offsets."""
    padded = pc.binary_join_element_wise(pa.scalar("", texts.type), pc.fill_null(texts, ""), pa.scalar("", texts.type), pa.scalar(" ", texts.type))
    buf, off = text_buffer(padded)
    for i, j in slices(off, 1 << 21):
        b, o = LETTERS[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        accent = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)  # capital letters with accents
        b[1:][accent] += 0x20
        x = b.astype(np.uint32)
        at = np.full(len(b), BINS, np.int32)
        ok = np.ones(len(b), bool)
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        at[:-2] = h >> np.uint32(32 - BITS)
        ends = o[1:]
        ok[ends - 1] = ok[ends - 2] = False
        blank = (b[:-2] == 32) & (b[1:-1] == 32)
        ok[:-2] &= ~(blank | ((b[1:-1] == 32) & (b[2:] == 32)))
        at[~ok] = BINS
        yield i, j, at, ok, o


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code up to 6 languages, else random columns that split them."""
    if k <= 6:
        n = max(1, 2 ** (k - 1) - 1)
        cols = [[1] * 1 + [1 if (c >> r) & 1 else -1 for r in range(k - 1)] for c in range(n)]
        return np.array(cols, np.float64).T
    rng, n = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(k)))
    cols = []
    while len(cols) < n:
        c = rng.choice([-1.0, 1.0], k)
        if abs(c.sum()) < k:
            cols.append(c)
    return np.array(cols).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x (BINS + 1); the last bin is empty
    trust: np.ndarray  # languages x bits, rows add up to 1

    def margins(self, at: np.ndarray, ok: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, out = np.maximum(per_doc(ok, off), 1), []
        for w in self.weights:
            sums = np.zeros(len(at) + 1)
            np.cumsum(w[at], out=sums[1:])
            out.append((sums[off[1:]] - sums[off[:-1]]) / n)
        return np.array(out).T

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each text."""
        loss = np.exp(-np.clip(TEMPERATURE * margins[:, None, :] * self.code[None], -20, 20))
        total = (loss * self.trust[None]).sum(2)
        best = total.argmin(1)
        share = np.exp(total.min(1, keepdims=True) - total)
        share /= share.sum(1, keepdims=True)
        ordered = np.sort(total, 1)
        close = np.zeros(len(total), bool) if total.shape[1] < 2 else ordered[:, 1] - ordered[:, 0] < AMBIGUOUS
        return best, share[np.arange(len(best)), best], close


def train(docs: DataFrame, sample: int = 4000) -> Model | None:
    """Learn from docs (doc_id, text, lang) that aren't held out and have a language and a text."""
    known = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for i, j, at, _, off in trigrams(b.column(0)):
                own = np.repeat(np.arange(j - i), np.diff(off))
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                got = np.bincount(code[own] * (BINS + 1) + at, minlength=len(names) * (BINS + 1)).reshape(len(names), -1)
                for name, row in zip(names, got, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            some = np.flatnonzero(row[:BINS])
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some)), pa.array(some.astype(np.int32)), pa.array(row[some].astype(np.int64))], names=["lang", "bin", "n"])

    small_batches(docs.sparkSession)
    counts = materialise(known.select("text", "lang").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    languages = sorted(totals)
    if not languages:
        discard(counts)
        return None
    number = {x: i for i, x in enumerate(languages)}
    code = codewords(len(languages))
    norm = 1 / (np.array([totals[x] for x in languages]) + 0.5 * BINS)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bit and bin: the shares that languages with +1 and with -1 have, added up."""
        sums = np.zeros((2, code.shape[1], BINS))
        for b in batches:
            own = np.array([number[x] for x in b.column(0).to_pylist()], int)
            bins, w = b.column(1).to_numpy(), b.column(2).to_numpy() * norm[own]
            for side, sign in enumerate((1, -1)):
                for bit in range(code.shape[1]):
                    sums[side, bit] += np.bincount(bins, w * (code[own, bit] == sign), BINS)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = np.zeros((2, code.shape[1], BINS))
    for r in counts.coalesce(4).mapInArrow(shares, "sums binary").toLocalIterator():  # four rows of bits x BINS
        sums += np.frombuffer(r["sums"]).reshape(sums.shape)
    discard(counts)
    sides = np.array([code == s for s in (1, -1)])
    n = sides.sum(1)[:, :, None]
    smooth = np.stack([(0.5 * norm[:, None] * s).sum(0) for s in sides])[:, :, None]
    plus, minus = np.where(n > 0, (sums + smooth) / np.maximum(n, 1), 1 / BINS)
    weights = np.concatenate([np.log(plus / minus), np.zeros((code.shape[1], 1))], 1)
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))

    every = max(1, known.select("doc_id", "lang").count() // sample)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text", "lang")

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, n = np.zeros(code.shape), np.zeros(len(languages))
        for b in batches:
            own = np.array([number[x] for x in b.column(1).to_pylist()], int)
            for i, j, at, ok, off in trigrams(b.column(0)):
                good = model.margins(at, ok, off) * code[own[i:j]] > 0
                np.add.at(hit, own[i:j], good)
                np.add.at(n, own[i:j], 1)
        yield pa.RecordBatch.from_arrays([pa.array([hit.tobytes()]), pa.array([n.tobytes()])], names=["hit", "n"])

    hit, n = np.zeros(code.shape), np.zeros(len(languages))
    for r in some.mapInArrow(right, "hit binary, n binary").toLocalIterator():
        hit += np.frombuffer(r["hit"]).reshape(code.shape)
        n += np.frombuffer(r["n"])
    trust = (hit + 1) / (n[:, None] + 2)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred string, score double, ambiguous boolean; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = docs.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index("text"))
            lang, score, close = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if model is not None and len(texts):
                some = has_letters(texts)
                for i, j, at, ok, off in trigrams(texts):
                    best, share, near = model.decode(model.margins(at, ok, off))
                    lang[i:j] = np.where(some[i:j], np.array(model.languages, object)[best], UNDETERMINED)
                    score[i:j], close[i:j] = np.where(some[i:j], share, 0), near | ~some[i:j]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(close)], names=[*names, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(label, f"{fields}, lang_pred string, score double, ambiguous boolean")


def has_letters(texts: pa.Array) -> np.ndarray:
    """Which texts have a Unicode letter."""
    buf, off = text_buffer(texts)
    ascii_letter = ((buf | 0x20) >= ord("a")) & ((buf | 0x20) <= ord("z")) & (buf < 0x80)
    out = per_doc(ascii_letter, off) > 0
    for i in np.flatnonzero(~out & (per_doc(buf >= 0x80, off) > 0)):
        out[i] = any(map(str.isalpha, texts[i].as_py()))
    return out


def identify(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    model = train(docs, sample)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slim, model).drop("text")
