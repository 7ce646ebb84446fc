"""Line quality: a linear-chain conditional random field labels each line of a text content or
boilerplate, Viterbi decoding finds the best label sequence, and the share of words in content lines
decides whether the text is kept (KEEP_SHARE and more).

The field is trained here from texts with a quality label, which says nothing of single lines: line labels
are latent.  Each round finds the labels' distribution under the field, by forward-backward, and moves it
as little as needed until a good text expects CONTENT_GOOD of its words in content lines or more and a
bad one CONTENT_BAD or less (one multiplier per text, found by halving); then gradient steps fit the
field to it.  So a good page may keep its menu as boilerplate.  Training takes a bounded sample: `sample`
texts at most, drawn by a hash of the id, half of them good where there are enough bad ones, and of each
`sample_lines` neighbouring lines at most, from a place that the hash draws.  Without labels, or with one
kind only, DEFAULT weights hold; ids with labels that contradict count as bad, and of rows with one id the least text counts.

A null or empty text has no words, fails the base rules, and isn't kept.  Lines without a word carry
no label.  Rows are judged one by one, so equal rows get equal results.

An empty table gives no rows.  Columns other than doc_id and text are not read, whatever they are called.  A text of any
length is judged whole, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import NON_SPACE, U64, Words, cover, find_words, mix, per_doc, slices, span_hashes, text_buffer

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MOST_REPEATED, KEEP_SHARE = 8, 20, 30, 0.5
CONTENT_GOOD, CONTENT_BAD = 0.7, 0.3
FEATURES = ("bias", "log_words", "upper", "digits", "symbols", "exclaim", "repeats_line", "ends_sentence", "word_length", "repeats_words", "address", "other_punctuation")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL, IS_UPPER, IS_DIGIT = _mask(SYMBOLS), _mask(bytes(range(65, 91))), _mask(b"0123456789")
IS_LETTER = _mask(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
IS_CHAR = ~_mask(bytes(range(0x80, 0xC0)))  # not a continuation byte
ADDRESS, PUNCTUATION, END = _mask(b"@/_="), _mask(b"()[]{};:\"'+-~^\\"), _mask(b".!?:;,\"")


@dataclass
class Lines:
    """Lines with a word of a run of texts, and the counts of the base rules."""

    x: np.ndarray  # lines x features
    words: np.ndarray  # of each line
    first: np.ndarray  # first line of each text, n + 1
    base: dict[str, np.ndarray]


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found more than once, found earlier) for each key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later


def read_lines(buf: np.ndarray, off: np.ndarray) -> Lines:
    w: Words = find_words(buf, off)
    n_docs = len(off) - 1
    own = mix(np.arange(1, n_docs + 1, dtype=U64))
    doc = w.doc()
    at, h = w.windows(WINDOW)
    many, _ = _repeated(h ^ own[doc[at]])
    repeats = cover(at[many], WINDOW, len(w.hashes))

    breaks = np.flatnonzero(buf == 10)
    key = np.searchsorted(breaks, w.starts) + doc
    head = np.flatnonzero(np.diff(key, prepend=-1) != 0)  # first word of each line
    tail = np.append(head[1:], len(key))[: len(head)]
    line_doc = doc[head]
    k = np.searchsorted(breaks, w.starts[head])
    before = np.append(-1, breaks)[k] + 1
    after = np.append(breaks, len(buf))[k]
    start, end = np.maximum(before, off[line_doc]), np.minimum(after, off[line_doc + 1])
    _, later = _repeated(span_hashes(buf, start, end) ^ own[line_doc])

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        s = _sums(mask[buf])
        return (s[end] - s[start]) / np.maximum(of, 1)

    chars, words = _sums(IS_CHAR[buf]), tail - head
    n_chars = chars[end] - chars[start]
    letters, rep = _sums(IS_LETTER[buf]), _sums(repeats)
    last = w.ends[tail - 1] - 1 if len(head) else head
    x = np.stack(
        [
            np.ones(len(head)),
            np.log1p(words),
            share(IS_UPPER, letters[end] - letters[start]),
            share(IS_DIGIT, n_chars),
            share(IS_SYMBOL, n_chars),
            10 * share(_mask(b"!"), n_chars),
            later.astype(float),
            END[buf[last]].astype(float) if len(head) else np.zeros(0),
            n_chars / np.maximum(words, 1) / 10,
            (rep[tail] - rep[head]) / np.maximum(words, 1),
            10 * share(ADDRESS, n_chars),
            10 * share(PUNCTUATION, n_chars),
        ],
        axis=1,
    )
    first = np.searchsorted(line_doc, np.arange(n_docs + 1))
    base = {
        "n_words": w.counts,
        "word_chars": per_doc((NON_SPACE & IS_CHAR)[buf], off),
        "n_symbols": per_doc(IS_SYMBOL[buf], off),
        "n_dup_lines": per_doc(later, first),
        "n_repeat_words": per_doc(repeats, w.first),
    }
    return Lines(x, words, first, base)


@dataclass
class Field:
    """Two labels, 0 content and 1 boilerplate: line weights for boilerplate, and a 2 x 2 of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    def label(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label sequence of each text: all texts step through their lines together."""
        score, labels = x @ self.weights, np.zeros(len(x), np.int8)
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        begin, counts = first[:-1][order], counts[order]
        back = np.zeros((len(x), 2), np.int8)
        best = np.zeros((len(order), 2))
        for t in range(int(counts[0]) if len(counts) else 0):
            n = int(np.searchsorted(-counts, -t, "left"))  # texts with more than t lines
            at = begin[:n] + t
            if t:
                step = best[:n, :, None] + self.pairs
                back[at] = step.argmax(1)
                best[:n] = step.max(1)
            best[:n, 1] += score[at]
            done = np.flatnonzero(counts[:n] == t + 1)
            labels[at[done]] = best[done].argmax(1)
        for t in range((int(counts[0]) if len(counts) else 0) - 1, 0, -1):
            n = int(np.searchsorted(-counts, -t, "left"))
            at = begin[:n] + t
            labels[at - 1] = back[at, labels[at]]
        return labels

    def expected(self, x: np.ndarray, first: np.ndarray, bias: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(probability of boilerplate of each line, expected label pairs), by the forward-backward
        recursions; bias is added to the lines' scores for boilerplate."""
        s = np.stack([np.zeros(len(x)), x @ self.weights + bias], 1)
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        begin, counts = first[:-1][order], counts[order]
        ahead, behind = s.copy(), np.zeros_like(s)
        most = int(counts[0]) if len(counts) else 0
        for t in range(1, most):
            at = begin[: int(np.searchsorted(-counts, -t, "left"))] + t
            ahead[at] += _lse(ahead[at - 1][:, :, None] + self.pairs, 1)
        for t in range(most - 1, 0, -1):
            at = begin[: int(np.searchsorted(-counts, -t, "left"))] + t
            behind[at - 1] = _lse(self.pairs[None] + (s[at] + behind[at])[:, None, :], 2)
        p = ahead + behind
        p = np.exp(p - _lse(p, 1)[:, None])
        inner = np.ones(len(x), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        q = ahead[at - 1][:, :, None] + self.pairs + (s[at] + behind[at])[:, None, :]
        q = np.exp(q - _lse(q.reshape(len(at), 4), 1)[:, None, None])
        return p[:, 1], q.sum(0)

    def completed(self, x: np.ndarray, first: np.ndarray, words: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`expected` under the constraints on each text's expected share of content words."""
        counts = np.diff(first)
        some = counts > 0
        row = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(row, words, len(counts))
        push = words * (counts / np.maximum(total, 1))[row]  # one on average
        sign = np.where(good, -1.0, 1.0)

        def broken(p: np.ndarray) -> np.ndarray:
            share = np.bincount(row, words * (1 - p), len(counts)) / np.maximum(total, 1)
            return some & np.where(good, share < CONTENT_GOOD, share > CONTENT_BAD)

        p, pairs = self.expected(x, first)
        low, high = np.zeros(len(counts)), np.where(broken(p), 40.0, 0.0)
        for _ in range(10 if high.any() else 0):
            middle = (low + high) / 2
            p, _ = self.expected(x, first, (sign * middle)[row] * push)
            more = broken(p)
            low, high = np.where(more, middle, low), np.where(more, high, middle)
        return self.expected(x, first, (sign * high)[row] * push)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


#: Upper case, symbols, exclamation marks and repeated lines speak for boilerplate.
DEFAULT = Field(np.array([-3.0, 0, 4, 3, 8, 1, 1, 0, 0, 2, 1, 0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def fit(x: np.ndarray, first: np.ndarray, words: np.ndarray, good: np.ndarray, rounds: int = 6, steps: int = 30) -> Field:
    """A field for lines x of texts (first) with words each, of which some texts are good."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    field, n = Field(DEFAULT.weights * scale, DEFAULT.pairs.copy()), len(x)
    x = x / scale
    for _ in range(rounds):
        p, pairs = field.completed(x, first, words, good)
        m, v = ([np.zeros(x.shape[1]), np.zeros((2, 2))] for _ in range(2))
        for k in range(1, steps + 1):  # Adam, with a little shrinkage
            now, seen = field.expected(x, first)
            for i, (g, w) in enumerate(((x.T @ (p - now), field.weights), (pairs - seen, field.pairs))):
                g = g / n - 1e-4 * w
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                w += 0.15 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    field.weights /= scale
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_lines: int = 200) -> Field:
    """Fit the field on a bounded sample: about `sample` labelled texts, twice that at most, and of each `sample_lines` lines at most."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy((F.col("quality") > 0).alias("quality")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(False) or not sizes.get(True):
        return DEFAULT
    share = {q: min(1.0, sample / 2 / n) for q, n in sizes.items()}
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.where(dice < F.when(F.col("quality") > 0, share[True]).otherwise(share[False])).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", F.col("quality").cast("long").alias("quality"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("dice"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(0))
            good, dice = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, j in slices(off):
                found = read_lines(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                rows = []
                for d in range(j - i):
                    low, high = found.first[d], found.first[d + 1]
                    low += int(dice[i + d]) % max(high - low - sample_lines + 1, 1)
                    some = slice(low, min(high, low + sample_lines))
                    rows.append(np.column_stack([found.words[some], found.x[some]]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(good[i:j])], names=["x", "quality"])

    got = some.mapInArrow(features, "x binary, quality long").toArrow().to_pydict()  # sample x sample_lines rows of features, twice
    rows = sorted(zip(got["x"], got["quality"], strict=True))
    xs = [np.frombuffer(r, np.float32).reshape(-1, len(FEATURES) + 1).astype(float) for r, _ in rows]
    first = np.append(0, np.cumsum([len(r) for r in xs])).astype(np.int64)
    good = np.array([q > 0 for _, q in rows], bool)
    filled = np.diff(first) > 0
    if not (good & filled).any() or not (~good & filled).any():
        return DEFAULT
    x = np.concatenate(xs)
    return fit(x[:, 1:], first, x[:, 0], good)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """RESULT of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in slices(off, 1 << 21):
                found = read_lines(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                content = np.append(0, np.cumsum(found.words * (field.label(found.x, found.first) == 0)))
                n = found.base["n_words"]
                share = (content[found.first[1:]] - content[found.first[:-1]]) / np.maximum(n, 1)
                failed = (n < MIN_WORDS) | (100 * found.base["n_repeat_words"] > MOST_REPEATED * n)
                cols = [b.column(0)[i:j], *(pa.array(c.astype(np.int64)) for c in found.base.values()), pa.array(failed), pa.array(share), pa.array(~failed & (share >= KEEP_SHARE))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *found.base, "base_failed", "content_share", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_lines: int = 200) -> DataFrame:
    """RESULT of every document, by a field fitted on a bounded sample (see train)."""
    return judge(docs, train(docs, labels, sample, sample_lines))
