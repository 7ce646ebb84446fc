"""Token counts of whole texts: how many ids a public tokenizer gives, without the ids.

Arrow brings batches of at most spark.sql.execution.arrow.maxBytesPerBatch bytes.  Within a batch texts
are joined to runs of about RUN_BYTES, however many rows that is, and a longer text is split into parts
of that size at places where the vocabulary splits for certain (`tokens.piece_starts`), so that memory
follows the run and not the text.  Each run's different pieces that the worker hasn't met go through the
library as one batch; only their lengths are kept (`Lengths`), found again by hash and told apart by
their bytes.

The names of special tokens inside texts are handled as the library does by default: it finds them
first, gives one id for each, and goes on with what lies between them as texts of their own.  So a text
is cut around them too.  A name whose token also takes neighbouring blanks, whole words only or
normalised text can't be cut out that way: texts with one go through the library whole.

Null and empty texts have no bytes and no tokens.  Rows are independent: repeated rows and null ids
give a row each, an empty table gives none, and of the table's columns only the id and the text are
read, whatever the others are called.  A run of characters without any certain split stays in one part,
however long it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import IS_BLANK, Vocabulary, piece_starts
from .words import LOWER, U64, slices, span_hashes, text_buffer

RUN_BYTES = 2 << 20


def part_ends(text: np.ndarray, most: int) -> list[int]:
    """Ends of the parts of one text: of at most `most` bytes where a certain split allows it."""
    ends, at = [], 0
    while len(text) - at > most:
        size = most
        while True:
            window = text[at : at + size]
            cuts = piece_starts(window, np.array([0, len(window)]))
            if len(cuts) > 1:
                at += int(cuts[-1])
                break
            if at + size >= len(text):
                at = len(text)
                break
            size *= 2
        ends.append(at)
    if at < len(text):
        ends.append(len(text))
    return ends


class Lengths:
    """Token counts by piece.  One per Python worker and vocabulary; `most` pieces are kept."""

    kept: dict[str, Lengths] = {}

    def __init__(self, path: str, drop_space: bool, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.names = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.cut_names = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.drop_space, self.most = drop_space, most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.n = np.zeros(0, U64), np.zeros(0, np.int32)
        self.at, self.size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Lengths:
        path = vocabulary.path()
        if path not in cls.kept:
            cls.kept[path] = cls(path, vocabulary.drop_space)
        return cls.kept[path]

    def library(self, texts: list[bytes]) -> np.ndarray:
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return np.fromiter(map(len, got), np.int64, len(texts))

    def _spans(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the parts, without the blanks in front of them if the vocabulary drops blanks."""
        starts = piece_starts(buf, off)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        if not self.drop_space or not len(starts):
            return starts, ends
        shown = ~IS_BLANK[buf]
        seen = np.append(0, np.cumsum(shown))
        size = seen[ends] - seen[starts]
        led = seen[ends] - seen[ends - size] == size  # all blanks stand in front
        starts = np.where(led, ends - size, starts)
        return starts[size > 0], ends[size > 0]

    def _unlike(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Spans whose bytes aren't those kept under their hash."""
        n = ends - starts
        odd = self.size[which] != n
        n = np.where(odd, 0, n)
        total = np.cumsum(n)
        step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n)
        wrong = np.flatnonzero(buf[np.repeat(starts, n) + step] != self.text[np.repeat(self.at[which], n) + step])
        odd[np.searchsorted(total, wrong, "right")] = True
        return np.flatnonzero(odd)

    def run(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Counts of the parts of a run; none holds the name of a special token."""
        if self.drop_space:
            buf = LOWER[buf]
        starts, ends = self._spans(buf, off)
        if not len(starts):
            return np.zeros(len(off) - 1, np.int64)
        keys, first, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        new[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] != keys[place < len(self.keys)]
        if new.any():
            raw = [buf[s:e].tobytes() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            size, put = np.fromiter(map(len, raw), np.int64, len(raw)), place[new]
            self.n = np.insert(self.n, put, self.library(raw))
            self.at = np.insert(self.at, put, len(self.text) + np.cumsum(size) - size)
            self.size, self.keys = np.insert(self.size, put, size), np.insert(self.keys, put, keys[new])
            self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), np.uint8)])
            place = np.searchsorted(self.keys, keys)
        which = place[back]
        n = self.n[which].astype(np.int64)
        odd = self._unlike(buf, starts, ends, which)
        if len(odd):
            n[odd] = self.library([buf[starts[i] : ends[i]].tobytes() for i in odd])
        total = np.append(0, np.cumsum(n))
        return np.diff(total[np.searchsorted(starts, off)])

    def _segments(self, buf: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, owners) of parts of texts between names, and what the names add to each text."""
        own = np.zeros(len(off) - 1, np.int64)
        starts, ends, owner = off[:-1].tolist(), off[1:].tolist(), list(range(len(off) - 1))
        found = {} if self.names is None else self._named(buf, off)
        if found or (len(off) > 1 and np.diff(off).max() > most):
            parts = []
            for i, s, e in zip(owner, starts, ends, strict=True):
                spans = found.get(i, [])
                if spans and not self.cut_names:
                    own[i] = self.library([buf[s:e].tobytes()])[0]
                    continue
                own[i] = len(spans)
                for a, b in zip([s, *(y for _, y in spans)], [*(x for x, _ in spans), e], strict=True):
                    last = a
                    for end in part_ends(buf[a:b], most):
                        parts.append((last, a + end, i))
                        last = a + end
            starts, ends, owner = (list(x) for x in zip(*parts, strict=True)) if parts else ([], [], [])
        return np.array(starts, np.int64), np.array(ends, np.int64), np.array(owner, np.int64), own

    def _named(self, buf: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Places of names, by text."""
        found: dict[int, list[tuple[int, int]]] = {}
        raw = memoryview(np.ascontiguousarray(buf))
        some = {int(np.searchsorted(off, m.start(), "right")) - 1 for m in self.names.finditer(raw)}
        some |= {i + 1 for i in some if i + 2 < len(off)}  # a name found across two texts may hide one
        for i in sorted(some):
            spans = [m.span() for m in self.names.finditer(raw[off[i] : off[i + 1]])]
            if spans:
                found[i] = [(int(off[i]) + a, int(off[i]) + b) for a, b in spans]
        return found

    def count(self, texts: pa.Array, most: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of each text."""
        buf, off = text_buffer(texts)
        starts, ends, owner, counts = self._segments(buf, off, most)
        size = np.append(0, np.cumsum(ends - starts))
        for i, j in slices(size, most):
            run = np.concatenate([buf[starts[k] : ends[k]] for k in range(i, j)])
            np.add.at(counts, owner[i:j], self.run(run, size[i : j + 1] - size[i]))
        return np.diff(off), counts


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; one scan, no shuffle."""
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = chosen.schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths.of(vocabulary)
        for b in batches:
            size, n = lengths.count(b.column(1), run_bytes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
