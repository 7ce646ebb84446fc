"""Token ids of whole texts with public tokenizers.

Both vocabularies used here split a text at white space and between letters and punctuation before
they look for merges.  So texts are cut into pieces at places where such a split is certain, each
different piece goes through the tokenizers library once, and its ids are kept for later texts of the
same worker.  Pieces are found by hash and told apart by their bytes, for many texts at once.  A text
that holds the name of an added token (`<|endoftext|>`) goes through the library as a whole: the library
finds such names before it splits.

Places that are certain: between an ASCII letter and a full stop or comma; and before a run of spaces
and line feeds, if the character before it surely isn't white space.  What isn't certain stays in one
piece.  `drop_space` is for vocabularies that drop white space and fold case: there pieces are the
runs without spaces and line feeds, with A-Z folded.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .words import LOWER, U64, slices, span_hashes, text_buffer

IS_ASCII_LETTER = np.zeros(256, bool)
IS_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 10]] = True
IS_STOP = np.zeros(256, bool)
IS_STOP[[ord("."), ord(",")]] = True


def _shift(mask: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(mask)
    out[by:] = mask[: max(0, len(mask) - by)]
    return out


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the pieces; those of each text cover it."""
    blank, b = IS_BLANK[buf], buf
    plain = (b > 0x20) & (b < 0x7F)
    two = (b >= 0x80) & _shift((b >= 0xC3) & (b <= 0xDF), 1)
    three = (b >= 0x80) & _shift((b >= 0xE4) & (b <= 0xEF), 2)
    cut = blank & _shift(plain | two | three, 1)
    cut |= IS_STOP[b] & _shift(IS_ASCII_LETTER[b], 1)
    starts = off[:-1]
    cut[starts[np.diff(off) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """encode(...) -> ids.  One per Python worker and vocabulary; `most` pieces are kept."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str, drop_space: bool, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drop_space, self.most = drop_space, most
        self.names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.text_at, self.size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)

    @classmethod
    def of(cls, path: str, drop_space: bool) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path, drop_space)
        return cls.kept[path]

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in raw], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((x for row in got for x in row), np.uint32, int(n.sum()))
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(n) - n)
        self.n = np.insert(self.n, place, n)
        size = np.fromiter(map(len, raw), np.int32, len(raw))
        self.text_at = np.insert(self.text_at, place, len(self.text) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.keys = np.insert(self.keys, place, keys)
        self.flat = np.concatenate([self.flat, flat])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), np.uint8)])

    def _differing(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Pieces whose bytes aren't those kept under their hash."""
        n = ends - starts
        odd = self.size[which] != n
        n = np.where(odd, 0, n)
        total = np.cumsum(n)
        step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n)
        unlike = np.flatnonzero(buf[np.repeat(starts, n) + step] != self.text[np.repeat(self.text_at[which], n) + step])
        odd[np.searchsorted(total, unlike, "right")] = True
        return np.flatnonzero(odd)

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that hold the name of an added token."""
        raw, found = buf.tobytes(), set()
        for name in self.names:
            at = raw.find(name)
            while at >= 0:
                found.add(int(np.searchsorted(off, at, "right")) - 1)
                at = raw.find(name, at + 1)
        return np.array(sorted(found), np.int64)

    def _run(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given, whole = buf, self._whole(buf, off)
        if self.drop_space:
            buf = LOWER[buf]
        starts = piece_starts(buf, off)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        if self.drop_space:  # a piece is blanks with what follows; leave the blanks out
            word = ~IS_BLANK[buf]
            before = np.append(0, np.cumsum(word))
            size = before[ends] - before[starts]
            tail = ends - size
            inner = before[ends] - before[tail] == size  # the blanks all stand in front
            starts = np.where(inner, tail, starts)
            some = size > 0
            starts, ends = starts[some], ends[some]
        hashes = span_hashes(buf, starts, ends)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            self._learn(keys[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        which = at[back]
        n = self.n[which].astype(np.int64)
        total = np.append(0, np.cumsum(n))
        ids = self.flat[np.repeat(self.at[which] - total[:-1], n) + np.arange(total[-1])]
        first = total[np.searchsorted(starts, off)]
        again = np.union1d(whole, np.searchsorted(off, starts[self._differing(buf, starts, ends, which)], "right") - 1)
        return self._again(given, off, ids, first, again.astype(np.int64)) if len(again) else (ids, first)

    def _again(self, buf: np.ndarray, off: np.ndarray, ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with those of some texts taken anew, from the texts as a whole."""
        each = [ids[first[d] : first[d + 1]] for d in range(len(off) - 1)]
        got = self.tokenizer.encode_batch_fast([buf[off[d] : off[d + 1]].tobytes().decode() for d in which], add_special_tokens=False)
        for d, e in zip(which, got, strict=True):
            each[d] = np.array(e.ids, np.uint32)
        return np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs (i, j) of texts: their ids, and where those of each text begin (and end)."""
        buf, off = text_buffer(texts)
        for i, j in slices(off, 1 << 21):
            ids, first = self._run(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield i, j, ids, first

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text."""
        for i, j, ids, first in self.encode(texts):
            for k in range(j - i):
                yield ids[first[k] : first[k + 1]]


class Vocabulary:
    """A vocabulary file by name, looked up where it is used."""

    def __init__(self, path: Callable[[], str], drop_space: bool, id_bytes: int):
        self.path, self.drop_space, self.id_bytes = path, drop_space, id_bytes

    def encoder(self) -> Encoder:
        return Encoder.of(self.path(), self.drop_space)


def public(name: str, drop_space: bool) -> Vocabulary:
    """One of the public vocabularies installed with this Python; their ids fit two bytes."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return Vocabulary(path, drop_space, 2)
