"""Words of many texts at once: numpy over the bytes of an Arrow column, no Python object per word.

Words, lines and pieces of text are hashed by a chain over their 8-byte blocks with a full bit mixer after
each (`span_hashes`); spans of more than DIGEST bytes by a cryptographic digest.  Windows of a few words
are polynomials over word hashes.  Windows of bytes (`byte_window_hashes`) are polynomials over bytes
modulo 2**64, for which some regular strings agree by construction: they serve as filters only, where equal
strings must meet and unequal ones may.  Texts never run into each other: a word or window belongs to
one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _values(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n2 = max(n, 2 * len(self.up))
            self.up, self.down = (self._row(b, n2) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base, U64)
        row[0] = 1
        return np.multiply.accumulate(row)


BYTE_POWERS, WORD_POWERS = _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)
BYTE_VALUES = _values(256, 17)
DIGEST = 1024


def byte_class(negated: bytes) -> np.ndarray:
    """Mask over the 256 byte values: all but those given."""
    out = np.ones(256, bool)
    out[list(negated)] = False
    return out


#: `[^\x20\x09-\x0D]+`
NON_SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, applied after A-Z became a-z
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to `most` bytes together; a longer text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def prefix_sums(values: np.ndarray, powers: _Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def byte_window_hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    down = BYTE_POWERS(len(sums))[1]
    return mix((sums[starts + length] - sums[starts]) * down[starts])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span buf[starts[i]:ends[i]]; equal bytes have equal hashes wherever they stand."""
    n = ends - starts
    h = mix(n.astype(U64) + U64(0x9E3779B97F4A7C15))
    if not len(buf):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    at = np.flatnonzero((n > 0) & (n <= DIGEST))
    k = 0
    while len(at):
        left = np.minimum(n[at] - k, 8).astype(U64)
        block = words[starts[at] + k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - left * U64(8)))
        h[at] = mix((h[at] ^ block) + U64(0xD1342543DE82EF95))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > DIGEST).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n + 1

    def hashes_of(self, k: int) -> np.ndarray:
        """Hash of the window of k words at each word; the greatest value where there is none."""
        out = np.full(len(self.hashes), np.iinfo(U64).max, U64)
        at, h = self.windows(k)
        out[at] = h
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words of one text."""
        n = len(self.hashes)
        sums = prefix_sums(self.hashes, WORD_POWERS)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, mix((sums[at + k] - sums[at]) * WORD_POWERS(n)[1][at] + U64(k))


def find_words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = NON_SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """Words of the texts whose bytes are buf[off[i]:off[i + 1]]; off starts at 0."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return Words(e, e, np.zeros(0, U64), np.zeros(len(off), np.int64))
    buf = LOWER[buf] if lower else buf
    inside = kind[buf]
    filled = np.diff(off) > 0
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][filled]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, span_hashes(buf, starts, ends) if hashed else np.zeros(0, U64), np.searchsorted(starts, off).astype(np.int64))


def cover(at: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of n places: those in [a, a + length) for some a."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many places of each text are set."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
