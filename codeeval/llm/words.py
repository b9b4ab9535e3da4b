"""Words of Arrow string columns as numpy arrays.

A text is handled as its UTF-8 bytes.  Every word class used here is a set of
ASCII bytes or its complement, and the bytes of a multi-byte character are all
0x80 or above, so cutting bytes gives the same words as cutting characters.
Nothing loops over words or characters in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
#: Bytes of text worked on at once; a longer text is taken alone.
CHUNK_BYTES = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 128


def _space_words() -> np.ndarray:
    """``[^\\x20\\x09-\\x0D]``"""
    t = np.ones(256, bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def _alnum_words() -> np.ndarray:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``"""
    t = np.ones(256, bool)
    for a, b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        t[a:b + 1] = False
    return t


SPACE_WORDS = _space_words()
ALNUM_WORDS = _alnum_words()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place."""
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two hashes."""
    return mix(a * _M3 + (b ^ _M1))


@dataclass
class Words:
    """The words of consecutive texts.

    ``first[d]:first[d + 1]`` are text d's words; word w is
    ``buf[start[w]:end[w]]``.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes at a time."""
        n = self.end - self.start
        h = mix(n.astype(U64) + U64((seed * 0x632BE59BD9B4E019 + 0x1234567) & (2**64 - 1)))
        if not len(n):
            return h
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[:len(self.buf)] = self.buf
        lanes = np.ndarray((len(self.buf),), "<u8", padded, strides=(1,))
        some, at, left = slice(None), self.start, n
        for _ in range(LONG_WORD // 8):
            lane = lanes[at]
            short = left < 8
            lane[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
            h[some] = combine(h[some], lane)
            more = left > 8
            if not more.any():
                return h
            some = np.flatnonzero(more) if isinstance(some, slice) else some[more]
            at, left = at[more] + 8, left[more] - 8
        for w in some:  # what is left are words over LONG_WORD bytes
            d = hashlib.blake2b(self.buf[self.start[w]:self.end[w]].tobytes(), digest_size=8,
                                salt=int(seed).to_bytes(8, "little")).digest()
            h[w] = U64(int.from_bytes(d, "little"))
        return h

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that start a window of k words within their
        text, and the text of each."""
        doc = self.doc_of()
        ok = np.flatnonzero(np.arange(len(doc)) + k <= self.first[1:][doc])
        return ok, doc[ok]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling; one per start, the
    last k - 1 starts left out."""
    if len(h) < k:
        return np.empty(0, U64)
    power, width, out, taken = h, 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, taken = power, width
            else:
                n = min(len(out), len(power) - taken)
                out, taken = combine(out[:n], power[taken:taken + n]), taken + width
        width *= 2
        if width > k:
            return out[:len(h) - k + 1]
        power = combine(power[:-(width // 2)], power[width // 2:])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and the offsets of each text
    (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, bytes, offsets."""
    buf, offs = text_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        yield row, buf[offs[row]:offs[to]], offs[row:to + 1] - offs[row]
        row = to


def split_words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``buf[offs[d]:offs[d + 1]]``: longest runs of bytes in ``table``."""
    if lower:
        buf = LOWER[buf]
    if not len(buf):
        return Words(buf, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64))
    inside = table[buf]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1] = False
    ends = offs[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, offs).astype(np.int64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row d holds ``values[first[d]:first[d + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
