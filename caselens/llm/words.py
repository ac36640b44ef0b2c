"""Words of Arrow string columns as 64-bit hashes, computed with numpy over the column's bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return
(`[^\\x20\\x09-\\x0D]+`); A-Z count as a-z when `lower` is set. No Python object is made per word. Two
different words share a hash with a chance of about 2^-64 per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
# Everything in ASCII but letters and digits, for words without punctuation.
MARKS = (_BYTES < 128) & ~(
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

# Multipliers of the 64-bit finaliser (splitmix64) and the golden-ratio increment.
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a batch in reading order.

    hashes: one per word. first: for each row the index of its first word, with one entry more than
    rows. starts, ends: byte positions in `data`.
    """

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's first position (one entry more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    if raw is None or not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = True, between: np.ndarray = _BLANK) -> Words:
    """The words of every row of a string column; `between` marks the bytes that part them."""
    data, offsets = text_bytes(column)
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~here))
    first = np.searchsorted(starts, offsets)
    return Words(hash_spans(padded, starts, ends), first, starts, ends, padded)


def hash_spans(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; `padded` has 8 bytes more than the spans reach."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _GOLD)
    if not len(starts):
        return out
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    todo = np.arange(len(starts))
    at = 0
    while len(todo):
        chunk = eight[starts[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ chunk) + _GOLD)
        at += 8
        todo = todo[size[todo] > at]
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive entries that begin at each position (len - n + 1 of them)."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(2 * k + 1) + hashes[k : len(hashes) - n + 1 + k] + _GOLD)
    return out


def run_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n words of the same row begin, and each one's row."""
    each = np.diff(first)
    row = np.repeat(np.arange(len(each)), each)
    left = np.repeat(first[1:], each) - np.arange(first[-1])
    ok = left >= n
    return np.flatnonzero(ok), row[ok]
