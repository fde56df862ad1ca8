"""Vectorised word helpers for Arrow batches of text.

A *word* is a maximal run of characters other than space and U+0009..U+000D.
All of these are ASCII, so words can be cut on the UTF-8 bytes of a whole
batch at once: no per-word Python objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a batch: byte spans in ``data``, and per document their range."""

    data: np.ndarray  # uint8, the bytes of all texts
    text_at: np.ndarray  # n + 1 byte offsets of texts
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    first: np.ndarray  # n + 1 word offsets of documents
    space: np.ndarray  # bool per byte

    def doc(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, dat = texts.buffers()
    at = np.frombuffer(off, np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> Words:
    """Cut every text of the array into words."""
    data, at = buffers(texts)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64), np.zeros(0, bool))
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text starts or ends here
    cut[at] = True
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1] | cut[1:-1]
    end = word
    end[:-1] &= space[1:] | cut[1:-1]
    s = np.flatnonzero(start)
    return Words(data, at, s, np.flatnonzero(end) + 1, np.searchsorted(s, at), space)


def lower_ascii(w: Words) -> Words:
    """The same words with A-Z in lower case."""
    data = w.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return w._replace(data=data)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are sorted and do not overlap."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):  # bounded temporaries
        b = max(a + 1, int(np.searchsorted(end, start[a] + (1 << 20), "right")))
        s, e = start[a:b], end[a:b]
        lo, hi = s[0], e[-1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * powers(_P, hi - lo), out=sums[1:])
        h = (sums[e - lo] - sums[s - lo]) * powers(_P_INV, hi - lo + 1)[s - lo]
        out[a:b] = mix(h + (e - s).astype(np.uint64))
        a = b
    return out


def word_hashes(w: Words, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return span_hashes(w.data, w.start, w.end, table)


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one document, and the word each starts at."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc *= _P
        acc += h[j : n - k + 1 + j]
    left = np.repeat(first[1:], np.diff(first))[: n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(left >= k)
    return mix(acc[at]), at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words of 0..n-1 that lie in a k-word window starting at one of ``at``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + k, n), -1)
    return np.cumsum(step[:-1]) > 0


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = buffers(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def sums_in(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range first[i]..first[i + 1]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
