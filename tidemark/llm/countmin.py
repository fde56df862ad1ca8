"""Count-min sketches built per partition, merged by a shuffle and broadcast at a bounded size.

A sketch has DEPTH rows (one where only an order is wanted) of ``width`` cells (a multiple of BLOCK). Partial sketches
travel as compressed blocks of cells; blocks of one range are added up in one
task, so no task or driver ever adds up a whole corpus of keys. What reaches the
driver is one byte (or one bit) per cell: at most DEPTH * MAX_WIDTH of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import textkit as tk

DEPTH = 2
#: Cells per block that is merged as one.
BLOCK = 1 << 18
_SALT = np.array([0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93], dtype=np.uint64)


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each key in one row of the sketch."""
    return (tk.mix(keys ^ _SALT[row]) % np.uint64(width)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an unsigned array, split in byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def _parts(row: int, keys: list[np.ndarray], width: int, most: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sparse blocks (block, entries, gaps, counts) of one row for some keys; counts stop at ``most``."""
    at = np.sort(np.concatenate([cells(k, row, width) for k in keys]))
    new = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(new, append=len(at))
    at = at[new]
    block = at // BLOCK
    cut = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        gaps = np.diff(at[a:b] % BLOCK, prepend=0).astype(np.uint32)
        yield row * (width // BLOCK) + int(block[a]), int(b - a), pack(gaps), pack(np.minimum(count[a:b], most).astype(np.uint16))


def gathered(df: DataFrame, column: str, keys_of: Callable[[pa.RecordBatch], np.ndarray], width: int, finish: Callable[[np.ndarray], np.ndarray], buffer: int = 3_000_000, depth: int = DEPTH) -> np.ndarray:
    """Merged sketch of the keys that ``keys_of`` finds in the rows of ``df``, at the driver.

    ``finish`` turns the saturating counts of a block into bytes, e.g. one bit
    or one code per cell. Rows of the result are rows of the sketch. An empty
    table gives zeros.
    """
    size = len(finish(np.zeros(BLOCK, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            rows = [p for r in range(depth) for p in _parts(r, held, width, 65535)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "n", "gaps", "counts"])

        for b in tk.pieces(batches, column):
            held.append(keys_of(b))
            n += len(held[-1])
            if n >= buffer:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack(finish(total))], pa.binary())], names=["block", "cells"])

        for b in batches:
            for block, n, gaps, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now = block
                    total[:] = 0
                total[np.cumsum(unpack(gaps, n, np.uint32))] += unpack(counts, n, np.uint16)
        if now is not None:
            yield done()

    parts = df.mapInArrow(run, "block int, n int, gaps binary, counts binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, cells binary")
    per_row = width // BLOCK
    out = np.zeros((depth * per_row, size), np.uint8)
    for row in blocks.collect():  # at most one entry per block of a sketch of fixed size
        out[row["block"]] = unpack(row["cells"], size, np.uint8)
    return out.reshape(depth, per_row * size)


def as_codes(count: np.ndarray) -> np.ndarray:
    """One byte per cell: 0, or 1 + floor(4 log2(count))."""
    return np.where(count > 0, 1 + np.floor(4 * np.log2(np.maximum(count, 1))), 0).clip(0, 255).astype(np.uint8)


def as_repeated(count: np.ndarray) -> np.ndarray:
    """One bit per cell: whether its count is 2 or more."""
    return np.packbits(count >= 2, bitorder="little")


def code_of(codes: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """The least of the codes of each key, one in each row of the sketch."""
    out = codes[0][cells(keys, 0, width)]
    for r in range(1, len(codes)):
        out = np.minimum(out, codes[r][cells(keys, r, width)])
    return out


def is_repeated(bits: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Whether all DEPTH counters of each key are 2 or more."""
    ok = np.ones(len(keys), dtype=bool)
    for r in range(DEPTH):
        c = cells(keys, r, width)
        ok &= (bits[r][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return ok


def width_for(n_keys: int, most: int) -> int:
    """One and a half cells a row for each of ``n_keys``, in whole blocks up to ``most``: below that the load is alike at every size."""
    return min(most, -(-(3 * n_keys // 2 + 1) // BLOCK) * BLOCK)
