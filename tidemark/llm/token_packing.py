"""Token ids packed into fixed-length rows by best fit decreasing (operator 2).

A task encodes the documents of its partition and packs them block by block, a
block being a bounded number of tokens. Documents longer than a row are split
without loss into full rows and a rest. Pieces are placed by descending length;
the open row with the least sufficient room is found in a segment tree over
capacities. Nothing is shuffled, and a lost task packs its split again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table

CAPACITY = 2048
#: Tokens that a task holds before it packs them.
BLOCK_TOKENS = 4_000_000
SCHEMA = "doc_ids array<long>, pieces array<int>, n_tokens int, cu_seqlens array<int>, position_resets array<int>, ids binary, positions binary"


class CapacityTree:
    """Counts of open rows by room left, 0..capacity, in a segment tree of subtree sums."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def best(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= need, taken out of the tree."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Row of each piece; pieces are at most ``capacity`` long. Equal lengths go in input order."""
    tree, out, n = CapacityTree(capacity), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.best(need)
        room, row = found or (capacity, n)
        n += found is None
        out[i] = row
        if room > need:
            tree.add(room - need, row)
    return out


def pack_block(docs: list[tuple[int | None, np.ndarray]], capacity: int, pad: int) -> pa.RecordBatch:
    """Packed rows of some (doc_id, ids): full rows of split documents too."""
    pieces = [(d, k, ids[a : a + capacity]) for d, ids in docs for k, a in enumerate(range(0, len(ids), capacity))]
    row_of = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), capacity)
    order = np.argsort(row_of, kind="stable")
    cut = np.flatnonzero(np.diff(row_of[order], prepend=-1))
    cols: list[list] = [[] for _ in range(7)]
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        row = [pieces[i] for i in order[a:b]]
        sizes = [len(p[2]) for p in row]
        ends = np.cumsum(sizes)
        ids, places = np.full(capacity, pad, np.uint16), np.zeros(capacity, np.uint16)
        ids[: ends[-1]] = np.concatenate([p[2] for p in row])
        places[: ends[-1]] = np.concatenate([np.arange(n) for n in sizes])
        starts = [0, *ends[:-1].tolist()]
        for c, v in zip(cols, ([p[0] for p in row], [p[1] for p in row], int(ends[-1]), [0, *ends.tolist()], starts, ids.tobytes(), places.tobytes()), strict=True):
            c.append(v)
    types = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Rows of ``capacity`` token ids (16-bit little-endian, padded with END).

    ``cu_seqlens`` has the cumulative segment lengths, ``position_resets`` where
    positions start again at 0, ``positions`` the position ids, ``pieces`` the
    number of each segment in its document. Every document ends in END, so null
    and empty texts are one token; repeated rows and null ids are packed as they
    come. An empty table gives no rows.
    """
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text if text is not None else F.col("text"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in tk.pieces(batches, "__text", 1 << 20):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("__text").to_pylist(), strict=True):
                held.append((d, np.append(bpe.encode(t, vocabulary), bpe.END).astype(np.uint16)))
                n += len(held[-1][1])
            if n >= BLOCK_TOKENS:
                yield pack_block(held, capacity, bpe.END)
                held, n = [], 0
        if held:
            yield pack_block(held, capacity, bpe.END)

    small_batches(docs.sparkSession)
    return small.mapInArrow(run, SCHEMA)


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of all documents."""
    return pack_tokens(table(spark, sf_dir, "documents"))
