"""Removal of word windows that an earlier document already has (operator 10).

1. Count-min prefilter: partitions sketch the hashes of all their windows; the
   merged sketch never underestimates, so a window that occurs twice is always
   estimated at two or more.
2. Exact pass: only windows estimated repeated are grouped, by 96 bits of hash.
   Each task first settles what it can (a smaller document in the same task
   makes a window a repeat) and sends one document per window and task, packed
   in numpy arrays, so a passage in a third of all documents costs one entry a
   task.
3. The repeats of each document are joined to its text, whose covered words go.

The broadcast sketch has DEPTH * MAX_WIDTH bits at most (64 MB), whatever the
corpus. Beyond MAX_WIDTH windows the prefilter passes more windows; the
result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import countmin as cm
from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table

WINDOW = 13
MAX_WIDTH = 1 << 28
#: Windows held before a task settles and sends them, and windows per bucket of the exact pass.
HELD = 1_500_000
PER_BUCKET = 1_000_000
_CHUNK = "bucket int, n int, h1 binary, h2 binary, doc binary, row binary, pos binary"
_TYPES = (np.uint64, np.uint32, np.int64, np.int64, np.uint32)


def _second_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """32 more hash bits of the windows that start at words ``at``."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xD1342543DE82EF95) + (h[at + j] ^ np.uint64(0xA0761D6478BD642F))
    return (tk.mix(acc) >> np.uint64(32)).astype(np.uint32)


def _chunks(bucket: np.ndarray, cols: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """Rows of _CHUNK, one per bucket, each sorted by document so that its columns compress."""
    order = np.lexsort((cols[4], cols[2], bucket))
    bucket, cols = bucket[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.diff(bucket, prepend=np.iinfo(np.int32).min))
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        yield int(bucket[a]), int(b - a), *(cm.pack(c[a:b]) for c in cols)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), *[pa.binary()] * len(_TYPES))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in _CHUNK.split(", ")])


def _settle(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): an order by window and document, and which entries have a smaller document in the same window."""
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    return order, d > least


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(bucket, columns) of sorted rows of _CHUNK, all chunks of a bucket together."""
    def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    now, held = None, []
    for b in batches:
        for bucket, n, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != now and held:
                yield now, joined(held)
                held = []
            now = bucket
            held.append(tuple(cm.unpack(c, n, t) for c, t in zip(cols, _TYPES, strict=True)))
    if held:
        yield now, joined(held)


def repeated_windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, row, n, places): first words of each document's windows that start in a document with a smaller doc_id too.

    ``row`` is xxhash64(text) and tells rows with one doc_id apart. Rows without
    a doc_id neither have repeats nor cause any.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").alias("__text"))
    n_words = (keyed.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // 5
    width = cm.width_for(n_words, MAX_WIDTH)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // PER_BUCKET)

    def keys(b: pa.RecordBatch) -> np.ndarray:
        w = tk.words(b.column("__text"))
        return tk.window_hashes(tk.word_hashes(w), w.first, k)[0]

    bits = spark.sparkContext.broadcast(cm.gathered(keyed.select("__text"), "__text", keys, width, cm.as_repeated))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            order, later = _settle(*cols[:3])
            cols = [c[order] for c in cols]
            to = np.where(later, -1 - (tk.mix(cols[2].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), (cols[0] % np.uint64(buckets)).astype(np.int32)).astype(np.int32)
            cols[0], cols[1] = np.where(later, np.uint64(0), cols[0]), np.where(later, np.uint32(0), cols[1])
            return _batch(list(_chunks(to, tuple(cols))))

        for b in tk.pieces(batches, "__text"):
            w = tk.words(b.column("__text"))
            h = tk.word_hashes(w)
            wh, at = tk.window_hashes(h, w.first, k)
            hit = cm.is_repeated(bits.value, wh, width)
            wh, at = wh[hit], at[hit]
            if len(at) == 0:
                continue
            d = w.doc()[at]
            held.append((wh, _second_hash(h, at, k), b.column("doc_id").to_numpy()[d], b.column("row").to_numpy()[d], (at - w.first[d]).astype(np.uint32)))
            n += len(at)
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows whose smallest document is another; what a task has settled (buckets below 0) goes on as it is."""
        for bucket, cols in _read_chunks(batches):
            if bucket >= 0:
                order, later = _settle(*cols[:3])
                cols = tuple(c[order][later] for c in cols)
                to = -1 - (tk.mix(cols[2].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            else:
                to = np.full(len(cols[0]), bucket, np.int32)
            if len(to):
                none = np.zeros(len(to), np.uint64)
                yield _batch(list(_chunks(to, (none, none.astype(np.uint32), *cols[2:]))))

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, _, doc, row, pos) in _read_chunks(batches):
            order = np.lexsort((pos, row, doc))
            doc, row, pos = doc[order], row[order], pos[order]
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
            ends = [*cut[1:], len(doc)]
            places = [cm.pack(np.diff(pos[a:b], prepend=np.uint32(0))) for a, b in zip(cut, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(row[cut]), pa.array(np.array(ends) - cut, pa.int32()), pa.array(places, pa.binary())], names=["doc_id", "row", "n", "places"])

    found = keyed.mapInArrow(windows, _CHUNK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(exact, _CHUNK)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_doc, "doc_id long, row long, n int, places binary")


def _kept(w: tk.Words, gone: np.ndarray) -> list[bytes]:
    """Kept words of each document, joined by one space."""
    keep = np.flatnonzero(~gone)
    doc = w.doc()[keep]
    last = np.ones(len(keep), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    step = np.zeros(len(w.data) + 2, np.int32)
    np.add.at(step, w.start[keep], 1)
    np.add.at(step, w.end[keep] + ~last, -1)
    take = np.cumsum(step[: len(w.data)]) > 0
    out = np.where(w.space, np.uint8(32), w.data)[take].tobytes()
    at = np.concatenate([[0], np.cumsum(tk.sums_in(take, w.text_at))])
    return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def substring_dedup(docs: DataFrame, keep: list[str], k: int = WINDOW) -> DataFrame:
    """Columns ``keep`` with __n_words, __n_removed and __text (kept words joined by one space) of every row.

    Words lie in a removed window if its word sequence also starts in a document
    with a smaller doc_id. Null and empty texts keep an empty text; texts under
    k words and rows without doc_id keep all words.
    """
    found = repeated_windows(docs, k).withColumnsRenamed({"doc_id": "__d", "row": "__r", "n": "__n", "places": "__places"})
    side = docs.select(*keep, F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__row"), F.coalesce("text", F.lit("")).alias("__text"))
    both = side.join(found, (F.col("__doc") == F.col("__d")) & (F.col("__row") == F.col("__r")), "left").select(*keep, "__n", "__places", "__text")
    schema = side.select(*keep).schema.add("__n_words", "long").add("__n_removed", "long").add("__text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.pieces(batches, "__text"):
            w = tk.words(b.column("__text"))
            gone = np.zeros(len(w.start), dtype=bool)
            known = zip(w.first, b.column("__n").to_pylist(), b.column("__places").to_pylist(), strict=False)
            hit = [first + np.cumsum(cm.unpack(x, n, np.uint32)).astype(np.int64) for first, n, x in known if n]
            if hit:
                gone = tk.covered(np.concatenate(hit), k, len(gone))
            cols = [pa.array(np.diff(w.first)), pa.array(tk.sums_in(gone, w.first)), pa.array(_kept(w, gone), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *cols], names=[*keep, "__n_words", "__n_removed", "__text"])

    return both.mapInArrow(run, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept text of every document."""
    got = substring_dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__text", 256).alias("kept_sha256"))
