"""Framed logs of extent bindings: batches of entries with a length and a CRC-32 before each.

A record is a body with its length and checksum (32-bit, little-endian) in front.
A body is a version byte, a count (32-bit), and per entry the index (64-bit), the
clock's wall (64-bit), logical (32-bit) and node, and the value; texts have a
16-bit length in front. A log that a crash cut short ends in a part of a record
or in zeroes: that tail was never acknowledged and is left out. A whole record
with a wrong checksum or body is damage.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Version byte, sizes of the frame and of an entry without its texts (fixed values).
VERSION, FRAME, ENTRY = 1, struct.Struct("<II"), struct.Struct("<QqI")
ENTRIES = "idx decimal(20,0), wall bigint, logical bigint, node string, value string"
#: Entries of a record that is written.
BATCH = 64
#: Bytes of a log that is written before a task starts another.
LOG_BYTES = 4 << 20


def _text(x: str) -> bytes:
    raw = x.encode()
    if len(raw) > 0xFFFF:
        raise ValueError("a node or value is longer than 65,535 bytes")
    return struct.pack("<H", len(raw)) + raw


def framed(entries: list[tuple[int, int, int, str, str]]) -> bytes:
    """One record of (idx, wall, logical, node, value)."""
    body = bytes([VERSION]) + struct.pack("<I", len(entries)) + b"".join(ENTRY.pack(i, w, c) + _text(n) + _text(v) for i, w, c, n, v in entries)
    return FRAME.pack(len(body), zlib.crc32(body)) + body


def _entries(body: bytes) -> list[tuple[int, int, int, str, str]]:
    if len(body) < 5 or body[0] != VERSION:
        raise ValueError("unknown version or no count")
    (count,), at, out = struct.unpack_from("<I", body, 1), 5, []
    for _ in range(count):
        idx, wall, logical = ENTRY.unpack_from(body, at)
        at += ENTRY.size
        texts = []
        for _ in range(2):
            (n,) = struct.unpack_from("<H", body, at)
            if at + 2 + n > len(body):
                raise ValueError("an entry runs past the body")
            texts.append(body[at + 2 : at + 2 + n].decode("utf-8", "replace"))
            at += 2 + n
        out.append((idx, wall, logical, *texts))
    if at != len(body):
        raise ValueError("bytes follow the last entry")
    return out


def _scan(log: bytes) -> tuple[list[list[tuple]], bool, str | None]:
    """(records, torn, error) of a log; records before an error count."""
    records, at = [], 0
    while at < len(log):
        if len(log) - at < FRAME.size or not log[at : at + 64].strip(b"\0") and not log[at:].strip(b"\0"):
            return records, True, None
        size, crc = FRAME.unpack_from(log, at)
        body = log[at + FRAME.size : at + FRAME.size + size]
        if len(body) < size:
            return records, True, None
        if zlib.crc32(body) != crc:
            return records, False, f"checksum at byte {at}"
        try:
            records.append(_entries(body))
        except (struct.error, ValueError):
            return records, False, f"malformed record at byte {at}"
        at += FRAME.size + size
    return records, False, None


def replay(logs: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, record, idx, wall, logical, node, value) of the intact records of each log, before its first damage.

    Feed the rows to a last-writer-wins merge. A null log has no records. Logs
    are bounded files; one is held by a task at a time.
    """
    schema = f"name string, record int, {ENTRIES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for log_name, log in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                rows = [(log_name, i, *e) for i, r in enumerate(_scan(log.as_py() or b"")[0]) for e in r]
                types = (pa.string(), pa.int32(), pa.decimal128(20, 0), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = zip(*rows, strict=True) if rows else ([] for _ in types)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["name", "record", "idx", "wall", "logical", "node", "value"])

    return logs.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, schema)


def log_states(logs: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, records, torn, error) of each log; error is null unless a whole record is damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(n, *_scan(log.as_py() or b"")) for n, log in zip(b.column("name").to_pylist(), b.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([len(x[1]) for x in found], pa.int32()), pa.array([x[2] for x in found], pa.bool_()), pa.array([x[3] for x in found], pa.string())], names=["name", "records", "torn", "error"])

    return logs.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, records int, torn boolean, error string")


def logs_of(entries: DataFrame) -> DataFrame:
    """(name, content): entries (idx, wall, logical, node, value) framed in logs of some megabytes, one or more per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def log() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{zlib.crc32(content):08x}-{len(content)}"]), pa.array([content], pa.binary())], names=["name", "content"])

        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for a in range(0, len(rows), BATCH):
                held.append(framed([(int(i), w, c, node, value) for i, w, c, node, value in rows[a : a + BATCH]]))
                n += len(held[-1])
            if n >= LOG_BYTES:
                yield log()
                held, n = [], 0
        if held:
            yield log()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return entries.select("idx", F.col("wall").cast("long"), F.col("logical").cast("long"), text("node"), text("value")).mapInArrow(run, "name string, content binary")
