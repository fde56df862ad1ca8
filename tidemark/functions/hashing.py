"""Hashes, stamps and orderings as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a 64-bit start value and prime minus 2**40 (fixed values).
FNV_START = -3750763034362895579
FNV_LOW_PRIME = 435
#: Salt of a map's digest (fixed value).
DIGEST_SALT = 0x5110000000000001
MIN_LONG = -(1 << 63)


def fnv1a64(text: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes of a string, as a BIGINT bit pattern.

    The multiplication by 2**40 + 435 runs on 32-bit limbs, because a plain
    BIGINT product overflows under ANSI rules. Null gives null.
    """
    hexed = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(
        F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1),
        lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
    )
    word = 0xFFFFFFFF

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        lo, hi = x.bitwiseAND(F.lit(word)), F.shiftrightunsigned(x, 32)
        low = lo * FNV_LOW_PRIME
        high = (hi * FNV_LOW_PRIME + F.shiftrightunsigned(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(word))
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(word)))

    return F.when(text == "", F.lit(FNV_START)).otherwise(F.aggregate(codes, F.lit(FNV_START).cast("long"), step))


def fnv1a64_batch(texts: pa.Array) -> np.ndarray:
    """FNV-1a 64 of the UTF-8 bytes of each string of an Arrow array, unsigned; nulls count as empty.

    All texts that are long enough take their next byte together, the longest first in the array.
    """
    raw = texts.fill_null("").cast(pa.large_binary())
    _, places, data = raw.buffers()
    ends = np.frombuffer(places, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    order = np.argsort(-np.diff(ends), kind="stable")
    start, length = ends[:-1][order], np.diff(ends)[order]
    codes = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    h = np.full(len(raw), FNV_START % 2**64, np.uint64)
    prime, n = np.uint64(2**40 + FNV_LOW_PRIME), len(raw)
    for i in range(int(length[0]) if n else 0):
        while length[n - 1] <= i:
            n -= 1
        h[:n] = (h[:n] ^ codes[start[:n] + i]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def unsigned(x: Column) -> Column:
    """A BIGINT bit pattern as its unsigned value, DECIMAL(20, 0)."""
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def unsigned_order(x: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of ``x``."""
    return x.bitwiseXOR(F.lit(MIN_LONG).cast("long"))


def hlc(wall: Column, logical: Column, node: Column) -> Column:
    """Hybrid logical clock stamp; structs compare field by field, which is its total order."""
    return F.struct(wall.cast("long").alias("wall"), logical.cast("long").alias("logical"), node.cast("string").alias("node"))


def hlc_text(ts: Column) -> Column:
    """wall.logical.node"""
    return F.concat_ws(".", ts["wall"].cast("string"), ts["logical"].cast("string"), ts["node"])


def hlc_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def hlc_is_zero(ts: Column) -> Column:
    return (ts["wall"] == 0) & (ts["logical"] == 0) & (ts["node"] == "")


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)
