"""Byte ranges over fixed-size extents: locate, split, trim, read, re-chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locate(offset: Column, size: int) -> Column:
    """struct(idx, within) of a byte offset."""
    return F.struct(F.floor(offset / size).cast("long").alias("idx"), (offset % size).alias("within"))


def in_bounds(offset: Column, length: Column, total: Column) -> Column:
    """Whether [offset, offset + length) lies in [0, total), without overflow."""
    return (offset >= 0) & (length >= 0) & (length <= total) & (offset <= total - length)


def split_range(ranges: DataFrame, offset: str, length: str, size: int) -> DataFrame:
    """One row (idx, begin, n, whole) per extent that a range touches; empty ranges touch none."""
    first, last = F.floor(F.col(offset) / size).cast("long"), F.floor((F.col(offset) + F.col(length) - 1) / size).cast("long")
    each = ranges.where(F.col(length) > 0).withColumn("idx", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col(offset), F.col("idx") * size)
    end = F.least(F.col(offset) + F.col(length), (F.col("idx") + 1) * size)
    return each.withColumn("begin", begin - F.col("idx") * size).withColumn("n", end - begin).withColumn("whole", F.col("n") == size)


def trimmed(ranges: DataFrame, mapped: DataFrame, keys: list[str], offset: str, length: str, size: int) -> DataFrame:
    """Mapped extents (keys, idx) that a range covers wholly."""
    first = F.ceil(F.col(offset) / size).cast("long")
    last = F.floor((F.col(offset) + F.col(length)) / size).cast("long") - 1
    covered = ranges.where(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("idx")).distinct()
    return covered.join(mapped.select(*keys, "idx"), [*keys, "idx"], "left_semi")


def rechunk(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, idx, part): a text in parts of ``size`` characters, the last one shorter; none for an empty text."""
    n = F.ceil(F.char_length(text) / size).cast("int")
    return texts.where(F.char_length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).select(key, "idx", F.substring(F.col(text), F.col("idx") * size + 1, F.lit(size)).alias("part"))


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """(key, text): the parts of a key joined in order."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "").alias("text"))


def read_range(wanted: DataFrame, mapped: DataFrame, keys: list[str], size: int, fill: str = "0") -> DataFrame:
    """Adds data to rows (keys, idx, begin, n): the mapped part's characters, ``fill`` where unmapped or short."""
    got = wanted.join(mapped.select(*keys, "idx", "part"), [*keys, "idx"], "left")
    whole = F.rpad(F.coalesce("part", F.lit("")), size, fill)
    return got.withColumn("data", F.substring(whole, (F.col("begin") + 1).cast("int"), F.col("n").cast("int"))).drop("part")
