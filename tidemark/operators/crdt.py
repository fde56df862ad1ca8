"""Conflict-free replicated state as DataFrames.

LWW maps are tidy rows (keys, value, ts); OR-sets are add rows (elem, tag) and
tombstone rows (elem, tag, at). Every merge is a union with an aggregation that
Spark combines before its shuffle, so hot keys cost one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNMAPPED = ""


def lww_merge(rows: DataFrame, keys: list[str], value: str, ts: Column, tie: Column | None = None) -> DataFrame:
    """Value and stamp with the greatest stamp per key. ``tie`` orders equal stamps; without it they should carry one value.

    Rows with a null stamp never win over others. An empty table gives no rows.
    """
    order = F.struct(ts.alias("ts"), (tie if tie is not None else F.col(value)).alias("tie"))
    return rows.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), F.col(value).alias("v"))).alias("w")).select(*keys, F.col("w.v").alias(value), F.col("w.o.ts").alias("ts"))


def lww_union(*maps: DataFrame) -> DataFrame:
    """All entries of several maps; merge them with lww_merge."""
    return reduce(DataFrame.unionByName, maps)


def lww_get(entries: DataFrame, condition: Column, value: str = "value") -> DataFrame:
    """Entries under a condition with the tombstone value read as null."""
    return entries.where(condition).withColumn(value, F.nullif(F.col(value), F.lit(UNMAPPED)))


def mapped_counts(entries: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Entries per group that are not tombstones."""
    return entries.groupBy(group).agg(F.count_if(F.col(value) != UNMAPPED).alias("mapped"))


def orset_merge(adds: list[DataFrame], tombs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of add tags; the latest removal time of each tag."""
    a = reduce(DataFrame.unionByName, adds).distinct()
    t = reduce(DataFrame.unionByName, tombs)
    return a, t.groupBy(*[c for c in t.columns if c != "at"]).agg(F.max("at").alias("at"))


def orset_live(adds: DataFrame, tombs: DataFrame, elem: str = "elem", tag: str = "tag") -> DataFrame:
    """Add rows whose tag has no tombstone."""
    return adds.join(tombs.select(elem, tag), [elem, tag], "left_anti")


def orset_elements(adds: DataFrame, tombs: DataFrame, elem: str = "elem", tag: str = "tag") -> DataFrame:
    """Elements with a live tag, and the greatest one."""
    return orset_live(adds, tombs, elem, tag).groupBy(elem).agg(F.max(tag).alias("live_tag"))


def orset_remove(adds: DataFrame, removals: DataFrame, elem: str = "elem", tag: str = "tag") -> DataFrame:
    """Tombstones of the tags that each removal (elem, at) observes: those below its time. Elements without a tag give none."""
    r = removals.select(F.col(elem).alias("r_elem"), "at")
    return adds.join(r, (F.col(elem) == F.col("r_elem")) & (F.col(tag) < F.col("at"))).groupBy(elem, tag).agg(F.max("at").alias("at"))


def orset_gc(adds: DataFrame, tombs: DataFrame, cutoff: Column, elem: str = "elem", tag: str = "tag") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(adds, tombs, reclaimed): pairs whose removal is not after ``cutoff`` go."""
    old = tombs.where(F.col("at") <= cutoff)
    return adds.join(old.select(elem, tag), [elem, tag], "left_anti"), tombs.where(F.col("at") > cutoff), old.agg(F.count("*").alias("reclaimed"))


def merged_inodes(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Inodes (id, type, size, acl, acl_at, lease, lease_at) of two replicas merged.

    New inodes are adopted whole. Of shared ones the registers acl and lease
    take the newer stamp, ``mine`` where stamps are equal; type and size are never
    merged. Children, manifests and extents are merged as sets and maps of their
    own (orset_merge, lww_union).
    """
    newer = lambda v, at: F.when(F.col("m.id").isNull() | (F.col(f"t.{at}").isNotNull() & (F.col(f"m.{at}").isNull() | (F.col(f"t.{at}") > F.col(f"m.{at}")))), F.col(f"t.{v}")).otherwise(F.col(f"m.{v}"))
    own = lambda c: F.when(F.col("m.id").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(f"t.{c}"))
    both = mine.alias("m").join(theirs.alias("t"), F.col("m.id") == F.col("t.id"), "full")
    registers = [newer(v, at).alias(c) for r, at in (("acl", "acl_at"), ("lease", "lease_at")) for v, c in ((r, r), (at, at))]
    return both.select(F.coalesce("m.id", "t.id").alias("id"), own("type").alias("type"), own("size").alias("size"), *registers)


def decoded_inodes(wire: DataFrame) -> DataFrame:
    """Wire rows (id, type, children, manifest, extents, lease) with what their type has no use for set to null.

    Directories (1) have children, volumes (2) extents and a lease; every other
    type, known or not, is a file with a manifest, so decoding never fails.
    """
    of = lambda cond, c: F.when(cond, F.col(c)).alias(c)
    t = F.coalesce(F.col("type"), F.lit(0))
    return wire.select("id", "type", of(t == 1, "children"), of(~t.isin(1, 2), "manifest"), of(t == 2, "extents"), of(t == 2, "lease"))
