"""Replica comparison: digests, deltas, coverage, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import DIGEST_SALT, fnv1a64


def digests(entries: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, digest, mapped): XOR of the rows' FNV-1a hashes and the salt; row order does not matter.

    Equal rows would cancel out, so entries should be unique per key.
    """
    row = F.concat_ws("|", *(F.col(f).cast("string") for f in fields))
    return entries.groupBy(group).agg(F.bit_xor(fnv1a64(row)).bitwiseXOR(F.lit(DIGEST_SALT)).alias("digest"), F.count("*").alias("mapped"))


def missing_from(a: DataFrame, b: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks or has with another value or stamp: what to send to ``b``."""
    other = b.select(*keys, *(F.col(c).alias(f"__{c}") for c in rest), F.lit(True).alias("__has"))
    same = F.col("__has").isNotNull()
    for c in rest:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(other, keys, "left").where(~same).select(*a.columns)


def covers(local: DataFrame, peer: DataFrame, key: str, group: str, horizon: Column) -> DataFrame:
    """(group, covered): every settled, mapped peer row has a local row with a stamp at least as new."""
    settled = peer.where((F.col("value") != "") & (F.col("ts.wall") < horizon)).select(group, key, F.col("ts").alias("peer_ts"))
    mine = local.select(group, key, F.col("ts").alias("local_ts"))
    return settled.join(mine, [group, key], "left").groupBy(group).agg(F.bool_and(F.coalesce(F.col("local_ts") >= F.col("peer_ts"), F.lit(False))).alias("covered"))


def classify_replicas(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, state) over both sides: ok, diverged, absent_here or absent_there."""
    left = a.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    state = F.when(F.col("__in_a").isNull(), "absent_here").when(F.col("__in_b").isNull(), "absent_there").when(F.col("__a").eqNullSafe(F.col("__b")), "ok").otherwise("diverged")
    return left.join(right, keys, "full").select(*keys, state.alias("state"))


def converged(states: DataFrame, group: str) -> DataFrame:
    """One row: whether all are ok, and the least group that is not."""
    bad = F.col("state") != "ok"
    return states.agg(F.coalesce(F.bool_and(~bad), F.lit(True)).alias("converged"), F.min(F.when(bad, F.col(group))).alias("first_diverged"))


def scrub_plan(chunks: DataFrame, live: DataFrame, incomplete: bool) -> DataFrame:
    """Chunks (id) with action: ``heal`` those that the live set names, ``skip`` orphans, which collection owns.

    With an incomplete view a chunk may only look like an orphan: all are healed then.
    """
    if incomplete:
        return chunks.withColumn("action", F.lit("heal"))
    return chunks.join(live.select("id", F.lit(True).alias("__live")).distinct(), "id", "left").withColumn("action", F.when(F.col("__live"), "heal").otherwise("skip")).drop("__live")


def current_replicas(probes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(volume, node, current) of probes (volume, node, attempt, known, same) and coverage (volume, node, covers).

    A replica is current if its first probe agrees; else the later probes
    settle it, the last of which counts; a failed first or last probe means no;
    copies that still differ are current if the peer covers what was written.
    """
    last = probes.groupBy("volume", "node").agg(F.min_by(F.struct("known", "same"), "attempt").alias("a"), F.max_by(F.struct("known", "same"), "attempt").alias("z"), F.bool_or(F.col("known") & F.col("same")).alias("met"))
    both = last.join(coverage.select("volume", "node", "covers"), ["volume", "node"], "left")
    current = F.when(~F.col("a.known"), False).when(F.col("met"), True).when(~F.col("z.known"), False).otherwise(F.coalesce("covers", F.lit(False)))
    return both.select("volume", "node", current.alias("current"))


def copied_map(entries: DataFrame, source: str, target: str, group: str = "volume") -> DataFrame:
    """The bindings of one volume under a new id, as a copy-on-write snapshot starts; ``target`` must not have bindings yet."""
    if not entries.where(F.col(group) == target).isEmpty():
        raise ValueError(f"{target} has bindings already")
    return entries.where(F.col(group) == source).withColumn(group, F.lit(target))


def known_volumes(maps: DataFrame, lost: DataFrame) -> DataFrame:
    """(volume) of every volume with a map or a lost flag."""
    return maps.select("volume").union(lost.select("volume")).distinct()
