"""Mark-and-sweep garbage collection and reaping, as plans (nothing is deleted here)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_set(refs: DataFrame, held_maps: DataFrame) -> DataFrame:
    """Distinct chunk ids of namespace references (id) and of all held maps' mapped extents (chunk_id), live volume or not."""
    return refs.select("id").union(held_maps.where("chunk_id <> ''").select("chunk_id")).distinct()


def unaccounted(live_volumes: DataFrame, held_maps: DataFrame) -> DataFrame:
    """One row, n: live volumes (id) without a held map. A sweep abstains unless it is 0."""
    held = held_maps.select(F.col("volume_id").alias("id")).distinct()
    return live_volumes.join(held, "id", "left_anti").agg(F.count("*").alias("n"))


def sweep(chunks: DataFrame, live: DataFrame, cutoff: Column, budget: int | None = None, abstain: bool = False) -> DataFrame:
    """Orphans (columns of ``chunks`` with deleted) created strictly before ``cutoff``.

    The first ``budget`` in file-name order are deleted, the rest deferred. The
    budget is found by a sort limit, not by numbering all orphans in one task.
    An abstaining sweep has no orphans.
    """
    if abstain:
        return chunks.limit(0).withColumn("deleted", F.lit(True))
    orphans = chunks.join(live.select("id").distinct(), "id", "left_anti").where(F.col("created_at") < cutoff)
    if budget is None:
        return orphans.withColumn("deleted", F.lit(True))
    file_name = F.concat(F.col("id").cast("string"), F.lit(".chunk"))
    first = orphans.orderBy(file_name).limit(budget).select("id", F.lit(True).alias("deleted"))
    return orphans.join(first, "id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def skip_streak(runs: DataFrame, by: str, order: str, outcome: str) -> DataFrame:
    """Adds streak: skips since the last clean run; failed runs leave it unchanged."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = runs.withColumn("__clean", F.count_if(F.col(outcome) == "ok").over(w))
    inside = Window.partitionBy(by, "__clean").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.count_if(F.col(outcome) == "skipped").over(inside)).drop("__clean")


def reap(maps: DataFrame, live_volumes: DataFrame, cutoff: Column) -> DataFrame:
    """Volume ids of maps (volume_id, snapshot_mtime, log_mtime) of dead volumes whose newest file is older than ``cutoff``.

    Maps without files go at once.
    """
    newest = F.greatest("snapshot_mtime", "log_mtime")
    dead = maps.join(live_volumes.select(F.col("id").alias("volume_id")), "volume_id", "left_anti")
    return dead.where(newest.isNull() | (newest < cutoff)).select("volume_id")
