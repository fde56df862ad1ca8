"""Health findings of a cluster: one frame per rule, united and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import levels as L
from tidemark.functions.units import format_percent


def degraded_volumes(volumes: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """Adds degraded: fewer replicas than ``factor``, or one on a node that is not known to be alive."""
    each = volumes.select("path", F.explode_outer("replicas").alias("id"))
    bad = each.join(nodes.select("id", "state"), "id", "left").groupBy("path").agg(F.bool_or(F.col("id").isNotNull() & (F.coalesce("state", F.lit("")) != "alive")).alias("bad"))
    return volumes.join(bad, "path").withColumn("degraded", (F.size("replicas") < factor) | F.col("bad")).drop("bad")


def finding(df: DataFrame, order: int, level: Column, text: Column) -> DataFrame:
    return df.select(F.lit(order).alias("rule"), level.alias("level"), text.alias("text"))


def node_findings(nodes: DataFrame) -> DataFrame:
    """Findings about rows (id, state, pressured, skew_ms, capacity, used); nodes that left give none."""
    active = nodes.where("state <> 'left'")
    down = F.when(F.col("state") == "dead", " down").when(F.col("state") == "suspect", " suspect").otherwise(" state unknown")
    ratio = L.usage_ratio(F.col("used"), F.col("capacity"))
    frames = [
        finding(active.agg(F.count("*").alias("n")).where("n = 0"), 2, F.lit("attention"), F.lit("No nodes")),
        finding(active.where("state <> 'alive'"), 3, L.node_level(F.col("state")), F.concat("id", down)),
        finding(active.where("pressured"), 4, F.lit("attention"), F.concat("id", F.lit(" pressured"))),
        finding(nodes.agg(F.coalesce(F.max(F.abs("skew_ms")), F.lit(0)).alias("ms")).where(F.col("ms") >= L.SKEW_WARN_MS), 5, L.skew_level(F.col("ms")), F.concat(F.lit("Clock skew "), F.format_number("ms", 0), F.lit(" ms"))),
        finding(active.where(ratio >= L.FILL_WARN), 6, L.fill_level(ratio), F.concat("id", F.lit(" disk "), format_percent(ratio), F.lit(" full"))),
    ]
    return reduce(DataFrame.unionByName, frames)


def volume_findings(volumes: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """Findings about rows (path, replicas, map_damaged)."""
    many = lambda one: F.concat(F.format_number("n", 0), F.when(F.col("n") == 1, f" {one}").otherwise(f" {one}s"))
    damaged = volumes.agg(F.count_if("map_damaged").alias("n")).where("n > 0")
    degraded = degraded_volumes(volumes, nodes, factor).agg(F.count_if("degraded").alias("n")).where("n > 0")
    return finding(damaged, 7, F.lit("degraded"), F.concat(many("volume map"), F.lit(" damaged"))).unionByName(finding(degraded, 8, F.lit("attention"), F.concat(many("volume"), F.lit(" degraded"))))


def worst_level(findings: DataFrame) -> DataFrame:
    """One row: the worst level, healthy without findings."""
    return findings.agg(L.level_of(F.coalesce(F.max(L.rank(F.col("level"))), F.lit(0))).alias("level"))


def node_summary(nodes: DataFrame) -> DataFrame:
    """One row of counts and capacity totals over nodes that have not left."""
    here = F.col("state") != "left"
    has = here & (F.col("capacity") > 0)
    return nodes.agg(
        F.count_if(here).alias("total"), F.count_if(F.col("state") == "alive").alias("up"), F.count_if(F.col("state") == "suspect").alias("suspect"), F.count_if(F.col("state") == "dead").alias("down"),
        F.coalesce(F.sum(F.when(has, F.col("capacity"))), F.lit(0)).alias("capacity"), F.coalesce(F.sum(F.when(has, F.col("used"))), F.lit(0)).alias("used"),
    )
