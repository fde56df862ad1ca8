"""The status report of a cluster: nodes, storage, volumes, health, and all findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import levels as L
from tidemark.functions.units import format_ago, format_count, format_duration, format_percent, plain_number
from tidemark.operators.health import finding, volume_findings

#: A sweep that never ran is a finding after so many seconds (fixed value).
GC_NEVER_AFTER = 86400


def node_status(members: DataFrame, skews: DataFrame, me: str) -> DataFrame:
    """Member rows (id, ...) with skew_ms of the measurements (peer, skew_ms); 0 for the node itself and where none is known."""
    known = skews.select(F.col("peer").alias("id"), F.col("skew_ms").alias("__ms"))
    ms = F.when(F.col("id") == me, F.lit(0)).otherwise(F.coalesce("__ms", F.lit(0)))
    return members.join(known, "id", "left").withColumn("skew_ms", ms.cast("long")).drop("__ms")


def export_path(name: Column) -> Column:
    """Path of an open export: ``vol``, ``/vol`` and ``/a//vol`` are ``/vol``, ``/vol`` and ``/a/vol``."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(name, "/"), lambda p: (p != "") & (p != ".")), "/"))


def volume_status(volumes: DataFrame, map_sizes: DataFrame, replicas: DataFrame, damaged: DataFrame, exports: DataFrame) -> DataFrame:
    """Volumes (inode, path, inline_extents, ...) with extents_written, replicas, map_damaged and attached.

    ``map_sizes`` are (inode, extents) of maps outside the namespace, ``replicas``
    (inode, replicas), ``damaged`` (inode), ``exports`` (name). The larger of the two
    counts is taken, since bindings live in one of the places.
    """
    attached = exports.select(export_path(F.col("name")).alias("path"), F.lit(True).alias("__here")).distinct()
    out = volumes.join(map_sizes.select("inode", "extents"), "inode", "left").join(replicas.select("inode", "replicas"), "inode", "left")
    out = out.join(damaged.select("inode", F.lit(True).alias("__bad")).distinct(), "inode", "left").join(attached, "path", "left")
    count = F.greatest(F.coalesce("inline_extents", F.lit(0)), F.coalesce("extents", F.lit(0))).cast("long")
    return out.select(*volumes.columns, count.alias("extents_written"), F.coalesce("replicas", F.array().cast("array<string>")).alias("replicas"), F.coalesce("__bad", F.lit(False)).alias("map_damaged"), F.coalesce("__here", F.lit(False)).alias("attached"))


def volume_totals(volumes: DataFrame) -> DataFrame:
    """One row: volumes, provisioned bytes, attached and damaged volumes."""
    return volumes.agg(F.count("*").alias("volumes"), F.coalesce(F.sum("size"), F.lit(0)).alias("provisioned"), F.count_if("attached").alias("attached"), F.count_if("map_damaged").alias("damaged"))


def storage_status(chunks: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: capacity, used, available of the disk row (zeros if it could not be read) and the number of chunks."""
    read = disk.agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("capacity", "used", "available")))
    return read.crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each


def cluster_health(members: DataFrame, skews: DataFrame, factor: int) -> DataFrame:
    """One row: alive nodes, replication factor, the greatest skew whatever its sign, nodes under pressure."""
    nodes = members.agg(F.count_if(F.col("state") == "alive").cast("int").alias("alive_nodes"), F.count_if("pressured").alias("pressured_nodes"))
    worst = skews.agg(F.coalesce(F.max(F.abs("skew_ms")), F.lit(0)).alias("clock_skew_ms"))
    return nodes.crossJoin(worst).withColumn("replication_factor", F.lit(factor))


def _many(n: str, one: str) -> Column:
    return F.concat(format_count(F.col(n)), F.when(F.col(n) == 1, f" {one}").otherwise(f" {one}s"))


def cluster_findings(health: DataFrame) -> DataFrame:
    """Findings of the health row (node, alive_nodes, replication_factor, isolated, rejoin_attempts)."""
    few = health.where(L.replication_kind(F.col("alive_nodes"), F.col("replication_factor")) == "degraded")
    text = F.concat(F.lit("Cluster degraded: "), _many("alive_nodes", "node"), F.lit(" alive, replication factor "), F.col("replication_factor").cast("string"))
    tries = F.when(F.col("rejoin_attempts") > 0, F.concat(F.lit(", "), _many("rejoin_attempts", "rejoin attempt"))).otherwise("")
    alone = health.where("isolated")
    return finding(few, 0, F.lit("degraded"), text).unionByName(finding(alone, 1, F.lit("degraded"), F.concat("node", F.lit(" isolated from its peers"), tries)))


def state_findings(nodes: DataFrame, now: Column) -> DataFrame:
    """Findings about nodes (id, state, last_change in seconds, pressured) that have not left, with how long the state lasts."""
    active = nodes.where("state <> 'left'")
    lasted = F.when(F.col("last_change").isNotNull(), F.concat(F.lit(" for "), format_duration(now - F.col("last_change")))).otherwise("")
    text = F.when(F.col("state") == "dead", F.concat("id", F.lit(" down"), lasted)).when(F.col("state") == "suspect", F.concat("id", F.lit(" suspect"), lasted)).otherwise(F.concat("id", F.lit(" state unknown")))
    frames = [
        finding(active.agg(F.count("*").alias("n")).where("n = 0"), 2, F.lit("attention"), F.lit("No nodes")),
        finding(active.where("state in ('dead', 'suspect', 'unknown')"), 3, L.node_level(F.col("state")), text),
        finding(active.where("pressured"), 4, F.lit("attention"), F.concat("id", F.lit(" pressured"))),
    ]
    return reduce(DataFrame.unionByName, frames)


def skew_findings(nodes: DataFrame, health: DataFrame) -> DataFrame:
    """A finding about the greatest skew: of the node rows or the health row (clock_skew_ms)."""
    both = nodes.select(F.abs("skew_ms").alias("ms")).unionByName(health.select(F.col("clock_skew_ms").alias("ms")))
    worst = both.agg(F.coalesce(F.max("ms"), F.lit(0)).alias("ms"))
    return finding(worst.where(L.skew_level(F.col("ms")) != "healthy"), 5, L.skew_level(F.col("ms")), F.concat(F.lit("Clock skew "), format_count(F.col("ms")), F.lit(" ms")))


def disk_findings(nodes: DataFrame, storage: DataFrame, me: str) -> DataFrame:
    """Findings about full disks: of nodes that report one, and of the responding node's own storage row if it reports none."""
    reported = nodes.where("state <> 'left' and capacity > 0").select("id", "used", "capacity")
    own = storage.where("capacity > 0").select(F.lit(me).alias("id"), "used", "capacity").join(reported.select("id"), "id", "left_anti")
    ratio = L.usage_ratio(F.col("used"), F.col("capacity"))
    full = reported.unionByName(own).where(L.fill_level(ratio) != "healthy")
    return finding(full, 6, L.fill_level(ratio), F.concat("id", F.lit(" disk "), format_percent(ratio), F.lit(" full")))


def backup_findings(backup: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """Findings of the backup row (configured, running, run_ok, started, finished, next, interval), times in seconds; none in an empty cluster."""
    kind = L.backup_kind(F.col("configured"), F.col("running"), F.col("run_ok"), F.col("finished") * 1000, F.col("next") * 1000, F.col("interval"), now * 1000)
    some = nodes.where("state <> 'left'").limit(1).select(F.lit(1).alias("__some"))
    when = F.coalesce("finished", "started")
    rows = backup.crossJoin(some).withColumn("__kind", kind).withColumn("__ago", format_ago(now - when))  # at most one row each
    failed = finding(rows.where("__kind = 'failed'"), 9, F.lit("attention"), F.concat(F.lit("Backup failed"), F.coalesce(F.concat(F.lit(" "), "__ago"), F.lit(""))))
    late = finding(rows.where("__kind = 'overdue'"), 9, F.lit("attention"), F.concat(F.lit("Backup overdue"), F.coalesce(F.concat(F.lit(", last run "), "__ago"), F.lit(""))))
    return failed.unionByName(late)


def gc_findings(gc: DataFrame, now: Column) -> DataFrame:
    """Findings of the collection row (enabled, running, error, last_run, started), times in seconds. A skipped sweep is none."""
    rows = gc.withColumn("__kind", L.gc_kind(F.col("enabled"), F.col("running"), F.col("error"), F.col("last_run")))
    failed = finding(rows.where("__kind = 'failed'"), 10, F.lit("attention"), F.concat(F.lit("GC failed"), F.coalesce(F.concat(F.lit(" "), format_ago(now - F.col("last_run"))), F.lit(""))))
    never = rows.where((F.col("__kind") == "never") & (now - F.col("started") > GC_NEVER_AFTER))
    return failed.unionByName(finding(never, 10, F.lit("attention"), F.concat(F.lit("GC has not run since start "), format_ago(now - F.col("started")))))


def all_findings(nodes: DataFrame, volumes: DataFrame, health: DataFrame, storage: DataFrame, backup: DataFrame, gc: DataFrame, me: str, factor: int, now: Column) -> DataFrame:
    """Every finding (rule, level, text), to be ordered by level (worst first), then rule."""
    frames = [
        cluster_findings(health), state_findings(nodes, now), skew_findings(nodes, health), disk_findings(nodes, storage, me),
        volume_findings(volumes, nodes, factor), backup_findings(backup, nodes, now), gc_findings(gc, now),
    ]
    return reduce(DataFrame.unionByName, frames)


def degraded_reasons(volumes: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """(path, reason) of degraded volumes: the states of replicas that are not alive, or how many of the factor there are."""
    each = volumes.select("path", F.size("replicas").alias("n"), F.explode_outer("replicas").alias("id"))
    state = F.concat(F.lit("replica on "), "id", F.lit(" "), F.coalesce("state", F.lit("unknown")))
    off = F.when(F.col("id").isNotNull() & (F.coalesce("state", F.lit("")) != "alive"), state)
    by = each.join(nodes.select("id", "state"), "id", "left").groupBy("path").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(off)).alias("off"))  # at most a replica set
    reason = F.when(F.size("off") > 0, F.array_join("off", ", ")).otherwise(F.concat(F.greatest("n", F.lit(0)).cast("string"), F.lit(f" of {factor} replicas")))
    return by.where((F.size("off") > 0) | (F.col("n") < factor)).select("path", reason.alias("reason"))


def panel_rows(volumes: DataFrame, nodes: DataFrame, factor: int, rates: DataFrame, text: str = "", first: int | None = 8) -> DataFrame:
    """Volumes (path, lease_holder, replicas, map_damaged) ranked for a table: damaged maps, then degraded ones with the
    reason, then by rate (path, rate) and path. ``text`` looks in paths and holders; ``first`` None shows all.
    """
    found = volumes.where(F.contains(F.lower("path"), F.lit(text.strip().lower())) | F.contains(F.lower(F.coalesce("lease_holder", F.lit(""))), F.lit(text.strip().lower())))
    rows = found.join(degraded_reasons(found, nodes, factor), "path", "left").join(rates.select("path", "rate"), "path", "left")
    rank = F.when(F.col("map_damaged"), 2).when(F.col("reason").isNotNull(), 1).otherwise(0)
    out = rows.select("path", rank.alias("rank"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("rate", F.lit(0.0)).alias("rate")).orderBy(F.desc("rank"), F.desc("rate"), "path")
    return out if first is None else out.limit(first)


def gauges(row: DataFrame, prefix: str, metrics: dict[str, tuple[str, str, str]], labels: dict[str, str]) -> DataFrame:
    """Metric rows (name, kind, help, labels, value) of a one-row frame; ``metrics`` maps a name to (column, kind, help). Null values give no row."""
    tags = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    each = F.array(*(F.struct(F.lit(f"{prefix}_{n}").alias("name"), F.lit(kind).alias("kind"), F.lit(text).alias("help"), F.col(c).cast("double").alias("value")) for n, (c, kind, text) in metrics.items()))
    return row.select(F.explode(each).alias("m")).where("m.value is not null").select("m.name", "m.kind", "m.help", tags.alias("labels"), "m.value")


def histogram_lines(histograms: DataFrame) -> DataFrame:
    """Lines (name, position, line) of rows (name, labels text, bounds, counts, sum, count): cumulative buckets, +Inf last, sum, count.

    ``labels`` is text like ``node="a"`` or empty.
    """
    tag = lambda extra: F.concat(F.lit("{"), F.array_join(F.filter(F.array("labels", extra), lambda x: x != ""), ","), F.lit("}"))
    plain = F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit("{"), "labels", F.lit("}")))
    le = lambda b: F.concat(F.lit('le="'), F.when(b == float("inf"), F.lit("+Inf")).otherwise(plain_number(b)), F.lit('"'))
    buckets = F.transform(F.arrays_zip("bounds", "counts"), lambda x: F.concat("name", F.lit("_bucket"), tag(le(x["bounds"])), F.lit(" "), x["counts"].cast("string")))
    rest = F.array(F.concat("name", F.lit("_sum"), plain, F.lit(" "), plain_number(F.col("sum"))), F.concat("name", F.lit("_count"), plain, F.lit(" "), F.col("count").cast("string")))
    return histograms.select("name", F.posexplode(F.concat(buckets, rest)).alias("position", "line"))
