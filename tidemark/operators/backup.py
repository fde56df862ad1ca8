"""Incremental backups: plan, confirmation, verification, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_checksums(manifests: DataFrame) -> DataFrame:
    """(id, size, sha256) of rows (key, id, size, sha256): the last manifest in key order wins."""
    return manifests.groupBy("id").agg(F.max_by(F.struct("size", "sha256"), "key").alias("c")).select("id", "c.size", "c.sha256")


def plan_chunks(local: DataFrame, remote: DataFrame, known: DataFrame) -> DataFrame:
    """(id, action): upload what the target lacks or holds empty, trust what a manifest knows at that size, hash the rest."""
    there = remote.select("id", F.col("size").alias("__size"))
    seen = known.select("id", F.col("size").alias("__known"))
    action = F.when(F.coalesce(F.col("__size"), F.lit(0)) <= 0, "upload").when(F.col("__known") == F.col("__size"), "known").otherwise("hash")
    return local.select("id").join(there, "id", "left").join(seen, "id", "left").select("id", action.alias("action"))


def confirm(manifest: DataFrame, remote: DataFrame) -> DataFrame:
    """Manifest rows (id, size) that the listing does not confirm; empty is good."""
    there = remote.select("id", F.col("size").alias("__size"))
    return manifest.join(there, "id", "left").where(~F.col("size").eqNullSafe(F.col("__size"))).select("id", "size", F.col("__size").alias("found_size"))


def verify(expected: DataFrame, actual: DataFrame, deep: bool = False) -> DataFrame:
    """(name, problem) of expected rows (name, size, sha256): missing, size or, if deep, checksum."""
    there = actual.select("name", F.col("size").alias("__size"), *([F.col("sha256").alias("__sha")] if deep else []))
    problem = F.when(F.col("__size").isNull(), "missing").when(F.col("size") != F.col("__size"), "size")
    if deep:
        problem = problem.when(~F.col("sha256").eqNullSafe(F.col("__sha")), "checksum")
    return expected.join(there, "name", "left").withColumn("problem", problem).where("problem is not null").select("name", "problem")


def expired_manifests(manifests: DataFrame, retain: int, floor: Column, by: str = "node", stamp: str = "stamp") -> DataFrame:
    """Manifests beyond the newest ``retain`` per node that are also older than ``floor`` (strictly)."""
    w = Window.partitionBy(by).orderBy(F.desc(stamp))
    return manifests.withColumn("__rank", F.row_number().over(w)).where((F.col("__rank") > retain) & (F.col(stamp) < floor)).drop("__rank")


def prunable(objects: DataFrame, referenced: DataFrame, cutoff: Column, held: bool = False) -> DataFrame:
    """Objects (id, mtime) that no manifest refers to and that are older than ``cutoff``; none while another run is active.

    Objects without a modification time stay.
    """
    if held:
        return objects.limit(0)
    return objects.join(referenced.select("id").distinct(), "id", "left_anti").where(F.col("mtime") < cutoff)


def active_runs(markers: DataFrame, me: str, stale_before: Column) -> DataFrame:
    """(node, state) of other nodes' run markers (node, at): active or stale."""
    last = markers.where(F.col("node") != me).groupBy("node").agg(F.max("at").alias("at"))
    return last.select("node", F.when(F.col("at") >= stale_before, "active").otherwise("stale").alias("state"))


def manifest_totals(manifests: DataFrame, refs: str = "chunks") -> DataFrame:
    """Adds total_bytes of a nested array of references."""
    return manifests.withColumn("total_bytes", F.aggregate(refs, F.lit(0).cast("long"), lambda a, c: a + c["size"]))


def build_manifests(chunks: DataFrame, by: list[str]) -> DataFrame:
    """One row per run with its sorted chunk references (id, size)."""
    return chunks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("chunks"))


def valid_manifest(refs: str = "chunks") -> Column:
    """Whether sizes are positive and ids distinct."""
    ids = F.transform(refs, lambda c: c["id"])
    return F.forall(refs, lambda c: c["size"] > 0) & (F.size(F.array_distinct(ids)) == F.size(ids))


def retention_pass(manifests: DataFrame, objects: DataFrame, markers: DataFrame, me: str, now: Column, retain: int, retain_for: int, grace: int, current: str | None = None, stale_run: int = 3600) -> DataFrame:
    """(kind, name, reason) of everything a retention pass of node ``me`` would delete, with its refusals as rows of kind ``refused``.

    ``manifests`` are (node, stamp, name, readable, chunks as an array of ids),
    stamps as times, null stamps being copies of the latest; ``objects`` are
    (kind, node, stamp, id, name, mtime) of kind run (namespace and extent maps
    of a run) or chunk; ``markers`` are (node, name, at). Times are timestamps,
    spans are seconds.

    1. Manifests of ``me`` beyond the newest ``retain`` go, if older than ``retain_for``.
    2. Objects of its runs without a remaining manifest go, once older than ``grace``.
    3. Chunks that no manifest of any node names go, once older than ``grace``.

    Nothing goes if the listing does not show ``current``, the manifest of the
    run itself. No chunk goes if a manifest is unreadable or there is none at
    all, or while another node's run marker is younger than ``stale_run``; older
    markers of others go. Objects without a time stay.
    """
    if retain < 1:
        raise ValueError("a retention pass keeps at least one manifest")
    back = lambda s: now - F.make_interval(secs=F.lit(s))
    own = manifests.where((F.col("node") == me) & F.col("stamp").isNotNull())
    row = lambda df, kind, name, reason: df.select(F.lit(kind).alias("kind"), name.alias("name"), F.lit(reason).alias("reason"))
    refused = lambda df, text: df.select(F.lit("refused").alias("kind"), F.lit("").alias("name"), F.lit(text).alias("reason"))
    if current is not None and own.where(F.col("name") == current).isEmpty():
        return refused(manifests.sparkSession.range(1), "the listing lacks the manifest of this run")
    gone = expired_manifests(own, retain, back(retain_for) if retain_for > 0 else F.lit("9999-12-31").cast("timestamp"))
    kept = own.join(gone.select("name"), "name", "left_anti").select(F.col("stamp").alias("__kept"))
    old = F.coalesce(F.col("mtime") < back(grace), F.lit(False))
    runs = objects.where((F.col("kind") == "run") & (F.col("node") == me) & F.col("stamp").isNotNull() & old)
    runs = runs.join(kept.distinct(), F.col("stamp") == F.col("__kept"), "left_anti")
    others = markers.where(F.col("node") != me).withColumn("__fresh", F.coalesce(F.col("at") >= back(stale_run), F.lit(True)))
    out = row(gone, "manifest", F.col("name"), "beyond retention").unionByName(row(runs, "run", F.col("name"), "no manifest of the run")).unionByName(row(others.where("not __fresh"), "marker", F.col("name"), "stale run"))
    state = manifests.agg(F.count("*").alias("n"), F.count_if(~F.col("readable")).alias("bad")).crossJoin(others.agg(F.count_if("__fresh").alias("busy"))).first()
    named = manifests.select(F.explode("chunks").alias("id")).distinct()
    doomed = objects.where((F.col("kind") == "chunk") & old).join(named, "id", "left_anti")
    if state["bad"] or not state["n"]:
        return out.unionByName(refused(manifests.sparkSession.range(1), "chunks stay: a manifest is unreadable" if state["bad"] else "chunks stay: there is no manifest"))
    if state["busy"]:
        return out.unionByName(refused(doomed.limit(1), "chunks stay: another node has a run in progress"))
    return out.unionByName(row(doomed, "chunk", F.col("name"), "no manifest names it"))


def restore_plan(manifest: DataFrame, objects: DataFrame, available: int | None, margin: int = 0) -> DataFrame:
    """(name, action) for each distinct object (name, size, sha256) of a manifest: ``copy``, or what stands against it.

    ``missing``, ``size`` and ``checksum`` are told against the listing ``objects``
    (name, size, sha256). If the whole does not fit in ``available`` bytes less
    ``margin``, every action is ``no space``; null ``available`` is unknown and admits.
    Of repeated names the one that sorts last counts.
    """
    wanted = manifest.groupBy("name").agg(F.max(F.struct("size", "sha256")).alias("w")).select("name", "w.size", "w.sha256")
    need = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    there = objects.select("name", F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    found = F.when(F.col("__size").isNull(), "missing").when(F.col("size") != F.col("__size"), "size").when(~F.col("sha256").eqNullSafe(F.col("__sha")), "checksum").otherwise("copy")
    fits = available is None or available >= need + margin
    return wanted.join(there, "name", "left").select("name", (found if fits else F.lit("no space")).alias("action"))
