"""Histories of runs: totals, bars, last success, earlier failures; manifests in write order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Height of the tallest and of the shortest bar; share of a disk that is full; a limit is drawn up to so many peaks (fixed values).
TALLEST, SHORTEST, FULL, REACH = 56.0, 2.0, 0.8, 2.0


def run_totals(runs: DataFrame, by: str) -> DataFrame:
    """Per node of runs (by, seq, ok, started, finished, uploaded, skipped, bytes, chunks): counters over all, figures of the last run and the last success."""
    ok = F.col("ok")
    good = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.count_if(~ok).alias("failures"), good("uploaded").alias("uploaded"), good("skipped").alias("skipped"), good("bytes").alias("bytes"),
        F.max_by(F.col("finished") - F.col("started"), "seq").alias("last_duration"), F.max_by("ok", "seq").alias("last_ok"),
        F.max_by("chunks", F.when(ok, F.col("seq"))).alias("last_chunks"), F.max(F.when(ok, F.col("finished"))).alias("last_success"),
    )


def run_bars(runs: DataFrame, by: str, seq: str, v: str) -> DataFrame:
    """Adds bar: height of a run's value on its node's scale (the greatest finite value, 1 without one); a stub for nothing."""
    x = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | F.col(v).isNull(), F.lit(0.0)).otherwise(F.col(v).cast("double"))
    peak = F.max(F.greatest(x, F.lit(0.0))).over(Window.partitionBy(by))
    scale = F.when(peak > 0, peak).otherwise(1.0)
    return runs.withColumn("bar", F.greatest(F.greatest(x, F.lit(0.0)) / scale * TALLEST, F.lit(SHORTEST)))


def latest_ok(runs: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, place) of the last successful run, counted from 0; -1 without one."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(seq)) - 1
    return runs.withColumn("__i", i).groupBy(by).agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("__i"))), F.lit(-1)).alias("place"))


def earlier_failures(runs: DataFrame, by: str, seq: str, at: str) -> DataFrame:
    """(by, text) naming the failed runs before the newest; '' without any. ``runs`` is what is shown, a bounded number for each node."""
    newest = F.col(seq) == F.max(seq).over(Window.partitionBy(by))
    failed = F.when((F.col("outcome") == "failed") & ~F.col("__newest"), F.struct(F.col(seq).alias("s"), F.date_format(at, "HH:mm").alias("t")))
    got = runs.withColumn("__newest", newest).groupBy(by).agg(F.sort_array(F.collect_list(failed)).alias("f"), F.count("*").alias("n"))
    text = F.concat(F.size("f").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" runs failed, at "), F.array_join(F.transform("f", lambda x: x["t"]), ", "), F.lit("."))
    return got.select(by, F.when(F.size("f") == 0, "").otherwise(text).alias("text"))


def capacity_limit(samples: DataFrame, t: str, v: str, capacity: Column) -> DataFrame:
    """One row (limit, peak, on_scale): the line of a full cluster, drawn if it is not far above the greatest sum at one time."""
    sums = samples.groupBy(t).agg(F.sum(F.coalesce(F.col(v), F.lit(0.0))).alias("s"))
    limit = F.when(capacity > 0, capacity * FULL)
    return sums.agg(F.greatest(F.coalesce(F.max("s"), F.lit(0.0)), F.lit(0.0)).alias("peak")).select(limit.alias("limit"), "peak", F.coalesce((F.col("peak") > 0) & (limit <= F.col("peak") * REACH), F.lit(False)).alias("on_scale"))


def readout(samples: DataFrame, t: str, series: str, v: str, at: Column) -> DataFrame:
    """(series, value) of all series at one time; null where one has no sample there."""
    return samples.select(series).distinct().join(samples.where(F.col(t) == at).groupBy(series).agg(F.max(v).alias("value")), series, "left")


def manifest_order(live: DataFrame, by: str, tag: str, item: str) -> DataFrame:
    """Adds place: the order in which a file's live chunks were appended, equal tags by id."""
    return live.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(tag, item)) - 1)


def volume_notes(attached: Column, damaged: Column) -> Column:
    """What a listing says of a volume; a dash for nothing."""
    text = F.array_join(F.array_compact(F.array(F.when(attached, "attached here"), F.when(damaged, "MAP DAMAGED"))), ", ")
    return F.when(text == "", "—").otherwise(text)


def arc(ratio: Column, radius: float, sweep: float) -> Column:
    """Length of the first ``ratio`` of an arc of ``sweep`` degrees, in hundredths."""
    whole = 2 * 3.141592653589793 * max(radius, 0.0) * min(max(sweep, 0.0), 360.0) / 360
    return F.floor(F.lit(whole) * F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5) / 100


def refs_by_id(refs: str = "chunks") -> Column:
    """Array of references (id, ...) as a map; of repeated ids the last counts."""
    last = lambda acc, x: F.concat(F.filter(acc, lambda y: y["id"] != x["id"]), F.array(x))
    kept = F.aggregate(refs, F.filter(F.col(refs), lambda x: F.lit(False)), last)
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["id"].alias("key"), x.alias("value"))))
