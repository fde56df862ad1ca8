"""Streaming twins of the replicated-state operators.

Merges are commutative and idempotent, so late and repeated rows need no
watermark: LWW maps and tombstones are plain streaming aggregations. The
membership fold keeps arbitrary state per node, with a processing-time timer
that turns suspects into dead nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.membership import Member, folded

SUSPECT_MS = 30_000
_OUT = "id string, state int, incarnation long, address string, capacity long, used long, pressured boolean, changed_seq long, changes long"
_STATE = "state int, incarnation long, address string, capacity long, used long, pressured boolean, changed_seq long, changes long"


def lww_stream(rows: DataFrame, keys: list[str], value: str, ts: Column) -> DataFrame:
    """Streaming LWW map; write it in update mode to follow changes or in complete mode for the map."""
    return rows.groupBy(*keys).agg(F.max(F.struct(ts.alias("ts"), F.col(value).alias("v"))).alias("w")).select(*keys, F.col("w.v").alias(value), F.col("w.ts").alias("ts"))


def tombstone_stream(rows: DataFrame, elem: str, tag: str, at: str) -> DataFrame:
    """Latest removal of each tag."""
    return rows.groupBy(elem, tag).agg(F.max(at).alias(at))


def bucket_stream(rows: DataFrame, t: str, v: str, width: str, late: str, by: str) -> DataFrame:
    """Tumbling means with a watermark: rows later than ``late`` are dropped, closed buckets leave the state."""
    return rows.withWatermark(t, late).groupBy(F.window(t, width), by).agg(F.avg(v).alias("mean"), F.count("*").alias("n")).select(by, F.col("window.end").alias("bucket_end"), "mean", "n")


def run_sessions(rows: DataFrame, t: str, by: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs of heartbeats: a run ends when none comes for ``gap``."""
    return rows.withWatermark(t, late).groupBy(F.session_window(t, gap), by).agg(F.count("*").alias("beats")).select(by, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "beats")


def member_stream(events: DataFrame, local: str | None = None, suspect_ms: int = SUSPECT_MS, timers: bool = True) -> DataFrame:
    """Changed members after each micro-batch; a node that stays suspect for ``suspect_ms`` is reported dead."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur = Member(*state.get) if state.exists else None
        was = cur
        if state.hasTimedOut:
            if cur is not None and cur.state == 1:
                cur = cur._replace(state=2, changes=cur.changes + 1)
        else:
            for ev in pd.concat(list(parts)).sort_values("seq").itertuples():
                cur = folded(cur, ev, ev.id == local)
        if cur is None:
            return
        state.update(tuple(cur))
        if timers and cur.state == 1:
            state.setTimeoutDuration(suspect_ms)
        if cur != was:
            yield pd.DataFrame([(key[0], *cur)], columns=[c.split()[0] for c in _OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return events.where("id <> ''").groupBy("id").applyInPandasWithState(run, _OUT, _STATE, "update", timeout)


def upsert(path: str, keys: list[str], value: str, ts: str):
    """foreachBatch sink of a last-writer-wins table: each micro-batch writes what is newest in it, under its epoch.

    Nothing that is there is read or rewritten, so a batch costs what it holds;
    an epoch that runs again replaces its own rows. ``upserted`` merges on reading.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        _newest(batch, keys, value, ts).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def _newest(rows: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """Newest value of each key; of equal stamps the greater value."""
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).alias("w")).select(*keys, F.col("w.v").alias(value), F.col("w.t").alias(ts))


def upserted(spark: SparkSession, path: str, keys: list[str], value: str, ts: str) -> DataFrame:
    """The table that ``upsert`` keeps at ``path``: epochs merged, in whatever order they came and with gaps between them."""
    return _newest(spark.read.parquet(path).drop("epoch"), keys, value, ts)


def compacted(spark: SparkSession, path: str, to: str, keys: list[str], value: str, ts: str) -> None:
    """Write the merged table as epoch 0 of another path; readers and the sink move there, and the old one can go."""
    upserted(spark, path, keys, value, ts).write.parquet(f"{to}/epoch=0")
