"""Streaming twins: one run to its end as a stream, the others over a finished table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.hashing import hlc
from tidemark.plans.common import micros, table
from tidemark.sources.shared import shared_dir
from tidemark.streaming import state as S


def _finished(stream, schema_of):
    """Result table of a stream in complete mode, written by each micro-batch to the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/table")).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema_of).parquet(f"{path}/table")


def stream_latest(spark, d):
    """Last-writer-wins map per user from a file stream."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a glob: the source takes a single file only so
    latest = S.lww_stream(events, ["user_id"], "value", hlc(micros("ts"), F.lit(0), F.col("event_type"))).select("user_id", "value", F.col("ts.node").alias("node"))
    return _finished(latest, latest.schema)


STREAM_LATEST = "SELECT user_id, value, event_type AS node FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) = 1"


def event_buckets(spark, d):
    """Six-hour means per event type; the same function takes a stream."""
    got = S.bucket_stream(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "6 hours", "1 hour", "event_type")
    return got.select("event_type", F.unix_seconds("bucket_end").alias("bucket_end"), F.round("mean", 6).alias("mean"), "n")


EVENT_BUCKETS = "SELECT event_type, (epoch_us(ts) // 21600000000 + 1) * 21600 AS bucket_end, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2"


def heartbeat_runs(spark, d):
    """Runs of a user's events with gaps under six hours; the same function takes a stream."""
    got = S.run_sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return got.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "beats")


HEARTBEAT_RUNS = """
WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM g)
SELECT user_id, min(t) AS started, max(t) + 21600000000 AS ended, count(*) AS beats FROM r GROUP BY user_id, run"""
