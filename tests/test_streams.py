"""Streaming twins on files that arrive in parts, against the batch form."""

import collections

from pyspark.sql import functions as F

from tidemark.plans.common import table
from tidemark.streaming import state as S


def arriving(spark, events, path, parts=3):
    events.repartitionByRange(parts, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, sink, path):
    stream.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def test_upserted_table_of_a_stream(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value").limit(500)
    stream = arriving(spark, events, str(tmp_path / "in"))
    path = str(tmp_path / "table")
    sink = S.upsert(path, ["user_id"], "value", "event_id")
    epochs = []
    run(stream, lambda batch, epoch: (epochs.append(epoch), sink(batch, epoch)), str(tmp_path))
    assert len(epochs) > 1
    want = {}
    for r in sorted(events.collect(), key=lambda r: r["event_id"]):
        want[r["user_id"]] = (r["value"], r["event_id"])
    read = lambda p: {r["user_id"]: (r["value"], r["event_id"]) for r in S.upserted(spark, p, ["user_id"], "value", "event_id").collect()}
    assert read(path) == want
    sink(events.where("event_id < 100"), epochs[-1] + 7)  # older rows after a gap change nothing
    sink(events.where("event_id < 100"), epochs[-1] + 7)
    assert read(path) == want
    S.compacted(spark, path, str(tmp_path / "next"), ["user_id"], "value", "event_id")
    assert read(str(tmp_path / "next")) == want


def test_buckets_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = S.bucket_stream(events, "ts", "value", "6 hours", "1 hour", "event_type")
    want = {(r["event_type"], r["bucket_end"]): (round(r["mean"], 6), r["n"]) for r in batch.collect()}
    stream = S.bucket_stream(arriving(spark, events, str(tmp_path / "in"), 1), "ts", "value", "6 hours", "1 hour", "event_type")
    got = collections.OrderedDict()
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
    query.foreachBatch(lambda df, _: got.update({(r["event_type"], r["bucket_end"]): (round(r["mean"], 6), r["n"]) for r in df.collect()})).start().awaitTermination()
    assert got and all(want[k] == v for k, v in got.items())  # the last buckets stay open until the watermark passes them
    assert len(want) - len(got) <= 3 * len({k for k, _ in want})
