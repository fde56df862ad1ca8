"""Ordered folds, scalar fixtures and streams against plain Python."""


import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, units
from tidemark.operators import clocks, crdt, health, membership, namespace, ring, series
from tidemark.plans import scalars as scalar_plans
from tidemark.plans import series as series_plans
from tidemark.plans import state as state_plans
from tidemark.sources import catalog as sources
from tidemark.streaming import state as streams


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fnv_known_values(spark):
    df = spark.createDataFrame([("chunk-1",), ("node-a#0",), ("é",), ("",), (None,)], "s string")
    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = ((h ^ b) * 1099511628211) % 2**64
        return h
    got = [None if r[0] is None else int(r[0]) for r in df.select(hashing.unsigned(hashing.fnv1a64(F.col("s")))).collect()]
    assert got == [fnv("chunk-1"), fnv("node-a#0"), fnv("é"), fnv(""), None]
    assert got[0] == 16541630581881420324


def test_hlc_order(spark):
    h = lambda w, l, n: hashing.hlc(F.lit(w), F.lit(l), F.lit(n))
    pairs = [((1, 0, ""), (2, 0, "")), ((1, 1, ""), (1, 2, "")), ((1, 1, "a"), (1, 1, "b")), ((3, 3, "c"), (3, 3, "c"))]
    got = spark.range(1).select(*(hashing.hlc_compare(h(*a), h(*b)) for a, b in pairs)).first()
    assert tuple(got) == (-1, -1, -1, 0)


def test_clock_fold_cases(spark):
    ev = [("n", i, p, r, l) for i, (p, r, l) in enumerate([(1000, None, None), (1000, 9000, 5)])]
    ev += [("m", i, p, r, l) for i, (p, r, l) in enumerate([(5000, None, None), (5000, 5000, 3)])]
    ev += [("o", i, p, r, l) for i, (p, r, l) in enumerate([(9000, None, None), (9500, 2000, 7)])]
    ev += [("q", i, 1000, None, None) for i in range(6)]
    df = spark.createDataFrame(ev, "node string, seq long, phys long, r_wall long, r_logical long")
    got = {(r[0], r[1]): (r[2], r[3]) for r in clocks.clock_fold(df).collect()}
    assert got[("n", 1)] == (9000, 6) and got[("m", 1)] == (5000, 4) and got[("o", 1)] == (9500, 0)
    assert [got[("q", i)] for i in range(6)] == [(1000, i) for i in range(6)]


def test_membership_rules(spark):
    c = "id string, seq long, state int, incarnation long, address string, capacity long, used long, pressured boolean"
    ev = [("a", 1, 2, 1, "x", 0, 0, False), ("b", 1, 0, 1, "x", 10, 1, False), ("b", 2, 1, 1, "", 0, 0, True), ("b", 3, 0, 1, "y", 0, 0, False), ("b", 4, 1, 1, "", 20, 2, True),
          ("me", 1, 0, 1, "z", 0, 0, False), ("me", 2, 2, 4, "", 0, 0, False), ("", 1, 0, 1, "q", 0, 0, False)]
    got = {r["id"]: r.asDict() for r in membership.fold_events(spark.createDataFrame(ev, c), "me").collect()}
    assert set(got) == {"b", "me"}
    assert (got["b"]["state"], got["b"]["address"], got["b"]["capacity"], got["b"]["pressured"]) == (1, "x", 20, True)
    assert (got["me"]["state"], got["me"]["incarnation"]) == (0, 5)
    assert membership.fold_events(spark.createDataFrame([], c)).count() == 0


def test_membership_fold_equals_plain_fold(spark, sf_dir):
    ev = state_plans._changes(spark, sf_dir).toPandas().sort_values("seq")
    want = {}
    for e in ev.itertuples():
        m = membership.folded(want.get(e.id), e)
        if m is not None:
            want[e.id] = m
    got = {r["id"]: tuple(r)[1:] for r in state_plans.member_fold(spark, sf_dir).collect()}
    assert got == {k: tuple(v) for k, v in want.items()}


def test_skew_alerts_equal_plain_fold(spark, sf_dir):
    s = state_plans._skews(spark, sf_dir).toPandas().sort_values(["t", "peer"])
    want, last = [], {}
    for r in s.itertuples():
        if r.skew_ms > 500 and r.t - last.get(r.observer, -10**12) >= 6 * 3600:
            last[r.observer] = r.t
            want.append((r.observer, r.peer, r.t, r.skew_ms))
    assert rows(state_plans.skew_alerts(spark, sf_dir)) == sorted(want)


def test_down_sampling_equals_plain_fold(spark, sf_dir):
    e = series_plans._events(spark, sf_dir).select("event_id", "user_id", "t").toPandas().sort_values("t")
    last, want = {}, []
    for r in e.itertuples():
        if r.user_id not in last or r.t - last[r.user_id] >= 7200:
            last[r.user_id] = r.t
            want.append(r.event_id)
    assert sorted(r["event_id"] for r in series_plans.down_sampled(spark, sf_dir).collect()) == sorted(want)


def test_orset_add_wins_and_live_tag(spark):
    adds = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2)], "elem string, tag long")
    tombs = crdt.orset_remove(adds, spark.createDataFrame([("x", 2), ("y", 100), ("z", 5)], "elem string, at long"))
    assert rows(crdt.orset_elements(adds, tombs)) == [("x", 3)]
    a, t, n = crdt.orset_gc(adds, tombs, F.lit(2))
    assert (a.count(), t.count(), n.first()[0]) == (2, 1, 1)


@pytest.mark.parametrize("pressured, n, want", [(["A"], 3, ["B", "C", "D"]), (["A", "B"], 3, ["C", "A", "D"]), (["A", "B", "C", "D", "E"], 3, ["A", "B", "C"]), ([], 2, ["A", "B"]), (["A"], 0, [])])
def test_steering(spark, pressured, n, want):
    df = spark.createDataFrame([(list("ABCDE"), pressured)], "o array<string>, p array<string>")
    assert df.select(ring.steer(F.col("o"), n, F.col("p"))).first()[0] == want


def test_weights(spark):
    df = spark.createDataFrame([("small", 1000), ("big", 4000), ("mid", 2000), ("huge", 2**40), ("none", 0)], "node string, capacity long")
    assert dict(ring.capacity_weights(df).select("node", "weight").collect()) == {"small": 1, "big": 4, "mid": 2, "huge": 16, "none": 1}


def test_ring_grows_and_skips_empty_names(spark):
    nodes = lambda *x: spark.createDataFrame([(n,) for n in x], "node string")
    assert rows(ring.ring_points(nodes("b", "a", "", "a", "b")).select("node").distinct()) == [("a",), ("b",)]
    keys = spark.range(2000).select(F.concat(F.lit("chunk-"), "id").alias("key"))
    three = dict(ring.replicas(keys, "key", ring.ring_points(nodes("a", "b", "c")), 1).select("key", F.col("replicas")[0]).collect())
    four = dict(ring.replicas(keys, "key", ring.ring_points(nodes("a", "b", "c", "d")), 1).select("key", F.col("replicas")[0]).collect())
    assert 0 < sum(three[k] != four[k] for k in three) <= 0.4 * len(three)


def test_series_fixtures(spark):
    s = spark.createDataFrame([("s", t, v) for t, v in [(-1, 99.0), (0, 2.0), (10, 4.0), (30, 8.0), (40, 6.0), (41, 99.0), (35, float("nan"))]], "k string, t long, v double")
    got = series.bucket_means(s, "k", "t", "v", 40, 40, 4).orderBy("bucket_end").collect()
    assert [(r["bucket_end"], r["mean"]) for r in got] == [(10, 2.0), (20, 4.0), (30, None), (40, 7.0)]
    r = lambda *x: series.last_rate(spark.createDataFrame([("s", t, float(v)) for t, v in x], "k string, t long, v double"), "k", "t", "v").first()["rate"]
    assert r((0, 0), (1000, 10), (3000, 30)) == 10 and r((0, 100), (1000, 3)) is None and r((0, 5)) is None
    h = spark.createDataFrame([("s", v) for v in (0.005, 0.05, 0.05, 0.5, 5.0)], "k string, v double")
    assert [x["cumulative"] for x in series.histogram(h, "k", "v", (0.01, 0.1, 1.0)).collect()] == [1, 3, 4, 5]
    t = spark.createDataFrame([("a", 0, 0.0), ("a", 1000, 3.0), ("a", 2000, 2.0), ("a", 3000, 5.0), ("b", 0, 10.0), ("b", 1000, 12.0), ("b", 2000, 14.0), ("c", 0, 1.0)], "k string, t long, v double")
    got = {x["k"]: (round(x["slope"], 6), x["seconds_until"]) for x in series.linear_trend(t, "k", "t", "v", 20.0).collect()}
    assert got["a"][0] == 1.4 and got["b"] == (2.0, 3.0) and got["c"] == (0.0, None)
    y = spark.createDataFrame([("s", i, v) for i, v in enumerate((0.84, 0.86, 0.82, 0.80, 0.82))], "k string, t int, v double")
    assert [x["on"] for x in series.hysteresis(y, "k", "t", "v", 0.85, 0.80).orderBy("t").collect()] == [False, True, True, False, False]


def test_name_conflict_keeps_greater_inode(spark):
    df = spark.createDataFrame([("d", "f", "aaa"), ("d", "f", "zzz")], "dir string, name string, inode string").withColumn("tag", hashing.hlc(F.lit(100), F.lit(0), F.lit("x")))
    assert dict(namespace.resolved_children(df).select("inode", "display").collect()) == {"zzz": "f", "aaa": "f.conflict-100.0.x"}


def test_byte_formats(spark):
    df = spark.createDataFrame([(0,), (512,), (7_500_000,), (32_212_254_720,), (-5,)], "n long")
    assert [r[0] for r in df.select(units.format_bytes(F.col("n"))).collect()] == ["0 B", "512 B", "7.2 MiB", "30 GiB", "0 B"]
    assert [r[0] for r in df.select(units.humanize_bytes(F.col("n"))).collect()][1:4] == ["512 B", "7.2 MiB", "30.0 GiB"]


def test_healthy_cluster_has_no_findings(spark):
    nodes = spark.createDataFrame([("a", "alive", False, 0, 100, 10)], "id string, state string, pressured boolean, skew_ms long, capacity long, used long")
    found = health.node_findings(nodes)
    assert found.count() == 0 and health.worst_level(found).first()[0] == "healthy"


def test_sources(spark, tmp_path):
    (tmp_path / "a.chunk").write_bytes(b"x" * 100)
    (tmp_path / "b.tmp").write_bytes(b"y")
    assert [(r["id"], r["plain_bytes"]) for r in sources.chunk_catalog(spark, str(tmp_path)).collect()] == [("a", 4)]
    assert sources.read_capped(spark, str(tmp_path), 50).select("name").collect()[0][0] == "b.tmp"
    text = tmp_path / "log"
    text.mkdir()
    (text / "x.json").write_text('{"id": "1", "v": 2}\n{"id": broken\n')
    good, bad = sources.entries_with_damage(spark, str(text), "id string, v int")
    assert good.count() == 1 and bad.count() == 1


def _stream(spark, path, batches, schema):
    path.mkdir()
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(path / f"b{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streaming_lww_is_order_independent(spark, tmp_path):
    data = [("k", 1, "old"), ("k", 5, "new"), ("j", 2, "one")]
    out = []
    for n, order in enumerate((data, data[::-1])):
        src = _stream(spark, tmp_path / f"s{n}", [[r] for r in order], "k string, ts long, v string")
        q = streams.lww_stream(src, ["k"], "v", F.col("ts")).writeStream.outputMode("complete").format("memory").queryName(f"lww{n}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        assert q.awaitTermination(120)
        out.append(rows(spark.table(f"lww{n}").select("k", "v")))
    assert out[0] == out[1] == [("j", "one"), ("k", "new")]


def test_streaming_membership_equals_batch(spark, tmp_path):
    c = "id string, seq long, state int, incarnation long, address string, capacity long, used long, pressured boolean"
    ev = [[("b", 1, 0, 1, "x", 10, 1, False), ("c", 1, 0, 1, "y", 0, 0, False)], [("b", 2, 1, 1, "", 0, 0, False)], [("c", 2, 2, 3, "", 0, 0, False), ("a", 1, 3, 1, "", 0, 0, False)]]
    src = _stream(spark, tmp_path / "m", ev, c)
    q = streams.member_stream(src, timers=False).writeStream.outputMode("update").format("memory").queryName("members").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cm")).start()
    assert q.awaitTermination(180)
    last = spark.table("members").groupBy("id").agg(F.max_by("state", "changes").alias("state"))
    batch = membership.fold_events(spark.createDataFrame([e for b in ev for e in b], c)).select("id", "state")
    assert rows(last) == rows(batch)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t long, v double")
    assert series.fill_gaps(none, "k", "t", "v").count() == 0
    assert series.histogram(none, "k", "v", (1.0,)).count() == 0
    assert crdt.lww_merge(none, ["k"], "v", F.col("t")).count() == 0


def test_down_sampling_keeps_all_rows_of_a_kept_time(spark):
    df = spark.createDataFrame([(0, "a", 10), (1, "a", 10), (2, "a", 12), (3, "a", 15), (4, "a", 15), (5, "a", 19), (6, "b", 11)], "i long, k string, t long")
    assert sorted(r["i"] for r in series.down_sample(df, "k", "t", 5).collect()) == [0, 1, 3, 4, 6]


def test_latest_skew_takes_the_first_of_one_time(spark):
    data = [("a", 9, 3, 30), ("a", 9, 1, 10), ("a", 9, 2, 20), ("a", 5, 0, 50), ("b", 9, 1, None), ("b", 8, 2, 7), ("c", 3, 1, 1)]
    for rows_ in (data, data[::-1]):
        df = spark.createDataFrame(rows_, "peer string, t long, seq long, skew_ms long").coalesce(1)
        assert rows(clocks.latest_skew(df, F.lit(10), 5)) == [("a", 10, 9), ("b", 7, 9)]


def test_formats_name_units_beyond_tebibytes(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (3, 104031, 104032, 1048576, 9_000_000)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: (r["unit"], r["count"]) for r in scalar_plans.formats(spark, str(tmp_path)).collect()}
    assert got == {3: ("B", "27"), 104031: ("TiB", "1,125,870,187,861,791"), 104032: ("PiB", "1,125,902,655,520,768"), 1048576: ("EiB", "1,152,921,504,606,846,976"), 9_000_000: ("EiB", "729,000,000,000,000,000,000")}
