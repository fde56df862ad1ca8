"""Logs, leases, retention and decoding on small cases."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions.units import plain_number
from tidemark.operators import backup as K
from tidemark.operators import crdt as C
from tidemark.operators import leases as S
from tidemark.operators import report as R
from tidemark.plans import files as file_plans
from tidemark.sources import catalog
from tidemark.sources import extent_log as G
from tidemark.sources.shared import shared_dir

ENTRY = (2**64 - 1, -5, 7, "nœud", "c1")


def test_logs_tell_torn_tails_from_damage(spark):
    a, b = G.framed([ENTRY, (1, 2, 3, "n", "")]), G.framed([(9, 9, 9, "n", "v")])
    bad = bytearray(a)
    bad[-1] ^= 1
    body = bytes([2]) + b"\0\0\0\0"
    newer = G.FRAME.pack(len(body), __import__("zlib").crc32(body)) + body
    logs = {"whole": a + b, "torn": a + b[:-1], "header": a + b[:5], "zeroes": a + bytes(500), "crc": a + bytes(bad) + b, "version": b + newer, "empty": b"", "null": None}
    df = spark.createDataFrame(list(logs.items()), "name string, content binary")
    states = {r["name"]: (r["records"], r["torn"], r["error"]) for r in G.log_states(df).collect()}
    assert states["whole"] == (2, False, None) and states["torn"] == states["header"] == states["zeroes"] == (1, True, None)
    assert states["crc"][0] == 1 and "checksum" in states["crc"][2] and states["version"][0] == 1 and "malformed" in states["version"][2]
    assert states["empty"] == states["null"] == (0, False, None)
    rows = G.replay(df.where("name = 'whole'")).orderBy("record", "idx").collect()
    assert [(int(r["idx"]), r["wall"], r["logical"], r["node"], r["value"]) for r in rows] == [(1, 2, 3, "n", ""), ENTRY, (9, 9, 9, "n", "v")]
    assert G.replay(df.limit(0)).count() == 0


def test_logs_that_are_written_replay(spark):
    rows = [(i, i * 3, i % 4, f"n{i % 3}", f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "idx long, wall long, logical long, node string, value string").repartition(3)
    got = G.replay(G.logs_of(df)).collect()
    assert sorted((int(r["idx"]), r["wall"], r["logical"], r["node"], r["value"]) for r in got) == rows


def test_leases_equal_a_plain_fold(spark):
    rng = random.Random(3)
    data = [(v, i, rng.choice(["acquire", "renew", "renew", "release", "release_at"]), rng.choice(["a", "b", ""]), 100 + i, 100 + i - rng.randint(1, 3)) for v in range(30) for i in range(25)]
    want, state = {}, {}
    for v, i, op, who, stamp, at in data:
        who_has, since = state.get(v, ("", None))
        mine = who_has != "" and who == who_has
        if op == "acquire":
            out, now = "ok", (who, stamp)
        elif op == "renew":
            out, now = ("ok", (who, stamp)) if mine else ("held", (who_has, since))
        elif op == "release":
            out, now = ("ok", ("", stamp)) if mine else ("held", (who_has, since))
        else:
            out, now = ("ok", ("", stamp)) if mine and at == since else ("kept", (who_has, since))
        state[v] = now
        want[v, i] = (out, *now)
    df = spark.createDataFrame(data, "volume long, seq long, op string, holder string, stamp long, at long")
    got = {(r["volume"], r["seq"]): (r["outcome"], r["lease_holder"], r["lease_stamp"]) for r in S.lease_outcomes(df).collect()}
    assert got == want
    last = {r["volume"]: (r["lease_holder"], r["lease_stamp"]) for r in S.current_leases(df).collect()}
    assert last == state
    late = S.idle(S.current_leases(df), F.lit(1000), 100)
    assert late.count() == sum(h != "" for h, _ in state.values())


def test_retention_refuses(spark):
    at = "timestamp '2024-01-0{}'".format
    manifests = spark.sql(f"select * from values ('a', {at(1)}, 'm1', true, array('c1')), ('a', {at(2)}, 'm2', true, array('c2')), ('b', {at(1)}, 'm3', true, array('c3')) as t(node, stamp, name, readable, chunks)")
    objects = spark.sql(f"select * from values ('run', 'a', {at(1)}, null, 'r1', {at(1)}), ('run', 'b', {at(5)}, null, 'r2', {at(1)}), ('chunk', '', null, 'c1', 'k1', {at(1)}), ('chunk', '', null, 'c9', 'k9', {at(1)}), ('chunk', '', null, 'c8', 'k8', null) as t(kind, node, stamp, id, name, mtime)")
    none = spark.createDataFrame([], "node string, name string, at timestamp")
    now = F.lit("2024-01-09").cast("timestamp")
    run = lambda m=manifests, marks=none, **more: {(r["kind"], r["name"]) for r in K.retention_pass(m, objects, marks, "a", now, 1, 0, 86400, **more).collect()}
    assert run() == {("manifest", "m1"), ("run", "r1"), ("chunk", "k9")}
    assert run(manifests.withColumn("readable", F.col("name") != "m3")) == {("manifest", "m1"), ("run", "r1"), ("refused", "")}
    busy = spark.sql("select 'b' as node, 'x' as name, timestamp '2024-01-08 23:30:00' as at")
    assert run(marks=busy) == {("manifest", "m1"), ("run", "r1"), ("refused", "")}
    assert run(marks=busy.withColumn("at", F.lit("2024-01-08").cast("timestamp"))) == {("manifest", "m1"), ("run", "r1"), ("marker", "x"), ("chunk", "k9")}
    assert run(current="m7") == {("refused", "")}
    assert ("refused", "") in run(manifests.limit(0))


def test_restore_needs_space(spark):
    m = spark.createDataFrame([("a", 5, "x"), ("b", 7, "y")], "name string, size long, sha256 string")
    plan = lambda room: {r["name"]: r["action"] for r in K.restore_plan(m, m.where("name = 'a'"), room, 1).collect()}
    assert plan(13) == plan(None) == {"a": "copy", "b": "missing"} and plan(12) == {"a": "no space", "b": "no space"}


def test_inodes_decode_by_type(spark):
    wire = spark.createDataFrame([("d", 1, "c", "m", "e", "l"), ("v", 2, "c", "m", "e", "l"), ("f", 0, "c", "m", "e", "l"), ("odd", 99, "c", "m", "e", "l")], "id string, type int, children string, manifest string, extents string, lease string")
    got = {r["id"]: tuple(r)[2:] for r in C.decoded_inodes(wire).collect()}
    assert got == {"d": ("c", None, None, None), "v": (None, None, "e", "l"), "f": (None, "m", None, None), "odd": (None, "m", None, None)}


def test_histogram_lines_write_plain_digits(spark):
    df = spark.sql("select 'h' name, 'node=\"a\"' labels, array(0.0005d, 1.5d, 2.0e7d, double('Infinity')) bounds, array(1L, 2L, 3L, 4L) counts, 61234567d sum, 4L count")
    lines = [r["line"] for r in R.histogram_lines(df).orderBy("position").collect()]
    assert lines == ['h_bucket{node="a",le="0.0005"} 1', 'h_bucket{node="a",le="1.5"} 2', 'h_bucket{node="a",le="20000000"} 3', 'h_bucket{node="a",le="+Inf"} 4', 'h_sum{node="a"} 61234567', 'h_count{node="a"} 4']


def test_plain_numbers(spark):
    want = {0.0: "0", -3.0: "-3", 0.25: "0.25", -0.0001: "-0.0001", 12345678.5: "12345678.5", 1e7: "10000000", 1e22: "10000000000000000000000", 1e-5: "1.0E-5", float("inf"): "Infinity"}
    df = spark.createDataFrame([(v,) for v in want], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == list(want.values())
    assert [tuple(r) for r in spark.sql("select double('NaN') v, double(null) w").select(plain_number(F.col("v")), plain_number(F.col("w"))).collect()] == [("NaN", None)]


def test_files_of_manifests_follow_the_tasks(spark, tmp_path):
    spark.range(300).selectExpr("id l_suppkey", "explode(array(2 * id, 2 * id + 1)) l_partkey", "double(id + 1) l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    folders = lambda: set(Path(shared_dir(spark)).glob("manifests-*"))
    old = folders()
    got = {r["stamp"]: tuple(r)[2:] for r in file_plans.manifest_files(spark, str(tmp_path)).collect()}
    assert got == {str(i): (2, 2 * (i + 1), True) for i in range(300)}
    (root,) = folders() - old
    files = list(root.rglob("*.txt"))
    assert len(files) <= 5 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    files[0].with_name("cut.txt").write_text('{"format":1,"node":"n1","chunks":[{"id":"1"')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        catalog.manifests(spark, str(root), lines=True).collect()


def test_manifests_of_a_file_each_and_of_a_line_each_read_alike(spark, tmp_path):
    rows = spark.sql("select 1 format, 'n' || id node, 's' || id stamp, array(named_struct('id', 'ö\\n' || id, 'size', id)) chunks from range(20)")
    catalog.write_manifests(rows, str(tmp_path / "lines"))
    (tmp_path / "files").mkdir()
    for i, text in enumerate(rows.toJSON().collect()):
        (tmp_path / "files" / f"{i}.json").write_text(text.replace(',"', ',\n"'), encoding="utf-8")
    a = catalog.manifests(spark, str(tmp_path / "lines"), lines=True).drop("key").collect()
    b = catalog.manifests(spark, str(tmp_path / "files")).drop("key").collect()
    assert len(a) == 20 and sorted(a, key=str) == sorted(b, key=str)
