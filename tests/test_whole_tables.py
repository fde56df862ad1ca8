"""Queries cover whole tables: against brute force in plain Python."""

import bisect
import collections

import pandas as pd
import pyarrow as pa
import pytest

from tidemark.functions.hashing import fnv1a64_batch
from tidemark.operators import ring as R
from tidemark.plans import catalog


def fnv(s):
    h = 14695981039346656037
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) % 2**64
    return h


def query(spark, d, name):
    return catalog.QUERIES[name](spark, d).toPandas()


def steered(order, bad):
    natural, rest = order[:3], order[3:]
    chosen = [n for n in natural if n not in bad]
    chosen += [n for n in natural if n in bad][: max(0, 2 - len(chosen))]
    chosen = (chosen + [n for n in rest if n not in bad])[:3]
    return (chosen + [n for n in order if n not in chosen])[:3]


@pytest.fixture(scope="module")
def orders_of_nodes(sf_dir):
    """Nodes of every order in ring order."""
    names = pd.read_parquet(f"{sf_dir}/nation.parquet").n_name
    points = sorted((fnv(f"{n}#{v}"), n) for n in names for v in range(128))
    hashes = [h for h, _ in points]
    out = {}
    for k in pd.read_parquet(f"{sf_dir}/orders.parquet").o_orderkey:
        at = bisect.bisect_left(hashes, fnv(f"chunk-{k}"))
        out[int(k)] = list(dict.fromkeys(n for _, n in points[at:] + points[:at]))
    return out


def test_ring_queries_place_every_order(spark, sf_dir, orders_of_nodes):
    want = orders_of_nodes
    got = query(spark, sf_dir, "key_hash")
    assert dict(zip(got.o_orderkey, map(int, got["hash"]), strict=True)) == {k: fnv(f"chunk-{k}") for k in want}
    first = {(k, i, n) for k, order in want.items() for i, n in enumerate(order[:3])}
    got = query(spark, sf_dir, "ring_replicas")
    assert len(got) == len(first) and set(zip(got.o_orderkey, got.place, got.node, strict=True)) == first
    got = query(spark, sf_dir, "ring_load")
    assert dict(zip(got.node, got.primaries, strict=True)) == collections.Counter(order[0] for order in want.values())
    bad = {f"NATION_{i}" for i in range(0, 25, 2)}
    got = query(spark, sf_dir, "steered_replicas")
    assert set(zip(got.o_orderkey, got.place, got.node, strict=True)) == {(k, i, n) for k, order in want.items() for i, n in enumerate(steered(order, bad))}
    short = set()
    for k, order in want.items():
        has = [(k + i * 5) % 7 != 0 and k % 64 != 1 for i in range(3)]
        short |= {(k, i, order[i], next((n for n, h in zip(order, has, strict=False) if h), None)) for i in range(3) if not has[i]}
    got = query(spark, sf_dir, "replica_shortfall")
    assert {(k, p, n, None if pd.isna(x) else x) for k, p, n, x in zip(got.id, got.place, got.node, got.leader, strict=True)} == short


def test_tokens_of_all_events(spark, sf_dir):
    best = {}
    for e in pd.read_parquet(f"{sf_dir}/events.parquet").itertuples():
        if e.event_type != "error" and (e.event_id % 4 == 0 or 3000 < e.event_id * 10):
            best[e.event_id % 90] = max(best.get(e.event_id % 90, -1), e.event_id)
    want = {(f"s{k}", best[k], best[k] % 2 == 0) for k in pd.read_parquet(f"{sf_dir}/supplier.parquet").s_suppkey if k in best}
    got = query(spark, sf_dir, "token_redeem")
    assert set(zip(got.secret, got.ordinal, got.consumes, strict=True)) == want
    assert max(best.values()) >= 400


def test_authorization_of_all_orders(spark, sf_dir):
    caps = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
    want = {o.o_orderkey: o.o_orderpriority in caps and (o.o_custkey % 7 == 0 or o.o_custkey % 3 == caps[o.o_orderpriority]) for o in pd.read_parquet(f"{sf_dir}/orders.parquet").itertuples()}
    got = query(spark, sf_dir, "call_authorization")
    assert len(got) == len(want) and dict(zip(got.o_orderkey, got.allowed, strict=True)) == want


def test_digest_and_clock_order_of_all_lines(spark, sf_dir):
    lines = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    newest = {}
    for x in lines[lines.l_suppkey % 3 != 0].itertuples():
        key = (x.l_orderkey, x.l_linenumber)
        newest[key] = max(newest.get(key, ()), (x.l_shipdate, x.l_partkey, str(x.l_suppkey), int(x.l_quantity)))
    want = {}
    for (key, volume), x in newest.items():
        digest, n = want.get(volume, (0x5110000000000001, 0))
        want[volume] = (digest ^ fnv(f"{key}|{x[3]}"), n + 1)
    got = query(spark, sf_dir, "map_digest")
    assert {v: (int(x), n) for v, x, n in zip(got.volume, got.digest, got.mapped, strict=True)} == want
    got = query(spark, sf_dir, "hlc_order")
    counts = collections.Counter()
    for x in lines.itertuples():
        a, b = (x.l_partkey % 5, x.l_suppkey % 3, x.l_returnflag), (x.l_orderkey % 5, x.l_linenumber % 3, x.l_linestatus)
        counts[((a > b) - (a < b), False, ".".join(map(str, b)))] += 1
    assert {(o, z, t): n for o, z, t, n in zip(got.order, got.zero, got.text, got.n, strict=True)} == counts


def test_splits_of_all_writes(spark, sf_dir):
    want = collections.Counter()
    for x in pd.read_parquet(f"{sf_dir}/lineitem.parquet").itertuples():
        start, end = x.l_partkey * 1777, x.l_partkey * 1777 + int(x.l_quantity * 400)
        for i in range(start // 4096, -(-end // 4096)):
            begin, stop = max(start, i * 4096), min(end, (i + 1) * 4096)
            want[(x.l_suppkey % 20, x.l_orderkey, x.l_linenumber, start, i, begin - i * 4096, stop - begin, stop - begin == 4096)] += 1
    got = query(spark, sf_dir, "write_split")
    assert collections.Counter(got[["volume", "w", "n_line", "offset", "idx", "begin", "n", "whole"]].itertuples(index=False, name=None)) == want


def test_resampling_of_all_events(spark, sf_dir):
    now, span, n = 1706745600, 2592000, 60
    events = pd.read_parquet(f"{sf_dir}/events.parquet")
    sums, kinds = collections.defaultdict(list), set(events.event_type)
    for kind, ts, value in zip(events.event_type, events.ts, events.value, strict=True):
        t = ts.value // 10**9
        if now - span <= t <= now:
            sums[(kind, min((t - now + span) // (span // n), n - 1))].append(value)
    want = {}
    for kind in kinds:
        means = [sum(x) / len(x) if (x := sums.get((kind, i))) else None for i in range(n)]
        known = [m for m in means if m is not None]
        for i in range(n):
            before = [m for m in means[: i + 1] if m is not None]
            want[(kind, now - span + (i + 1) * (span // n))] = before[-1] if before else known[0] if known else None
    got = query(spark, sf_dir, "resampled")
    assert {(k, t): m for k, t, m in zip(got.event_type, got.bucket_end, got["mean"], strict=True)} == pytest.approx(want, abs=1e-5)


def test_hashes_of_a_batch_and_keys_without_text(spark):
    texts = ["", "a", "é€", "x" * 3000, None, "chunk-1", "a\x00", "chunk-10"]
    want = [fnv(t or "") for t in texts]
    assert fnv1a64_batch(pa.array(texts)).tolist() == want and fnv1a64_batch(pa.array(["q", *texts]).slice(1)).tolist() == want and fnv1a64_batch(pa.array([], pa.string())).tolist() == []
    points = R.ring_points(spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string"))
    keys = [(i, t) for i, t in enumerate(texts)]
    got = {r["i"]: r["replicas"] for r in R.replicas(spark.createDataFrame(keys, "i int, key string").coalesce(1), "key", points, 2).collect()}
    ring = sorted((r["hash"] % 2**64, r["node"]) for r in points.collect())
    for i, t in keys:
        at = bisect.bisect_left([h for h, _ in ring], want[i])
        assert got[i] == (None if t is None else list(dict.fromkeys(n for _, n in ring[at:] + ring[:at]))[:2])
    assert R.replicas(spark.createDataFrame([("k",)], "key string"), "key", points.limit(0), 2).first()["replicas"] == []


def test_replicas_that_are_exploded_are_walked_once(spark, sf_dir):
    plan = catalog.QUERIES["ring_replicas"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_shortfall_moves_each_input_once(spark):
    expected = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["c"]), (4, []), (5, ["a", "b"])], "id long, replicas array<string>")
    held = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (2, "b"), (2, "c"), (5, None), (9, "a")], "id long, node string")
    got = R.shortfall(expected, held, "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, 0, "a", "b"), (1, 2, "c", "b"), (3, 0, "c", None), (5, 0, "a", None), (5, 1, "b", None)]
