"""Leases, logs, reports, retention and restores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import labels as B
from tidemark.operators import backup as K
from tidemark.operators import crdt as C
from tidemark.operators import leases as S
from tidemark.operators import membership as M
from tidemark.operators import reconcile as N
from tidemark.operators import report as R
from tidemark.operators import runs as U
from tidemark.operators import series as T
from tidemark.plans.common import table
from tidemark.sources import extent_log as G


def _requests(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    op = F.when(i % 7 == 0, "acquire").when(i % 7 < 4, "renew").when(i % 7 == 4, "release_at").otherwise(F.when(i % 5 == 0, "release").otherwise("renew"))
    return e.select((F.col("user_id") % 40).alias("volume"), i.alias("seq"), op.alias("op"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("holder"), i.alias("stamp"), (i - F.col("user_id") % 9).alias("at"))


def lease_outcomes(spark, d):
    return S.lease_outcomes(_requests(spark, d)).select("volume", "seq", "outcome", "lease_holder", "lease_stamp")


def current_leases(spark, d):
    return S.current_leases(_requests(spark, d))


_STEP = "CASE WHEN q.op = 'acquire' THEN q.holder WHEN q.op = 'renew' OR f.holder <> q.holder THEN f.holder WHEN q.op = 'release' OR (f.stamp = q.at) THEN '' ELSE f.holder END"
_FOLD = f"""WITH RECURSIVE q AS (SELECT user_id % 40 AS volume, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'acquire' WHEN event_id % 7 < 4 THEN 'renew' WHEN event_id % 7 = 4 THEN 'release_at' WHEN event_id % 5 = 0 THEN 'release' ELSE 'renew' END AS op,
'h' || user_id % 3 AS holder, event_id AS stamp, event_id - user_id % 9 AS at, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS i FROM events),
f AS (SELECT volume, 0::BIGINT AS i, NULL::BIGINT AS seq, '' AS outcome, '' AS holder, NULL::BIGINT AS stamp FROM q GROUP BY 1
UNION ALL SELECT q.volume, q.i, q.seq, CASE WHEN q.op = 'acquire' OR (q.holder = f.holder AND (q.op <> 'release_at' OR q.at = f.stamp)) THEN 'ok' WHEN q.op = 'release_at' THEN 'kept' ELSE 'held' END,
{_STEP}, CASE WHEN q.op = 'acquire' OR (q.op = 'renew' AND q.holder = f.holder) OR {_STEP} <> f.holder THEN q.stamp ELSE f.stamp END FROM f JOIN q ON q.volume = f.volume AND q.i = f.i + 1)"""
LEASE_OUTCOMES = f"{_FOLD} SELECT volume, seq, outcome, holder AS lease_holder, stamp AS lease_stamp FROM f WHERE i > 0"
CURRENT_LEASES = f"{_FOLD} SELECT volume, arg_max(holder, i) AS lease_holder, arg_max(stamp, i) AS lease_stamp FROM f GROUP BY 1"


def log_replay(spark, d):
    """Bindings written to framed logs, replayed and merged: the newest stamp of each index wins."""
    li = table(spark, d, "lineitem")
    entries = li.select(F.col("l_partkey").cast("decimal(20,0)").alias("idx"), F.col("l_orderkey").alias("wall"), F.col("l_linenumber").cast("long").alias("logical"), F.col("l_returnflag").alias("node"), F.format_string("c-%08d", F.col("l_suppkey")).alias("value"))
    stamp = F.struct("wall", "logical", "node", "value")
    return G.replay(G.logs_of(entries)).groupBy(F.col("idx").cast("long").alias("idx")).agg(F.max(stamp).alias("s"), F.count("*").alias("n")).select("idx", "s.wall", "s.logical", "s.node", "s.value", "n")


LOG_REPLAY = """SELECT l_partkey AS idx, s.wall, s.logical, s.node, s.value, n FROM (SELECT l_partkey, max({'wall': l_orderkey, 'logical': l_linenumber::BIGINT, 'node': l_returnflag, 'value': 'c-' || lpad(l_suppkey::VARCHAR, 8, '0')}) AS s, count(*) AS n FROM lineitem GROUP BY 1)"""


def merged_inodes(spark, d):
    side = lambda name, key, a, b, size: table(spark, d, name).select(F.col(key).alias("id"), (F.col(key) % 3).cast("int").alias("type"), F.col(size).cast("long").alias("size"), F.col(a).cast("string").alias("acl"), (F.col(key) % 11).alias("acl_at"), F.col(b).cast("string").alias("lease"), F.when(F.col(key) % 4 > 0, F.col(key) % 5).alias("lease_at"))
    mine = side("customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    theirs = side("part", "p_partkey", "p_name", "p_brand", "p_size").withColumns({"acl_at": F.col("id") % 13, "lease_at": F.when(F.col("id") % 3 > 0, F.col("id") % 7)})
    return C.merged_inodes(mine, theirs)


MERGED_INODES = """
WITH m AS (SELECT c_custkey AS id, (c_custkey % 3)::INTEGER AS type, c_nationkey::BIGINT AS size, c_name AS acl, c_custkey % 11 AS acl_at, c_mktsegment AS lease, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 5 END AS lease_at FROM customer),
t AS (SELECT p_partkey AS id, (p_partkey % 3)::INTEGER AS type, p_size::BIGINT AS size, p_name AS acl, p_partkey % 13 AS acl_at, p_brand AS lease, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 7 END AS lease_at FROM part),
u AS (SELECT *, 0 AS side FROM m UNION ALL SELECT *, 1 FROM t)
SELECT id, arg_min(type, side) AS type, arg_min(size, side) AS size, (max({'at': acl_at, 'side': -side, 'v': acl}) ).v AS acl, max(acl_at) AS acl_at,
coalesce((max({'at': lease_at, 'side': -side, 'v': lease}) FILTER (lease_at IS NOT NULL)).v, arg_min(lease, side)) AS lease, max(lease_at) AS lease_at FROM u GROUP BY 1"""


def _members(spark, d):
    k = F.col("n_nationkey")
    state = F.when(k % 11 == 0, "dead").when(k % 11 == 1, "suspect").when(k % 11 == 2, "left").when(k % 11 == 3, "unknown").otherwise("alive")
    return table(spark, d, "nation").select(F.col("n_name").alias("id"), state.alias("state"), (k % 6 == 0).alias("pressured"), (k * 1000).cast("long").alias("last_change"), F.when(k % 7 == 0, 0).otherwise(1000).cast("long").alias("capacity"), (k * 40).cast("long").alias("used"))


def _skews(spark, d):
    return table(spark, d, "nation").where("n_nationkey % 2 = 1").select(F.col("n_name").alias("peer"), ((F.col("n_nationkey") - 12) * 60).cast("long").alias("skew_ms"))


_ME = "NATION_5"


def node_status(spark, d):
    return R.node_status(_members(spark, d), _skews(spark, d), _ME)


_STATUS = f"""(SELECT n_name AS id, CASE n_nationkey % 11 WHEN 0 THEN 'dead' WHEN 1 THEN 'suspect' WHEN 2 THEN 'left' WHEN 3 THEN 'unknown' ELSE 'alive' END AS state, n_nationkey % 6 = 0 AS pressured, n_nationkey::BIGINT * 1000 AS last_change,
CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1000 END::BIGINT AS capacity, n_nationkey::BIGINT * 40 AS used, CASE WHEN n_nationkey % 2 = 1 AND n_name <> '{_ME}' THEN (n_nationkey - 12)::BIGINT * 60 ELSE 0 END AS skew_ms FROM nation)"""
NODE_STATUS = f"SELECT * FROM {_STATUS}"


def cluster_health(spark, d):
    return R.cluster_health(_members(spark, d), _skews(spark, d), 3)


CLUSTER_HEALTH = f"SELECT count(*) FILTER (state = 'alive')::INTEGER AS alive_nodes, count(*) FILTER (pressured) AS pressured_nodes, (SELECT max(abs(n_nationkey - 12)) * 60 FROM nation WHERE n_nationkey % 2 = 1)::BIGINT AS clock_skew_ms, 3 AS replication_factor FROM {_STATUS}"


def _volumes(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    volumes = s.select(k.alias("inode"), F.concat(F.lit("/v/"), "s_name").alias("path"), (k * 10).cast("long").alias("size"), (k % 50).cast("long").alias("inline_extents"))
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("inode")).agg((F.count("*") % 70).alias("extents")).where("inode % 4 <> 0")
    replicas = s.where(k % 9 != 0).select(k.alias("inode"), F.array(*(F.concat(F.lit("NATION_"), ((k + j * 4) % 25).cast("string")) for j in range(3))).alias("replicas"))
    exports = s.where(k % 3 == 0).select(F.concat(F.when(k % 2 == 0, "/v//").otherwise("v/"), "s_name").alias("name"))
    return R.volume_status(volumes, sizes, replicas, s.where(k % 17 == 0).select(k.alias("inode")), exports)


def volume_status(spark, d):
    return _volumes(spark, d).withColumn("replicas", F.array_join("replicas", ","))


_VOLUMES = """(SELECT s_suppkey AS inode, '/v/' || s_name AS path, s_suppkey::BIGINT * 10 AS size, (s_suppkey % 50)::BIGINT AS inline_extents, greatest(s_suppkey % 50, CASE WHEN s_suppkey % 4 <> 0 THEN coalesce(n, 0) % 70 ELSE 0 END)::BIGINT AS extents_written,
CASE WHEN s_suppkey % 9 <> 0 THEN 'NATION_' || s_suppkey % 25 || ',NATION_' || (s_suppkey + 4) % 25 || ',NATION_' || (s_suppkey + 8) % 25 ELSE '' END AS replicas, s_suppkey % 17 = 0 AS map_damaged, s_suppkey % 3 = 0 AS attached
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
VOLUME_STATUS = f"SELECT * FROM {_VOLUMES}"


def volume_totals(spark, d):
    return R.volume_totals(_volumes(spark, d))


VOLUME_TOTALS = f"SELECT count(*) AS volumes, sum(size)::BIGINT AS provisioned, count(*) FILTER (attached) AS attached, count(*) FILTER (map_damaged) AS damaged FROM {_VOLUMES}"


def degraded_reasons(spark, d):
    return R.degraded_reasons(_volumes(spark, d), _members(spark, d), 3)


_REPLICAS = f"(SELECT path, unnest(string_split(replicas, ',')) AS id FROM {_VOLUMES} WHERE replicas <> '')"
DEGRADED_REASONS = f"""
SELECT path, string_agg('replica on ' || id || ' ' || coalesce(state, 'unknown'), ', ' ORDER BY id) AS reason FROM {_REPLICAS} LEFT JOIN {_STATUS} USING (id) WHERE coalesce(state, '') <> 'alive' GROUP BY 1
UNION ALL SELECT path, '0 of 3 replicas' FROM {_VOLUMES} WHERE replicas = ''"""


def all_findings(spark, d):
    nodes = R.node_status(_members(spark, d), _skews(spark, d), _ME)
    row = lambda values, schema: spark.createDataFrame([values], schema)
    health = R.cluster_health(_members(spark, d), _skews(spark, d), 20).withColumns({"node": F.lit(_ME), "isolated": F.lit(True), "rejoin_attempts": F.lit(2).cast("long")})
    storage = row((1000, 950, 50), "capacity long, used long, available long")
    backup = row((True, False, False, 90000, 93600, None, 3600), "configured boolean, running boolean, run_ok boolean, started long, finished long, next long, interval long")
    gc = row((True, False, "", None, 3600), "enabled boolean, running boolean, error string, last_run long, started long")
    return R.all_findings(nodes, _volumes(spark, d), health, storage, backup, gc, "NATION_7", 3, F.lit(100800))


_LASTED = "CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h' ELSE s // 86400 || ' d' END"
ALL_FINDINGS = f"""
WITH n AS (SELECT *, 100800 - last_change AS s FROM {_STATUS}), a AS (SELECT * FROM n WHERE state <> 'left'), h AS ({CLUSTER_HEALTH}),
v AS (SELECT count(*) FILTER (map_damaged) AS bad, (SELECT count(*) FROM ({DEGRADED_REASONS})) AS low FROM {_VOLUMES}),
f AS (SELECT id, used * 1.0 / capacity AS r FROM a WHERE capacity > 0 UNION ALL SELECT 'NATION_7', 0.95)
SELECT 0 AS rule, 'degraded' AS level, 'Cluster degraded: ' || alive_nodes || ' nodes alive, replication factor 20' AS text FROM h WHERE alive_nodes < 20
UNION ALL SELECT 1, 'degraded', '{_ME} isolated from its peers, 2 rejoin attempts'
UNION ALL SELECT 3, CASE state WHEN 'dead' THEN 'degraded' ELSE 'attention' END, id || CASE state WHEN 'dead' THEN ' down for ' || {_LASTED} WHEN 'suspect' THEN ' suspect for ' || {_LASTED} ELSE ' state unknown' END FROM a WHERE state <> 'alive'
UNION ALL SELECT 4, 'attention', id || ' pressured' FROM a WHERE pressured
UNION ALL SELECT 5, CASE WHEN clock_skew_ms >= 2000 THEN 'degraded' ELSE 'attention' END, 'Clock skew ' || clock_skew_ms || ' ms' FROM h WHERE clock_skew_ms >= 500
UNION ALL SELECT 6, CASE WHEN r >= 0.9 THEN 'degraded' ELSE 'attention' END, id || ' disk ' || floor(r * 100 + 0.5)::BIGINT || '% full' FROM f WHERE r >= 0.8
UNION ALL SELECT 7, 'degraded', bad || CASE WHEN bad = 1 THEN ' volume map damaged' ELSE ' volume maps damaged' END FROM v WHERE bad > 0
UNION ALL SELECT 8, 'attention', low || CASE WHEN low = 1 THEN ' volume degraded' ELSE ' volumes degraded' END FROM v WHERE low > 0
UNION ALL SELECT 9, 'attention', 'Backup failed 2 h ago'
UNION ALL SELECT 10, 'attention', 'GC has not run since start 1 d ago'"""


def _runs(spark, d):
    """Manifests of suppliers' nations, one per supplier, each naming the chunks of its orders' lines."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("chunks"))
    k = F.col("s_suppkey")
    at = F.timestamp_seconds(1_700_000_000 + k * 3600)
    return table(spark, d, "supplier").join(li, k == F.col("k"), "left").select(F.concat(F.lit("n"), (k % 4).cast("string")).alias("node"), at.alias("stamp"), F.concat(F.lit("m"), k.cast("string")).alias("name"), F.lit(True).alias("readable"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


def retention_pass(spark, d):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    at = F.timestamp_seconds(1_700_000_000 + k * 3600)
    runs = table(spark, d, "supplier").select(F.lit("run").alias("kind"), F.concat(F.lit("n"), (k % 4).cast("string")).alias("node"), at.alias("stamp"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("r"), k.cast("string")).alias("name"), at.alias("mtime"))
    chunk = table(spark, d, "part").select(F.lit("chunk").alias("kind"), F.lit("").alias("node"), F.lit(None).cast("timestamp").alias("stamp"), (p * 2).cast("string").alias("id"), F.concat(F.lit("c"), (p * 2).cast("string")).alias("name"), F.when(p % 10 != 0, F.timestamp_seconds(1_700_000_000 + p * 60)).alias("mtime"))
    markers = table(spark, d, "region").select(F.concat(F.lit("n"), F.col("r_regionkey").cast("string")).alias("node"), F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("name"), F.timestamp_seconds(1_700_000_000 + F.col("r_regionkey") * 1000).alias("at"))
    return K.retention_pass(_runs(spark, d), runs.unionByName(chunk), markers, "n1", F.timestamp_seconds(F.lit(1_700_000_000 + 90 * 3600)), 5, 12 * 3600, 24 * 3600)


RETENTION_PASS = """
WITH s AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier WHERE s_suppkey % 4 = 1), g AS (SELECT k FROM s WHERE i > 5 AND k < 78)
SELECT 'manifest' AS kind, 'm' || k AS name, 'beyond retention' AS reason FROM g
UNION ALL SELECT 'run', 'r' || k, 'no manifest of the run' FROM g WHERE k < 66
UNION ALL SELECT 'marker', 'x' || r_regionkey, 'stale run' FROM region WHERE r_regionkey <> 1
UNION ALL SELECT 'chunk', 'c' || p_partkey * 2, 'no manifest names it' FROM part WHERE p_partkey % 10 <> 0 AND p_partkey * 60 < 66 * 3600 AND p_partkey * 2 NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))"""


def restore_plan(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    sha = F.sha2(k.cast("string"), 256)
    manifest = o.select(k.cast("string").alias("name"), (k % 1000).alias("size"), sha.alias("sha256"))
    there = o.where(k % 13 != 0).select(k.cast("string").alias("name"), (k % 1000 + F.when(k % 17 == 0, 1).otherwise(0)).alias("size"), F.when(k % 19 == 0, "x").otherwise(sha).alias("sha256"))
    return K.restore_plan(manifest, there, None)


RESTORE_PLAN = "SELECT o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 17 = 0 THEN 'size' WHEN o_orderkey % 19 = 0 THEN 'checksum' ELSE 'copy' END AS action FROM orders"


def labels(spark, d):
    k = F.col("p_partkey")
    f = lambda x: (x / 10).cast("double")
    words = F.get(F.array(*map(F.lit, ("on", " No", "TRUE", "0", "maybe", ""))), (k % 6).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", B.inode_type(k % 4).alias("inode"), B.valid_thresholds(f(k % 7), f(k % 9), f(k % 12)).alias("valid"), B.hard_exceeded(f(k % 10), F.lit(0.9)).alias("hard"),
        B.new_capacity(k % 3, k % 5, k % 2 == 0, k % 3, k % 4, k % 2 == 0).alias("carries"), B.stale(k, F.lit(1000)).alias("stale"),
        B.single_node(F.when(k % 2 == 0, "SINGLE_NODE_WRITER").otherwise("MULTI_NODE_READER_ONLY")).alias("single"), B.clean_version(F.concat("p_name", F.lit("+x 1"))).alias("version"),
        B.run_stamp(F.concat(F.lit("2024-01-02T03:04:05.67"), (k % 12).cast("string"), F.when(k % 2 == 0, "Z.json").otherwise("Z/f"))).alias("run"),
        B.stamp(F.timestamp_millis(k * 123457)).alias("stamp"), F.unix_millis(B.stamp_time(B.stamp(F.timestamp_millis(k * 123457)))).alias("stamp_ms"), B.prune_grace(k * 100).alias("grace"),
        B.duration(k * 97 - 200).alias("duration"), B.until(k * 97 - 200).alias("until"), B.switch(words).alias("switch"), B.to_int32(k * 3000000 - 100000).alias("int32"),
        B.requested_capacity(k % 3 - 1, k % 5).alias("requested"), B.prefer(F.when(k % 2 == 0, "").otherwise("a"), F.lit("b")).alias("preferred"),
        B.index_of(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>"), k % 5).alias("place"), B.object_key(F.when(k % 2 == 0, "p/").otherwise(""), F.col("p_brand")).alias("key"),
        B.extent_key(F.lit("n"), F.lit("s"), k.cast("string")).alias("extent"), B.summary(k % 3, k % 2, k % 4, F.lit(0)).alias("summary"),
    )


_IN = "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END"
LABELS = f"""
WITH x AS (SELECT p_partkey AS k, p_name, p_brand, p_partkey * 97 - 200 AS s FROM part)
SELECT k AS p_partkey, ['file', 'dir', 'volume', 'file'][k % 4 + 1] AS inode, k % 7 > 0 AND k % 7 < k % 9 AND k % 9 < k % 12 AND k % 12 <= 10 AS valid, k % 10 = 9 AS hard, k % 3 > 0 AND k % 5 <> k % 4 AS carries, k > 1000 AS stale, k % 2 = 0 AS single,
regexp_replace(p_name || '+x 1', '[^A-Za-z0-9.+_-]', '_', 'g')[1:64] AS version, CASE WHEN k % 12 < 10 THEN '2024-01-02T03:04:05.67' || k % 12 || 'Z' ELSE '' END AS run,
strftime(make_timestamp(k * 123457000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, k * 123457 AS stamp_ms, greatest(k * 200, 86400) AS grace, CASE WHEN s <= 0 THEN '0s' ELSE {_IN} END AS duration, CASE WHEN s <= 0 THEN 'due now' ELSE 'in ' || {_IN} END AS until,
[true, false, true, false, NULL, NULL][k % 6 + 1] AS switch, greatest(least(k * 3000000 - 100000, 2147483647), 0)::INTEGER AS int32, CASE WHEN k % 3 = 2 THEN 1 ELSE k % 5 END::BIGINT AS requested, CASE WHEN k % 2 = 0 THEN 'b' ELSE 'a' END AS preferred,
CASE WHEN k % 5 BETWEEN 1 AND 3 THEN k % 5 - 1 ELSE -1 END::INTEGER AS place, CASE WHEN k % 2 = 0 THEN 'p/' ELSE '' END || p_brand AS key, 'extents/n/s/' || k || '.json' AS extent,
CASE WHEN k % 12 = 0 THEN '' ELSE ' — ' || array_to_string(list_filter([CASE WHEN k % 3 > 0 THEN k % 3 || ' alive' END, CASE WHEN k % 2 > 0 THEN k % 2 || ' suspect' END, CASE WHEN k % 4 > 0 THEN k % 4 || ' dead' END], lambda y: y IS NOT NULL), ', ') END AS summary FROM x"""


def panel_rows(spark, d):
    volumes = _volumes(spark, d).withColumn("lease_holder", F.concat(F.lit("H"), (F.col("inode") % 7).cast("string")))
    rates = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("/v/"), "s_name").alias("path"), (F.col("s_suppkey") % 4).cast("double").alias("rate"))
    return R.panel_rows(volumes, _members(spark, d), 3, rates, " h3", None)


PANEL_ROWS = f"""
SELECT path, CASE WHEN map_damaged THEN 2 WHEN reason IS NOT NULL THEN 1 ELSE 0 END AS rank, coalesce(reason, '') AS reason, CASE WHEN inode % 2 = 0 THEN inode % 4 ELSE 0 END::DOUBLE AS rate
FROM {_VOLUMES} LEFT JOIN ({DEGRADED_REASONS}) USING (path) WHERE inode % 7 = 3"""


def storage_gauges(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    disk = table(spark, d, "supplier").agg(F.sum(F.floor("s_acctbal")).alias("capacity"), F.count("*").alias("used"), F.lit(None).cast("long").alias("available"))
    names = {"capacity_bytes": ("capacity", "gauge", "Bytes."), "used_bytes": ("used", "gauge", "Used."), "available_bytes": ("available", "gauge", "Free."), "chunks": ("chunks", "gauge", "Chunks.")}
    return R.gauges(R.storage_status(part, disk), "storage", names, {"node": "n1"}).withColumn("labels", F.to_json("labels"))


STORAGE_GAUGES = """
WITH g(name, help, value) AS (SELECT 'storage_capacity_bytes', 'Bytes.', sum(floor(s_acctbal)) FROM supplier UNION ALL SELECT 'storage_used_bytes', 'Used.', count(*) FROM supplier UNION ALL SELECT 'storage_available_bytes', 'Free.', 0 UNION ALL SELECT 'storage_chunks', 'Chunks.', count(*) FROM part)
SELECT name, 'gauge' AS kind, help, '{"node":"n1"}' AS labels, value::DOUBLE AS value FROM g"""


def histogram_lines(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"c{i}") for i, b in enumerate((1.5, 50.0))), F.count("*").alias("count"), F.sum(F.floor("value")).cast("double").alias("sum"))
    return R.histogram_lines(e.select(F.col("event_type").alias("name"), F.when(F.col("event_type") < "m", 'node="a"').otherwise("").alias("labels"), F.array(F.lit(1.5), F.lit(50.0), F.lit(float("inf"))).alias("bounds"), F.array("c0", "c1", "count").alias("counts"), "sum", "count"))


HISTOGRAM_LINES = """
WITH e AS (SELECT event_type AS name, CASE WHEN event_type < 'm' THEN 'node="a"' ELSE '' END AS tag, count(*) FILTER (value <= 1.5) AS a, count(*) FILTER (value <= 50) AS b, count(*) AS n, sum(floor(value))::BIGINT AS s FROM events GROUP BY 1),
l AS (SELECT name, unnest(range(5))::INTEGER AS position, CASE WHEN tag = '' THEN '' ELSE tag || ',' END AS t, CASE WHEN tag = '' THEN '' ELSE '{' || tag || '}' END AS p, a, b, n, s FROM e)
SELECT name, position, CASE position WHEN 0 THEN name || '_bucket{' || t || 'le="1.5"} ' || a WHEN 1 THEN name || '_bucket{' || t || 'le="50"} ' || b WHEN 2 THEN name || '_bucket{' || t || 'le="+Inf"} ' || n WHEN 3 THEN name || '_sum' || p || ' ' || s ELSE name || '_count' || p || ' ' || n END AS line FROM l"""


def scrub_plan(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return N.scrub_plan(part, table(spark, d, "lineitem").where("l_suppkey % 5 = 0").select(F.col("l_partkey").alias("id")), False)


SCRUB_PLAN = "SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 5 = 0) THEN 'heal' ELSE 'skip' END AS action FROM part"


def scrub_all(spark, d):
    """An incomplete view heals everything."""
    return N.scrub_plan(table(spark, d, "part").select(F.col("p_partkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), True)


SCRUB_ALL = "SELECT p_partkey AS id, 'heal' AS action FROM part"


def current_replicas(spark, d):
    li = table(spark, d, "lineitem")
    probes = li.groupBy(F.col("l_suppkey").alias("volume"), F.col("l_returnflag").alias("node"), F.col("l_linenumber").alias("attempt")).agg((F.count("*") % 7 != 0).alias("known"), (F.count("*") % 9 == 0).alias("same"))
    covers = li.groupBy(F.col("l_suppkey").alias("volume"), F.col("l_returnflag").alias("node")).agg((F.sum("l_orderkey") % 2 == 0).alias("covers")).where("volume % 3 > 0")
    return N.current_replicas(probes, covers)


CURRENT_REPLICAS = """
WITH p AS (SELECT l_suppkey AS volume, l_returnflag AS node, l_linenumber AS attempt, count(*) % 7 <> 0 AS known, count(*) % 9 = 0 AS same FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT volume, node, arg_min(known, attempt) AS first, arg_max(known, attempt) AS last, bool_or(known AND same) AS met FROM p GROUP BY 1, 2),
c AS (SELECT l_suppkey AS volume, l_returnflag AS node, sum(l_orderkey) % 2 = 0 AS covers FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1, 2)
SELECT volume, node, first AND (met OR (last AND coalesce(covers, false))) AS current FROM a LEFT JOIN c USING (volume, node)"""


def copied_map(spark, d):
    maps = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("volume"), F.col("l_orderkey").alias("idx")).agg(F.max("l_partkey").alias("chunk"))
    return N.copied_map(maps, "R", "copy")


COPIED_MAP = "SELECT 'copy' AS volume, l_orderkey AS idx, max(l_partkey) AS chunk FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2"


def known_volumes(spark, d):
    return N.known_volumes(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("volume")), table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("volume")))


KNOWN_VOLUMES = "SELECT l_suppkey AS volume FROM lineitem UNION SELECT o_custkey * 2 FROM orders"


def _messages(spark, d):
    i = F.col("event_id")
    events = F.array(*(F.struct(F.concat(F.lit("n"), ((i + j) % 30).cast("string")).alias("node"), ((i * (j + 1)) % 3).cast("int").alias("state"), (i % 100 + j).alias("incarnation")) for j in range(3)))
    return table(spark, d, "events").select(i.alias("id"), F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("user_id") % 30).cast("string"))).alias("sender"), (i % 5).cast("int").alias("proto"), (i % 50).alias("incarnation"), events.alias("events"))


def admitted_events(spark, d):
    got, _ = M.admitted(_messages(spark, d), "n7", 3, 2)
    return got.groupBy("node", "state").agg(F.count("*").alias("n"), F.max("incarnation").alias("incarnation"))


_SENT = "(SELECT event_id AS i, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'n' || user_id % 30 END AS sender, CASE event_id % 5 WHEN 0 THEN 1 ELSE event_id % 5 END AS proto FROM events)"
ADMITTED_EVENTS = f"""
WITH m AS (SELECT * FROM {_SENT} WHERE sender <> 'n7' AND proto >= 2),
e AS (SELECT 'n' || (i + j) % 30 AS node, ((i * (j + 1)) % 3)::INTEGER AS state, i % 100 + j AS incarnation FROM m, range(3) r(j) UNION ALL SELECT sender, 0, i % 50 FROM m WHERE sender <> '')
SELECT node, state, count(*) AS n, max(incarnation) AS incarnation FROM e GROUP BY 1, 2"""


def message_verdicts(spark, d):
    return M.admitted(_messages(spark, d), "n7", 3, 2)[1].groupBy("verdict").agg(F.count("*").alias("n"))


MESSAGE_VERDICTS = f"SELECT CASE WHEN sender = 'n7' THEN 'impersonation' WHEN proto < 2 THEN 'too-old' WHEN proto > 3 THEN 'newer' ELSE 'compatible' END AS verdict, count(*) AS n FROM {_SENT} GROUP BY 1"


def ring_signature(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 3).cast("int").alias("state"), (F.col("n_nationkey") % 4).cast("int").alias("weight"))
    return M.ring_signature(M.with_self(n, "NATION_1"))


RING_SIGNATURE = "SELECT string_agg(n_name || CASE WHEN n_nationkey % 4 > 1 THEN ':' || n_nationkey % 4 ELSE '' END || ',', '' ORDER BY n_name) AS signature FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey = 1"


def _history(spark, d):
    i = F.col("event_id")
    t = i * 60
    return table(spark, d, "events").select((F.col("user_id") % 25).alias("node"), i.alias("seq"), (i % 4 != 0).alias("ok"), t.alias("started"), (t + i % 50).alias("finished"), (i % 9).alias("uploaded"), (i % 5).alias("skipped"), (i % 1000).alias("bytes"), (i % 77).alias("chunks"), F.when(i % 11 == 0, float("nan")).otherwise(i % 40).cast("double").alias("v"))


_HISTORY = "(SELECT user_id % 25 AS node, event_id AS seq, event_id % 4 <> 0 AS ok, event_id * 60 AS started, event_id * 60 + event_id % 50 AS finished, event_id % 9 AS uploaded, event_id % 5 AS skipped, event_id % 1000 AS bytes, event_id % 77 AS chunks, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 40 END::DOUBLE AS v FROM events)"


def run_totals(spark, d):
    return U.run_totals(_history(spark, d), "node")


RUN_TOTALS = f"""SELECT node, count(*) AS runs, count(*) FILTER (NOT ok) AS failures, coalesce(sum(uploaded) FILTER (ok), 0)::BIGINT AS uploaded, coalesce(sum(skipped) FILTER (ok), 0)::BIGINT AS skipped, coalesce(sum(bytes) FILTER (ok), 0)::BIGINT AS bytes,
arg_max(finished - started, seq) AS last_duration, arg_max(ok, seq) AS last_ok, arg_max(chunks, seq) FILTER (ok) AS last_chunks, max(finished) FILTER (ok) AS last_success FROM {_HISTORY} GROUP BY 1"""


def run_bars(spark, d):
    return U.run_bars(_history(spark, d), "node", "seq", "v").select("node", "seq", F.round("bar", 6).alias("bar"))


RUN_BARS = f"SELECT node, seq, round(greatest(v / greatest(max(v) OVER (PARTITION BY node), CASE WHEN max(v) OVER (PARTITION BY node) > 0 THEN 0 ELSE 1 END) * 56, 2), 6) AS bar FROM {_HISTORY}"


def latest_ok(spark, d):
    return U.latest_ok(_history(spark, d), "node", "seq")


LATEST_OK = f"SELECT node, coalesce(max(i) FILTER (ok), -1)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) - 1 AS i FROM {_HISTORY}) GROUP BY 1"


def earlier_failures(spark, d):
    shown = _history(spark, d).withColumn("__i", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("seq")))).where("__i <= 12").drop("__i")
    runs = shown.select("node", "seq", F.when(F.col("ok"), "ok").otherwise("failed").alias("outcome"), F.timestamp_seconds("started").alias("at"))
    return U.earlier_failures(runs, "node", "seq", "at")


EARLIER_FAILURES = f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS i FROM {_HISTORY} QUALIFY i <= 12),
g AS (SELECT node, count(*) AS n, count(*) FILTER (NOT ok AND i > 1) AS k, string_agg(strftime(make_timestamp(started * 1000000), '%H:%M'), ', ' ORDER BY seq) FILTER (NOT ok AND i > 1) AS t FROM s GROUP BY 1)
SELECT node, CASE WHEN k = 0 THEN '' ELSE k || ' of ' || n || ' runs failed, at ' || t || '.' END AS text FROM g"""


def capacity_limit(spark, d):
    return U.capacity_limit(_history(spark, d).where("not isnan(v)").withColumn("t", F.col("seq") % 100), "t", "v", F.lit(5000.0))


CAPACITY_LIMIT = f"SELECT 4000.0::DOUBLE AS \"limit\", max(s) AS peak, 4000 <= max(s) * 2 AS on_scale FROM (SELECT seq % 100 AS t, sum(v) FILTER (seq % 11 <> 0) AS s FROM {_HISTORY} GROUP BY 1)"


def readout(spark, d):
    return U.readout(_history(spark, d).withColumn("t", F.col("seq") % 1000).withColumn("n", F.col("chunks")), "t", "node", "n", F.lit(77))


READOUT = f"SELECT node, max(chunks) FILTER (seq % 1000 = 77) AS value FROM {_HISTORY} GROUP BY 1"


def manifest_order(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("chunk")).agg(F.min("l_linenumber").alias("tag"))
    return U.manifest_order(li, "file", "tag", "chunk")


MANIFEST_ORDER = "SELECT l_orderkey AS file, l_partkey AS chunk, min(l_linenumber) AS tag, (row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) - 1)::INTEGER AS place FROM lineitem GROUP BY 1, 2"


def display_rules(spark, d):
    k = F.col("s_suppkey")
    refs = F.array(*(F.struct(((k + j) % 2).alias("id"), (k * j).alias("size")) for j in range(3)))
    s = table(spark, d, "supplier").withColumn("chunks", refs)
    return s.select("s_suppkey", U.volume_notes(k % 2 == 0, k % 3 == 0).alias("notes"), U.arc(k / 80.0, 10.0, 270.0).alias("arc"), U.refs_by_id("chunks")[k % 2]["size"].alias("size"))


DISPLAY_RULES = """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'attached here, MAP DAMAGED' WHEN s_suppkey % 2 = 0 THEN 'attached here' WHEN s_suppkey % 3 = 0 THEN 'MAP DAMAGED' ELSE '—' END AS notes,
floor(2 * 3.141592653589793::DOUBLE * 10 * 270 / 360 * least(s_suppkey / 80.0::DOUBLE, 1) * 100 + 0.5::DOUBLE) / 100 AS arc, s_suppkey * 2 AS size FROM supplier"""


def history_tiers(spark, d):
    """Two grains of history; SQL has the fold in tests."""
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "value")
    return T.two_tiers(e.groupBy("node", "t").agg(F.max("value").alias("value")), "node", "t", (3600, 100), (14400, 60)).select("node", "t", "tier")


_KEEP = "SELECT node, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT {0}.node, (SELECT min(e.t) FROM e WHERE e.node = {0}.node AND e.t >= {0}.t + {1}) FROM {0} WHERE {0}.t IS NOT NULL"
HISTORY_TIERS = f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id % 10 AS node, epoch_us(ts) // 1000000 AS t FROM events), a AS ({_KEEP.format('a', 3600)}), b AS ({_KEEP.format('b', 14400)}),
f AS (SELECT node, t FROM a WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY t DESC) <= 100),
c AS (SELECT node, t FROM b WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY t DESC) <= 60)
SELECT node, t, 'fine' AS tier FROM f UNION ALL SELECT c.node, c.t, 'coarse' FROM c JOIN (SELECT node, min(t) AS s FROM f GROUP BY 1) m USING (node) WHERE c.t < m.s"""
