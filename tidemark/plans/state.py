"""Clocks, leases, membership, namespaces, health and extents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import hlc
from tidemark.operators import clocks as K
from tidemark.operators import extents as E
from tidemark.operators import health as H
from tidemark.operators import membership as M
from tidemark.operators import namespace as N
from tidemark.plans.common import micros, table
from tidemark.sources import catalog as S

# ---- clocks and leases --------------------------------------------------


def clock_ticks(spark, d):
    readings = table(spark, d, "events").withColumn("phys", F.floor(micros("ts") / 3600000000) - F.col("event_id") % 5)
    return K.clock_ticks(readings, "user_id", F.col("ts"), F.col("phys")).select("event_id", F.col("wall").cast("long").alias("wall"), F.col("logical").cast("long").alias("logical"))


CLOCK_TICKS = """
WITH w AS (SELECT event_id, user_id, ts, max(epoch_us(ts) // 3600000000 - event_id % 5) OVER (PARTITION BY user_id ORDER BY ts) AS wall FROM events)
SELECT event_id, wall::BIGINT AS wall, row_number() OVER (PARTITION BY user_id, wall ORDER BY ts) - 1 AS logical FROM w"""


def clock_fold(spark, d):
    """An ordered fold per node."""
    e = table(spark, d, "events")
    remote = F.col("event_type") == "click"
    return K.clock_fold(e.select(F.col("user_id").cast("string").alias("node"), F.col("event_id").alias("seq"), F.floor(micros("ts") / 3600000000).alias("phys"), F.when(remote, F.floor(micros("ts") / 3600000000) + F.col("event_id") % 3 - 1).alias("r_wall"), F.when(remote, F.col("event_id") % 10).alias("r_logical")))


CLOCK_FOLD = """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS node, event_id AS seq, epoch_us(ts) // 3600000000 AS phys, event_type = 'click' AS remote, epoch_us(ts) // 3600000000 + event_id % 3 - 1 AS r_wall, event_id % 10 AS r_logical, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT node, 0::BIGINT AS i, NULL::BIGINT AS seq, 0::BIGINT AS wall, 0::BIGINT AS logical FROM e GROUP BY 1
UNION ALL SELECT e.node, e.i, e.seq, greatest(f.wall, e.phys, CASE WHEN remote THEN r_wall ELSE 0 END),
CASE WHEN remote AND r_wall = f.wall AND f.wall >= e.phys THEN greatest(f.logical, r_logical) + 1 WHEN f.wall >= greatest(e.phys, CASE WHEN remote THEN r_wall ELSE 0 END) THEN f.logical + 1 WHEN remote AND r_wall >= greatest(f.wall, e.phys) THEN r_logical + 1 ELSE 0 END
FROM f JOIN e ON e.node = f.node AND e.i = f.i + 1)
SELECT node, seq, wall, logical FROM f WHERE i > 0"""


def _skews(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("observer"), F.col("user_id").cast("string").alias("peer"), F.floor(micros("ts") / 1000000).cast("long").alias("t"), F.col("event_id").alias("seq"), (F.col("value") * 10 - 500).cast("long").alias("skew_ms"))


def peer_skew(spark, d):
    return K.latest_skew(_skews(spark, d), F.lit(1706659200), 86400)


PEER_SKEW = """
WITH s AS (SELECT user_id::VARCHAR AS peer, epoch_us(ts) // 1000000 AS t, trunc(value * 10 - 500)::BIGINT AS skew_ms FROM events)
SELECT peer, arg_max(skew_ms, t) AS skew_ms, max(t) AS t FROM s GROUP BY 1 HAVING max(t) >= 1706659200 - 86400"""


def skew_alerts(spark, d):
    """A rate-limited fold per observer."""
    return K.skew_alerts(_skews(spark, d), 500, 6 * 3600)


SKEW_ALERTS = """
WITH RECURSIVE s AS (SELECT event_type AS observer, user_id::VARCHAR AS peer, epoch_us(ts) // 1000000 AS t, trunc(value * 10 - 500)::BIGINT AS skew_ms FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY observer ORDER BY t, peer) AS i FROM s WHERE skew_ms > 500),
a AS (SELECT observer, 1::BIGINT AS i FROM o GROUP BY 1 UNION ALL SELECT a.observer, (SELECT min(n.i) FROM o n, o h WHERE h.observer = a.observer AND h.i = a.i AND n.observer = a.observer AND n.t >= h.t + 21600) FROM a WHERE a.i IS NOT NULL)
SELECT observer, peer, t, skew_ms FROM o JOIN a USING (observer, i)"""


def lease_intervals(spark, d):
    leases = table(spark, d, "events").where("event_type = 'signup'").withColumn("volume", F.col("user_id") % 10)
    return K.lease_intervals(leases, "volume", "ts", "user_id").select("volume", "user_id", "from_ts", "until_ts")


LEASE_INTERVALS = "SELECT user_id % 10 AS volume, user_id, ts AS from_ts, lead(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS until_ts FROM events WHERE event_type = 'signup'"


def fenced_writes(spark, d):
    e = table(spark, d, "events").withColumn("volume", F.col("user_id") % 10)
    writes = e.where("event_type = 'click'").select("volume", "ts", "event_id", F.col("user_id").alias("writer"))
    leases = e.where("event_type = 'signup'").select("volume", "ts", F.col("user_id").alias("holder"))
    return K.fenced(writes, leases, "volume", "ts", "writer", "holder").select("event_id", "writer", "admitted")


FENCED_WRITES = """
SELECT w.event_id, w.user_id AS writer, coalesce(l.user_id = w.user_id, false) AS admitted
FROM (SELECT *, user_id % 10 AS volume FROM events WHERE event_type = 'click') w
ASOF LEFT JOIN (SELECT *, user_id % 10 AS volume FROM events WHERE event_type = 'signup') l ON w.volume = l.volume AND w.ts >= l.ts"""

# ---- membership ---------------------------------------------------------


def _changes(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).cast("int").alias("state"), F.floor(F.col("event_id") / 997).cast("long").alias("incarnation"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string"))).alias("address"),
        F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.floor("value") * 1000).cast("long").alias("capacity"), F.floor(F.col("value") * 10).cast("long").alias("used"), (F.col("event_type") == "error").alias("pressured"),
    )


def member_fold(spark, d):
    """An ordered fold per node, held against a brute-force fold in the tests."""
    return M.fold_events(_changes(spark, d))


def member_claims(spark, d):
    return M.latest_claims(_changes(spark, d))


MEMBER_CLAIMS = """
WITH c AS (SELECT 'node-' || user_id AS id, (event_id % 4)::INTEGER AS state, event_id // 997 AS incarnation FROM events)
SELECT id, incarnation, state FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY incarnation DESC, state DESC) = 1"""


def _members(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_name").alias("id"), (F.col("s_suppkey") % 3).cast("int").alias("state"), (F.col("s_suppkey") * 100).alias("changed_at"),
        F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(10000).cast("long").alias("capacity"), F.floor(F.abs("s_acctbal")).cast("long").alias("used"))


def member_states(spark, d):
    return M.state_counts(_members(spark, d))


MEMBER_STATES = "SELECT label, count(s_suppkey) AS n FROM (VALUES (0, 'alive'), (1, 'suspect'), (2, 'dead'), (3, 'left')) v(state, label) LEFT JOIN supplier ON s_suppkey % 3 = state GROUP BY 1"


def member_prune(spark, d):
    return M.prune(_members(spark, d), F.lit(5000), "SUPPLIER_2").select("id", "state")


MEMBER_PRUNE = "SELECT s_name AS id, (s_suppkey % 3)::INTEGER AS state FROM supplier WHERE NOT (s_suppkey % 3 >= 2 AND s_suppkey * 100 < 5000) OR s_name = 'SUPPLIER_2'"


def alive_peers(spark, d):
    return M.alive_peers(_members(spark, d), "SUPPLIER_3").select("id")


ALIVE_PEERS = "SELECT s_name AS id FROM supplier WHERE s_suppkey % 3 = 0 AND s_name <> 'SUPPLIER_3'"


def capacity_skew(spark, d):
    return M.capacity_skew(_members(spark, d)).select(F.round("skew", 9).alias("skew"))


CAPACITY_SKEW = "SELECT round(max(u) - min(u), 9) AS skew FROM (SELECT floor(abs(s_acctbal)) / 10000 AS u FROM supplier WHERE s_suppkey % 5 <> 0)"

# ---- namespaces ---------------------------------------------------------


def _claims(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("dir-"), (F.col("p_size") % 5).cast("string")).alias("dir"), F.concat(F.col("p_brand"), F.lit("-"), (F.col("p_partkey") % 7).cast("string")).alias("name"), F.concat(F.lit("inode-"), F.col("p_partkey").cast("string")).alias("inode"), hlc(F.col("p_size"), F.col("p_partkey") % 3, F.lit("n")).alias("tag"))


def resolved_names(spark, d):
    return N.resolved_children(_claims(spark, d)).select("dir", "name", "inode", "display")


_CLAIMS = "(SELECT 'dir-' || (p_size % 5) AS dir, p_brand || '-' || (p_partkey % 7) AS name, 'inode-' || p_partkey AS inode, p_size AS wall, p_partkey % 3 AS logical FROM part)"
RESOLVED_NAMES = f"""
SELECT dir, name, inode, CASE WHEN row_number() OVER (PARTITION BY dir, name ORDER BY wall DESC, logical DESC, inode DESC) = 1 THEN name ELSE name || '.conflict-' || wall || '.' || logical || '.n' END AS display FROM {_CLAIMS}"""


def primary_names(spark, d):
    return N.primary_children(_claims(spark, d))


PRIMARY_NAMES = f"SELECT dir, name, inode FROM {_CLAIMS} QUALIFY row_number() OVER (PARTITION BY dir, name ORDER BY wall DESC, logical DESC, inode DESC) = 1"


def directory_listing(spark, d):
    return N.listing(_claims(spark, d), "dir-2").select("display", "inode")


DIRECTORY_LISTING = f"SELECT display, inode FROM ({RESOLVED_NAMES}) WHERE dir = 'dir-2'"


def _edges(spark, d):
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    return (
        region.where("r_regionkey <> 4").select(F.lit("root").alias("parent"), key("r", "r_regionkey").alias("child"), F.col("r_name").alias("name"))
        .union(nation.select(key("r", "n_regionkey"), key("n", "n_nationkey"), "n_name")).union(customer.select(key("n", "c_nationkey"), key("c", "c_custkey"), "c_name"))
        .union(nation.where("n_nationkey = 1").select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("loop")))
    )


_EDGES = """(SELECT 'root' AS parent, 'r-' || r_regionkey AS child, r_name AS name FROM region WHERE r_regionkey <> 4
UNION ALL SELECT 'r-' || n_regionkey, 'n-' || n_nationkey, n_name FROM nation UNION ALL SELECT 'n-' || c_nationkey, 'c-' || c_custkey, c_name FROM customer
UNION ALL SELECT 'n-' || n_nationkey, 'r-' || n_regionkey, 'loop' FROM nation WHERE n_nationkey = 1)"""


def tree_paths(spark, d):
    return N.paths(_edges(spark, d), "root")


TREE_PATHS = f"""
WITH RECURSIVE e AS {_EDGES}, w(node, path, depth, chain) AS (
SELECT child, '/' || name, 1, [parent, child] FROM e WHERE parent = 'root'
UNION ALL SELECT e.child, w.path || '/' || e.name, w.depth + 1, list_append(w.chain, e.child) FROM w JOIN e ON e.parent = w.node WHERE NOT list_contains(w.chain, e.child))
SELECT node, path, depth FROM w"""


def _reached(spark, d):
    return N.closure(_edges(spark, d), spark.createDataFrame([("root",)], "node string"))


def tree_closure(spark, d):
    return _reached(spark, d)


_CLOSURE = f"(WITH RECURSIVE e AS {_EDGES}, w(node, depth) AS (SELECT 'root', 0 UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node WHERE w.depth < 6) SELECT node, min(depth) AS depth FROM w GROUP BY 1)"
TREE_CLOSURE = f"SELECT node, depth FROM {_CLOSURE}"


def unreachable_inodes(spark, d):
    inodes = table(spark, d, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("inode"))
    return N.unreachable(inodes, _reached(spark, d))


UNREACHABLE_INODES = f"SELECT 'c-' || c_custkey AS inode FROM customer WHERE 'c-' || c_custkey NOT IN (SELECT node FROM {_CLOSURE})"


def live_chunk_refs(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("inode"), F.concat(F.lit("k-"), (F.col("o_orderkey") % 5000).cast("string")).alias("chunk_id"), "o_orderstatus")
    extents = o.where("o_orderstatus <> 'F'").withColumn("chunk_id", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("chunk_id")))
    return N.live_refs(_reached(spark, d), o.where("o_orderstatus = 'F'"), extents)


LIVE_CHUNK_REFS = f"SELECT DISTINCT 'k-' || (o_orderkey % 5000) AS chunk_id FROM orders WHERE o_orderstatus <> 'P' AND 'c-' || o_custkey IN (SELECT node FROM {_CLOSURE})"

# ---- health -------------------------------------------------------------


def _nodes(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    state = F.when(k % 11 == 0, "dead").when(k % 11 == 1, "suspect").when(k % 11 == 2, "left").when(k % 11 == 3, "unknown").otherwise("alive")
    return n.select(F.col("n_name").alias("id"), state.alias("state"), (k % 6 == 0).alias("pressured"), ((k - 12) * 60).cast("long").alias("skew_ms"), F.when(k % 7 == 0, 0).otherwise(1000).cast("long").alias("capacity"), (k * 40).cast("long").alias("used"))


_NODES = """(SELECT n_name AS id, CASE n_nationkey % 11 WHEN 0 THEN 'dead' WHEN 1 THEN 'suspect' WHEN 2 THEN 'left' WHEN 3 THEN 'unknown' ELSE 'alive' END AS state,
n_nationkey % 6 = 0 AS pressured, (n_nationkey - 12) * 60 AS skew_ms, CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1000 END AS capacity, n_nationkey * 40 AS used FROM nation)"""


def node_findings(spark, d):
    return H.node_findings(_nodes(spark, d))


_FINDINGS = f"""(WITH n AS (SELECT * FROM {_NODES}), a AS (SELECT * FROM n WHERE state <> 'left'), m AS (SELECT max(abs(skew_ms)) AS ms FROM n)
SELECT 2 AS rule, 'attention' AS level, 'No nodes' AS text WHERE NOT EXISTS (SELECT 1 FROM a)
UNION ALL SELECT 3, CASE state WHEN 'dead' THEN 'degraded' ELSE 'attention' END, id || CASE state WHEN 'dead' THEN ' down' WHEN 'suspect' THEN ' suspect' ELSE ' state unknown' END FROM a WHERE state <> 'alive'
UNION ALL SELECT 4, 'attention', id || ' pressured' FROM a WHERE pressured
UNION ALL SELECT 5, CASE WHEN ms >= 2000 THEN 'degraded' ELSE 'attention' END, 'Clock skew ' || format('{{:,}}', ms) || ' ms' FROM m WHERE ms >= 500
UNION ALL SELECT 6, CASE WHEN used * 1.0 / capacity >= 0.9 THEN 'degraded' ELSE 'attention' END, id || ' disk ' || floor(used * 100.0 / capacity + 0.5)::BIGINT || '% full' FROM a WHERE capacity > 0 AND used * 10 >= capacity * 8)"""
NODE_FINDINGS = f"SELECT rule, level, text FROM {_FINDINGS}"


def cluster_level(spark, d):
    return H.worst_level(node_findings(spark, d))


CLUSTER_LEVEL = f"SELECT CASE max(CASE level WHEN 'degraded' THEN 2 ELSE 1 END) WHEN 2 THEN 'degraded' WHEN 1 THEN 'attention' ELSE 'healthy' END AS level FROM {_FINDINGS}"


def node_summary(spark, d):
    return H.node_summary(_nodes(spark, d))


NODE_SUMMARY = f"""SELECT count(*) FILTER (state <> 'left') AS total, count(*) FILTER (state = 'alive') AS up, count(*) FILTER (state = 'suspect') AS suspect, count(*) FILTER (state = 'dead') AS down,
sum(capacity) FILTER (state <> 'left' AND capacity > 0)::BIGINT AS capacity, sum(used) FILTER (state <> 'left' AND capacity > 0)::BIGINT AS used FROM {_NODES}"""


def _volumes(spark, d):
    s = table(spark, d, "supplier")
    r = [F.concat(F.lit("NATION_"), ((F.col("s_suppkey") * m) % 26).cast("string")) for m in (1, 3, 7)]
    return s.select(F.concat(F.lit("/"), "s_name").alias("path"), F.when(F.col("s_suppkey") % 10 == 0, F.array(*r[:2])).otherwise(F.array(*r)).alias("replicas"), (F.col("s_suppkey") % 33 == 0).alias("map_damaged"))


def volume_health(spark, d):
    return H.degraded_volumes(_volumes(spark, d), _nodes(spark, d), 3).select("path", "degraded")


VOLUME_HEALTH = f"""
WITH x AS (SELECT s_suppkey, s_name, bool_or(coalesce(n.state, '') <> 'alive') FILTER (NOT (s_suppkey % 10 = 0 AND m = 7)) AS bad
FROM supplier CROSS JOIN (VALUES (1), (3), (7)) v(m) LEFT JOIN {_NODES} n ON n.id = 'NATION_' || ((s_suppkey * m) % 26) GROUP BY 1, 2)
SELECT '/' || s_name AS path, s_suppkey % 10 = 0 OR bad AS degraded FROM x"""


def volume_findings(spark, d):
    return H.volume_findings(_volumes(spark, d), _nodes(spark, d), 3)


VOLUME_FINDINGS = f"""
WITH v AS ({VOLUME_HEALTH}), n AS (SELECT count(*) AS n FROM v WHERE degraded), m AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 33 = 0)
SELECT 7 AS rule, 'degraded' AS level, format('{{:,}}', n) || CASE n WHEN 1 THEN ' volume map' ELSE ' volume maps' END || ' damaged' AS text FROM m WHERE n > 0
UNION ALL SELECT 8, 'attention', format('{{:,}}', n) || CASE n WHEN 1 THEN ' volume' ELSE ' volumes' END || ' degraded' FROM n WHERE n > 0"""


def status_decode(spark, d):
    """Status snapshots built from nations, decoded again."""
    n = table(spark, d, "nation").select(F.struct(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "NODE_STATE_DEAD").when(F.col("n_nationkey") % 4 == 1, "odd").otherwise("NODE_STATE_ALIVE").alias("state"), (F.col("n_nationkey").cast("long") * 1000000007).cast("string").alias("capacityBytes"), F.col("n_nationkey").cast("string").alias("usedBytes"), (F.col("n_nationkey") % 2 == 0).alias("pressured")).alias("n"), "n_regionkey")
    snapshots = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list("n").alias("nodes"))).alias("value"))
    return S.status_nodes(S.status(snapshots)).select("id", "state", "capacity", "used", "pressured")


STATUS_DECODE = """
SELECT n_name AS id, CASE n_nationkey % 4 WHEN 0 THEN 'dead' WHEN 1 THEN 'unknown' ELSE 'alive' END AS state, n_nationkey::BIGINT * 1000000007 AS capacity, n_nationkey::BIGINT AS used, n_nationkey % 2 = 0 AS pressured FROM nation"""


def exposition_text(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    rows = m.select(F.lit("events_total").alias("name"), F.lit("counter").alias("kind"), F.lit("Events seen.").alias("help"), F.array(F.struct(F.lit("type").alias("name"), F.col("event_type").alias("value"))).alias("labels"), "value")
    return S.exposition(rows).select("line")


EXPOSITION_TEXT = """
SELECT '# HELP events_total Events seen.' AS line UNION ALL SELECT '# TYPE events_total counter'
UNION ALL SELECT 'events_total{type="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type"""

# ---- extents ------------------------------------------------------------

_SIZE = 4096


def _writes(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("volume"), (F.col("l_partkey") * 1777).alias("offset"), (F.col("l_quantity") * 400).cast("long").alias("length"), F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("n_line"))


_WRITES = "(SELECT l_suppkey % 20 AS volume, l_partkey * 1777 AS \"offset\", (l_quantity * 400)::BIGINT AS length, l_orderkey AS w, l_linenumber AS n_line FROM lineitem)"


def write_split(spark, d):
    return E.split_range(_writes(spark, d), "offset", "length", _SIZE).select("volume", "w", "n_line", "offset", "idx", "begin", "n", "whole")


WRITE_SPLIT = f"""
WITH e AS (SELECT *, unnest(range("offset" // {_SIZE}, ("offset" + length - 1) // {_SIZE} + 1)) AS idx FROM {_WRITES} WHERE length > 0),
x AS (SELECT *, greatest("offset", idx * {_SIZE}) - idx * {_SIZE} AS begin, least("offset" + length, (idx + 1) * {_SIZE}) - greatest("offset", idx * {_SIZE}) AS n FROM e)
SELECT volume, w, n_line, "offset", idx, begin, n, n = {_SIZE} AS whole FROM x"""


def trimmed_extents(spark, d):
    mapped = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("volume"), (F.col("p_partkey") % 900).alias("idx")).distinct()
    return E.trimmed(_writes(spark, d), mapped, ["volume"], "offset", "length", _SIZE)


TRIMMED_EXTENTS = f"""
WITH c AS (SELECT DISTINCT volume, unnest(range(("offset" + {_SIZE - 1}) // {_SIZE}, ("offset" + length) // {_SIZE})) AS idx FROM {_WRITES})
SELECT volume, idx FROM c WHERE (volume, idx) IN (SELECT p_partkey % 20, p_partkey % 900 FROM part)"""


def rechunked(spark, d):
    return E.rechunk(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 1000).select("doc_id", "idx", F.sha2("part", 256).alias("sha256"))


RECHUNKED = "SELECT doc_id, idx::INTEGER AS idx, sha256(text[(idx * 1000 + 1):(idx * 1000 + 1000)]) AS sha256 FROM (SELECT doc_id, text, unnest(range((length(text) + 999) // 1000)) AS idx FROM documents)"


def reassembled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return E.reassemble(E.rechunk(docs, "doc_id", "text", 700), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"))


REASSEMBLED = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE length(text) > 0"


def range_read(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    parts = E.rechunk(docs, "doc_id", "text", 500)
    wanted = E.split_range(docs.select("doc_id", (F.col("doc_id") % 700).alias("offset"), F.lit(600).alias("length")), "offset", "length", 500)
    got = E.read_range(wanted, parts, ["doc_id"], 500)
    return E.reassemble(got.select("doc_id", "idx", F.col("data").alias("part")), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"))


RANGE_READ = "SELECT doc_id, sha256(rpad(text, greatest(length(text), 2000)::INTEGER, '0')[(doc_id % 700 + 1):(doc_id % 700 + 600)]) AS sha256 FROM documents"
