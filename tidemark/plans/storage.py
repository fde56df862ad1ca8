"""Garbage collection, replicated state, reconciliation and backups over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.hashing import hlc, unsigned
from tidemark.operators import backup as B
from tidemark.operators import collect as C
from tidemark.operators import crdt as R
from tidemark.operators import reconcile as X
from tidemark.plans.common import fnv_sql, micros, table

CUTOFF = dt.datetime(1998, 1, 1)


def _day(s: str):
    return F.lit(dt.datetime.fromisoformat(s)).cast("timestamp_ntz")


# ---- garbage collection -------------------------------------------------


def gc_sweep(spark, d):
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("stored_bytes"), F.col("o_orderdate").alias("created_at"))
    live = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return C.sweep(chunks, live, _day("1998-01-01"), budget=50)


GC_SWEEP = """
WITH o AS (
  SELECT o_orderkey AS id, o_totalprice AS stored_bytes, o_orderdate AS created_at FROM orders
  WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT id, stored_bytes, created_at, row_number() OVER (ORDER BY id::VARCHAR || '.chunk') <= 50 AS deleted FROM o"""


def _held(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("volume_id"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_orderkey").cast("string")).alias("chunk_id"), "l_quantity")


def gc_live_set(spark, d):
    refs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"))
    return C.live_set(refs, _held(spark, d))


GC_LIVE_SET = """
SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'F'
UNION SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_linenumber <> 7"""


def gc_unaccounted(spark, d):
    return C.unaccounted(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), _held(spark, d).where("l_quantity > 49.5 and chunk_id = ''"))


GC_UNACCOUNTED = """
SELECT count(*) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_linenumber = 7)"""


def gc_skip_streak(spark, d):
    runs = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed").otherwise("skipped").alias("outcome"))
    return C.skip_streak(runs, "user_id", "ts", "outcome").select("event_id", "outcome", F.col("streak").cast("long").alias("streak"))


GC_SKIP_STREAK = """
WITH r AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS outcome FROM events),
i AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER (PARTITION BY user_id ORDER BY ts) AS clean FROM r)
SELECT event_id, outcome, count(*) FILTER (outcome = 'skipped') OVER (PARTITION BY user_id, clean ORDER BY ts) AS streak FROM i"""


def gc_reap(spark, d):
    files = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_suppkey").alias("volume_id")).agg(F.min("l_shipdate").alias("snapshot_mtime"), F.max(F.when(F.col("l_quantity") > 49, F.col("l_shipdate"))).alias("log_mtime"))
    live = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    return C.reap(files, live, _day("2001-06-01"))


GC_REAP = """
WITH f AS (SELECT l_suppkey AS volume_id, min(l_shipdate) AS a, max(l_shipdate) FILTER (l_quantity > 49) AS b FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
SELECT volume_id FROM f WHERE volume_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND (greatest(a, b) IS NULL OR greatest(a, b) < TIMESTAMP '2001-06-01')"""


# ---- replicated state ---------------------------------------------------


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.withColumn("stamp", hlc(micros("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")))


def lww_map(spark, d):
    got = R.lww_merge(_lines(spark, d), ["l_orderkey", "l_linenumber"], "l_extendedprice", F.col("stamp"))
    return got.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"), F.col("ts.wall").alias("wall"), F.col("ts.logical").alias("logical"), F.col("ts.node").alias("node"))


LWW_MAP = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS value, epoch_us(l_shipdate) AS wall, l_partkey::BIGINT AS logical, l_suppkey::VARCHAR AS node FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey::VARCHAR DESC, l_extendedprice DESC) = 1"""


def lww_register(spark, d):
    e = table(spark, d, "events").withColumn("stamp", hlc(micros("ts"), F.lit(0), F.col("event_type")))
    return R.lww_merge(e, ["user_id"], "value", F.col("stamp")).select("user_id", "value", F.col("ts.node").alias("node"))


LWW_REGISTER = "SELECT user_id, value, event_type AS node FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) = 1"


def lww_mapped_count(spark, d):
    return R.mapped_counts(_held(spark, d), "volume_id", "chunk_id")


LWW_MAPPED_COUNT = "SELECT l_suppkey AS volume_id, count(*) FILTER (l_linenumber <> 7) AS mapped FROM lineitem GROUP BY 1"


def lww_lookup(spark, d):
    return R.lww_get(_held(spark, d).select("volume_id", "chunk_id"), F.col("volume_id") == 3, "chunk_id")


LWW_LOOKUP = "SELECT l_suppkey AS volume_id, CASE WHEN l_linenumber <> 7 THEN l_orderkey::VARCHAR END AS chunk_id FROM lineitem WHERE l_suppkey = 3"


def _adds_tombs(spark, d):
    e = table(spark, d, "events")
    adds = e.where("event_type = 'signup'").select(F.col("user_id").alias("elem"), F.col("event_id").alias("tag"))
    removals = e.where("event_type = 'error'").select(F.col("user_id").alias("elem"), F.col("event_id").alias("at"))
    return adds, R.orset_remove(adds, removals)


def orset_elements(spark, d):
    return R.orset_elements(*_adds_tombs(spark, d))


_TOMBS = '''t AS (SELECT a.user_id AS elem, a.event_id AS tag, max(r.event_id) AS "at" FROM events a JOIN events r ON r.user_id = a.user_id AND r.event_type = 'error' AND a.event_id < r.event_id WHERE a.event_type = 'signup' GROUP BY 1, 2)'''
ORSET_ELEMENTS = f"""
WITH {_TOMBS} SELECT user_id AS elem, max(event_id) AS live_tag FROM events
WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM t WHERE t.elem = user_id AND t.tag = event_id) GROUP BY 1"""


def orset_tombstones(spark, d):
    adds, tombs = _adds_tombs(spark, d)
    halves = [tombs.where("tag % 2 = 0"), tombs.where("tag % 3 = 0").withColumn("at", F.col("at") - 1)]
    return R.orset_merge([adds], halves)[1]


ORSET_TOMBSTONES = f"""
WITH {_TOMBS} SELECT elem, tag, max("at") AS "at" FROM (SELECT elem, tag, "at" FROM t WHERE tag % 2 = 0 UNION ALL SELECT elem, tag, "at" - 1 FROM t WHERE tag % 3 = 0) GROUP BY 1, 2"""


def orset_gc(spark, d):
    adds, tombs = _adds_tombs(spark, d)
    a, t, n = R.orset_gc(adds, tombs, F.lit(5000))
    return a.agg(F.count("*").alias("adds")).crossJoin(t.agg(F.count("*").alias("tombs"))).crossJoin(n)


ORSET_GC = f"""
WITH {_TOMBS} SELECT (SELECT count(*) FROM events WHERE event_type = 'signup') - (SELECT count(*) FROM t WHERE "at" <= 5000) AS adds,
(SELECT count(*) FROM t WHERE "at" > 5000) AS tombs, (SELECT count(*) FROM t WHERE "at" <= 5000) AS reclaimed"""


# ---- reconciliation -----------------------------------------------------


def _replica(spark, d, which: str):
    rows = _lines(spark, d).where(which)
    got = R.lww_merge(rows, ["l_orderkey", "l_linenumber"], "l_quantity", F.col("stamp"))
    return got.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("volume"), F.col("l_quantity").cast("long").cast("string").alias("value"), "ts")


_REP = """(SELECT l_orderkey AS key, l_linenumber AS volume, l_quantity::BIGINT::VARCHAR AS value, epoch_us(l_shipdate) AS wall, l_partkey AS logical, l_suppkey::VARCHAR AS node FROM lineitem WHERE {where}
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey::VARCHAR DESC, l_quantity DESC) = 1)"""
_A, _B = "l_suppkey % 3 <> 0", "l_suppkey % 3 <> 1"


def map_digest(spark, d):
    got = X.digests(_replica(spark, d, _A), "volume", ["key", "value"])
    return got.select("volume", unsigned(F.col("digest")).cast("string").alias("digest"), "mapped")


MAP_DIGEST = f"""
SELECT volume, xor(bit_xor({fnv_sql("(key::VARCHAR || '|' || value)")}::UBIGINT), 5841168716699533313::UBIGINT)::VARCHAR AS digest, count(*) AS mapped FROM {_REP.format(where=_A)} GROUP BY 1"""


def map_missing(spark, d):
    return X.missing_from(_replica(spark, d, _A), _replica(spark, d, _B), ["key", "volume"], ["value", "ts"]).select("key", "volume", "value", F.col("ts.wall").alias("wall"))


MAP_MISSING = f"""
SELECT a.key, a.volume, a.value, a.wall FROM {_REP.format(where=_A)} a LEFT JOIN {_REP.format(where=_B)} b USING (key, volume)
WHERE b.key IS NULL OR a.value <> b.value OR a.wall <> b.wall OR a.logical <> b.logical OR a.node <> b.node"""


def map_coverage(spark, d):
    return X.covers(_replica(spark, d, _A), _replica(spark, d, "l_quantity > 45 and " + _B), "key", "volume", F.lit(788918400000000))


MAP_COVERAGE = f"""
SELECT b.volume, bool_and(coalesce((a.wall, a.logical, a.node) >= (b.wall, b.logical, b.node), false)) AS covered
FROM {_REP.format(where="l_quantity > 45 AND " + _B)} b LEFT JOIN {_REP.format(where=_A)} a USING (key, volume) WHERE b.wall < 788918400000000 GROUP BY 1"""


def _states(spark, d):
    return X.classify_replicas(_replica(spark, d, _A), _replica(spark, d, _B), ["key", "volume"], "value")


def replica_states(spark, d):
    return _states(spark, d).groupBy("volume", "state").agg(F.count("*").alias("n"))


_STATES = f"""(SELECT volume, CASE WHEN a.value IS NULL THEN 'absent_here' WHEN b.value IS NULL THEN 'absent_there' WHEN a.value = b.value THEN 'ok' ELSE 'diverged' END AS state
FROM {_REP.format(where=_A)} a FULL JOIN {_REP.format(where=_B)} b USING (key, volume))"""
REPLICA_STATES = f"SELECT volume, state, count(*) AS n FROM {_STATES} GROUP BY 1, 2"


def maps_converged(spark, d):
    return X.converged(_states(spark, d), "volume")


MAPS_CONVERGED = f"SELECT bool_and(state = 'ok') AS converged, min(volume) FILTER (state <> 'ok') AS first_diverged FROM {_STATES}"


# ---- backups ------------------------------------------------------------


def _objects(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"))


def _remote(spark, d):
    return _objects(spark, d).where("id % 7 <> 0").withColumn("size", F.when(F.col("id") % 11 == 0, 0).when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))


_OBJ = "(SELECT doc_id AS id, n_chars AS size, sha256(text) AS sha256 FROM documents)"
_REM = "(SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size, sha256(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0)"


def backup_plan(spark, d):
    known = _objects(spark, d).where("id % 3 <> 0")
    return B.plan_chunks(_objects(spark, d), _remote(spark, d), known)


BACKUP_PLAN = f"""
SELECT o.id, CASE WHEN coalesce(r.size, 0) <= 0 THEN 'upload' WHEN o.id % 3 <> 0 AND o.size = r.size THEN 'known' ELSE 'hash' END AS action FROM {_OBJ} o LEFT JOIN {_REM} r USING (id)"""


def backup_confirm(spark, d):
    return B.confirm(_objects(spark, d).select("id", "size"), _remote(spark, d))


BACKUP_CONFIRM = f"SELECT o.id, o.size, r.size AS found_size FROM {_OBJ} o LEFT JOIN {_REM} r USING (id) WHERE o.size IS DISTINCT FROM r.size"


def backup_verify(spark, d):
    named = lambda x: x.withColumnRenamed("id", "name")
    damaged = _remote(spark, d).withColumn("sha256", F.when(F.col("id") % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return B.verify(named(_objects(spark, d)), named(damaged), deep=True)


BACKUP_VERIFY = f"""
SELECT o.id AS name, CASE WHEN r.id IS NULL THEN 'missing' WHEN o.size <> r.size THEN 'size' ELSE 'checksum' END AS problem
FROM {_OBJ} o LEFT JOIN {_REM} r USING (id) WHERE r.id IS NULL OR o.size <> r.size OR (o.id % 13 = 0 AND reverse(o.sha256) <> o.sha256)"""


def _runs(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("node"), F.date_trunc("DAY", "ts").alias("stamp")).distinct()


def backup_retention(spark, d):
    return B.expired_manifests(_runs(spark, d), 7, _day("2024-01-20"))


BACKUP_RETENTION = """
WITH r AS (SELECT DISTINCT user_id AS node, date_trunc('day', ts)::TIMESTAMP AS stamp FROM events)
SELECT node, stamp FROM r QUALIFY row_number() OVER (PARTITION BY node ORDER BY stamp DESC) > 7 AND stamp < TIMESTAMP '2024-01-20'"""


def backup_prunable(spark, d):
    objects = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("mtime"))
    return B.prunable(objects, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), _day("2000-01-01"))


BACKUP_PRUNABLE = "SELECT o_orderkey AS id, o_orderdate AS mtime FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


def backup_known_checksums(spark, d):
    m = table(spark, d, "lineitem").select(F.concat(F.lit("manifests/"), F.col("l_suppkey").cast("string")).alias("key"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("size"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"))
    m = m.groupBy("key", "id").agg(F.max("size").alias("size"), F.max_by("sha256", "size").alias("sha256"))
    return B.known_checksums(m)


BACKUP_KNOWN_CHECKSUMS = """
WITH m AS (SELECT 'manifests/' || l_suppkey AS key, l_partkey AS id, max(l_orderkey) AS size FROM lineitem GROUP BY 1, 2)
SELECT id, size, sha256(size::VARCHAR) AS sha256 FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY key DESC) = 1"""


def backup_manifests(spark, d):
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("id"), F.col("l_quantity").cast("long").alias("size"))
    m = B.manifest_totals(B.build_manifests(chunks, ["run"]))
    return m.select("run", F.size("chunks").cast("long").alias("n_chunks"), "total_bytes", B.valid_manifest().alias("valid"))


BACKUP_MANIFESTS = "SELECT l_orderkey AS run, count(*) AS n_chunks, sum(l_quantity::BIGINT)::BIGINT AS total_bytes, count(DISTINCT l_partkey) = count(*) AND bool_and(l_quantity >= 1) AS valid FROM lineitem GROUP BY 1"


def backup_active_runs(spark, d):
    markers = table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("node"), F.col("ts").alias("at"))
    return B.active_runs(markers, "node-3", _day("2024-01-29"))


BACKUP_ACTIVE_RUNS = """
SELECT 'node-' || user_id AS node, CASE WHEN max(ts) >= TIMESTAMP '2024-01-29' THEN 'active' ELSE 'stale' END AS state FROM events WHERE event_type = 'view' AND user_id <> 3 GROUP BY 1"""
