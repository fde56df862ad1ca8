"""Consistent-hash placement over nations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import fnv1a64, unsigned
from tidemark.operators import ring as R
from tidemark.plans.common import fnv_sql, table

_N = 3


def _nodes(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("node"))


def _keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("chunk-"), F.col("o_orderkey").cast("string")).alias("key"))


def ring_points(spark, d):
    return R.ring_points(_nodes(spark, d)).select("node", "vnode", unsigned(F.col("hash")).cast("string").alias("hash"))


_POINTS = f"(SELECT n_name AS node, v::INTEGER AS vnode, {fnv_sql('(n_name || chr(35) || v)')} AS hash FROM nation, range({R.VNODES}) t(v))"
RING_POINTS = f"SELECT node, vnode, hash::UBIGINT::VARCHAR AS hash FROM {_POINTS}"


def key_hash(spark, d):
    return _keys(spark, d).select("o_orderkey", unsigned(fnv1a64(F.col("key"))).cast("string").alias("hash"))


_KEYS = f"(SELECT o_orderkey, {fnv_sql('(' + chr(39) + 'chunk-' + chr(39) + ' || o_orderkey)')} AS h FROM orders)"
KEY_HASH = f"SELECT o_orderkey, h::UBIGINT::VARCHAR AS hash FROM {_KEYS}"


def _placed(spark, d, n: int = _N):
    return R.replicas(_keys(spark, d), "key", R.ring_points(_nodes(spark, d)), n)


def ring_replicas(spark, d):
    return _placed(spark, d).select("o_orderkey", F.posexplode("replicas").alias("place", "node"))


_DISTANCE = f"(SELECT o_orderkey, node, min((hash - h + 18446744073709551616) % 18446744073709551616) AS dist FROM {_KEYS} k, {_POINTS} p GROUP BY 1, 2)"
_RANKED = f"(SELECT o_orderkey, node, (row_number() OVER (PARTITION BY o_orderkey ORDER BY dist, node) - 1)::INTEGER AS place FROM {_DISTANCE})"
RING_REPLICAS = f"SELECT o_orderkey, place, node FROM {_RANKED} WHERE place < {_N}"


def ring_load(spark, d):
    return ring_replicas(spark, d).where("place = 0").groupBy("node").agg(F.count("*").alias("primaries"))


RING_LOAD = f"SELECT node, count(*) AS primaries FROM {_RANKED} WHERE place = 0 GROUP BY 1"


def capacity_weights(spark, d):
    cap = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.floor("c_acctbal").cast("long")).alias("capacity"))
    nodes = table(spark, d, "nation").join(cap, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("node"), F.when(F.col("n_nationkey") % 9 != 0, F.col("capacity")).alias("capacity"))
    return R.capacity_weights(nodes)


CAPACITY_WEIGHTS = """
WITH c AS (SELECT c_nationkey, sum(floor(c_acctbal)::BIGINT)::BIGINT AS cap FROM customer GROUP BY 1),
n AS (SELECT n_name AS node, CASE WHEN n_nationkey % 9 <> 0 THEN cap END AS capacity FROM nation LEFT JOIN c ON c_nationkey = n_nationkey),
m AS (SELECT min(capacity) AS least FROM n WHERE capacity > 0)
SELECT node, capacity, (CASE WHEN capacity > 0 THEN least(16, (capacity + m.least // 2) // m.least) ELSE 1 END)::INTEGER AS weight FROM n, m"""


def weighted_ring(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_name").alias("node"), (F.col("n_regionkey") - 1).alias("weight"))
    return R.ring_points(nodes, 16).groupBy("node").agg(F.count("*").alias("points"), F.min(unsigned(F.col("hash"))).cast("string").alias("first"))


WEIGHTED_RING = f"""
SELECT n_name AS node, count(*) AS points, min({fnv_sql('(n_name || chr(35) || v)')})::UBIGINT::VARCHAR AS first
FROM nation, range(64) t(v) WHERE v < 16 * greatest(n_regionkey - 1, 1) GROUP BY 1"""


def steered_replicas(spark, d):
    placed = _placed(spark, d, 25)
    bad = F.array(*(F.lit(f"NATION_{i}") for i in range(0, 25, 2)))
    return placed.select("o_orderkey", F.posexplode(R.steer(F.col("replicas"), _N, bad)).alias("place", "node"))


STEERED_REPLICAS = f"""
WITH r AS (SELECT *, regexp_extract(node, '[0-9]+')::INT % 2 = 0 AS bad, place < {_N} AS nat FROM {_RANKED}),
c AS (SELECT *, count(*) FILTER (nat AND NOT bad) OVER (PARTITION BY o_orderkey) AS good,
  row_number() OVER (PARTITION BY o_orderkey, nat, bad ORDER BY place) AS nth FROM r),
g AS (SELECT *, CASE WHEN nat AND NOT bad THEN 1 WHEN nat AND nth <= {_N // 2 + 1} - good THEN 2 WHEN NOT nat AND NOT bad THEN 3 ELSE 4 END AS step FROM c),
s AS (SELECT o_orderkey, node, (row_number() OVER (PARTITION BY o_orderkey ORDER BY step, place) - 1)::INTEGER AS place FROM g)
SELECT o_orderkey, place, node FROM s WHERE place < {_N}"""


def _held(spark, d):
    return _placed(spark, d).select(F.col("o_orderkey").alias("id"), F.posexplode("replicas").alias("place", "node")).where("(id + place * 5) % 7 <> 0 and id % 64 <> 1")


def replica_shortfall(spark, d):
    got = R.shortfall(_placed(spark, d).withColumnRenamed("o_orderkey", "id"), _held(spark, d), "id")
    return got.select("id", F.col("rank").alias("place"), "node", "leader")


REPLICA_SHORTFALL = f"""
WITH e AS (SELECT o_orderkey AS id, place, node, (o_orderkey + place * 5) % 7 <> 0 AND o_orderkey % 64 <> 1 AS has FROM {_RANKED} WHERE place < {_N}),
l AS (SELECT id, arg_min(node, place) AS leader FROM e WHERE has GROUP BY 1)
SELECT e.id, place, node, leader FROM e LEFT JOIN l USING (id) WHERE NOT has"""


def write_quorum(spark, d):
    acks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("write"), (F.col("l_returnflag") != "R").alias("ok"))
    return R.quorum(acks, "write")


WRITE_QUORUM = "SELECT l_orderkey AS write, count(*) FILTER (l_returnflag <> 'R') AS acked, count(*) AS targets, count(*) FILTER (l_returnflag <> 'R') >= count(*) // 2 + 1 AS committed FROM lineitem GROUP BY 1"


def first_read(spark, d):
    reads = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("value"), F.bool_and(F.col("l_returnflag") != "R").alias("ok"))
    return R.first_success(reads, "l_orderkey", "l_linenumber", "ok", "value")


FIRST_READ = """
WITH r AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS v, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, arg_min(v, l_linenumber) FILTER (ok) AS value FROM r GROUP BY 1"""


def delete_all(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("deleted"))


DELETE_ALL = "SELECT l_orderkey AS chunk, bool_and(l_linestatus = 'F') AS deleted FROM lineitem GROUP BY 1"
