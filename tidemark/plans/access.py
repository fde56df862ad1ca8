"""Tokens, capabilities, revocation and chart scales over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scales as C
from tidemark.operators import access as A
from tidemark.plans.common import table


def token_redeem(spark, d):
    e = table(spark, d, "events")
    tokens = e.select(F.col("event_id").alias("ordinal"), F.sha2(F.concat(F.lit("s"), (F.col("event_id") % 90).cast("string")), 256).alias("hash"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("event_id") * 10).alias("expires"), (F.col("event_type") == "error").alias("consumed"), (F.col("event_id") % 2 == 0).alias("single_use"))
    asked = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("secret"))
    return A.redeemed(asked, tokens, F.lit(3000))


TOKEN_REDEEM = """
SELECT 's' || s_suppkey AS secret, max(event_id) AS ordinal, max(event_id) % 2 = 0 AS consumes FROM supplier JOIN events ON event_id % 90 = s_suppkey
WHERE event_type <> 'error' AND (event_id % 4 = 0 OR 3000 < event_id * 10) GROUP BY s_suppkey"""


def call_authorization(spark, d):
    o = table(spark, d, "orders")
    calls = o.select("o_orderkey", F.col("o_orderpriority").alias("method"), F.when(F.col("o_custkey") % 7 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("cap"), (F.col("o_custkey") % 3).cast("string")))).alias("granted"))
    needs = spark.createDataFrame([("1-URGENT", "cap0"), ("2-HIGH", "cap1"), ("3-MEDIUM", "cap2")], "method string, capability string")
    return A.authorized(calls, needs).select("o_orderkey", "allowed")


CALL_AUTHORIZATION = """
WITH n(method, cap) AS (VALUES ('1-URGENT', 'cap0'), ('2-HIGH', 'cap1'), ('3-MEDIUM', 'cap2'))
SELECT o_orderkey, cap IS NOT NULL AND (o_custkey % 7 = 0 OR 'cap' || o_custkey % 3 = cap) AS allowed FROM orders LEFT JOIN n ON method = o_orderpriority"""


def revoked_serials(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.repeat(F.lit("9"), (F.col("c_custkey") % 45).cast("int")), F.col("c_custkey").cast("string")).alias("serial"))
    return A.revoked(c, A.sorted_serials(c.where("c_custkey % 6 = 1").select("serial")))


REVOKED_SERIALS = "SELECT c_custkey, repeat('9', c_custkey % 45) || c_custkey AS serial FROM customer WHERE repeat('9', c_custkey % 45) || c_custkey IN (SELECT repeat('9', c_custkey % 45) || c_custkey FROM customer WHERE c_custkey % 6 = 1)"


def volume_search(spark, d):
    v = table(spark, d, "supplier").select(F.concat(F.lit("/Vol/"), "s_name").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Holder-"), (F.col("s_suppkey") % 13).cast("string"))).alias("holder"))
    return A.matching(v, " HOLDER-1 ")


VOLUME_SEARCH = "SELECT path, holder FROM (SELECT '/Vol/' || s_name AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'Holder-' || s_suppkey % 13 END AS holder FROM supplier) WHERE lower(path) LIKE '%holder-1%' OR lower(holder) LIKE '%holder-1%'"


def chart_scales(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select("s_suppkey", C.bullet_x(k * 25.0, 500.0, 2000.0, 120.0).alias("bullet"), C.x_at(k, F.lit(101), 300.0).alias("x"), C.nearest_index(k * 3.0, F.lit(60), 280.0).alias("nearest"), C.series_opacity(k % 5).alias("opacity"), C.clamp(k - 50, 0, 20).alias("clamped"))


_R = "floor(({}) * 100 + 0.5) / 100"
CHART_SCALES = f"""
WITH x AS (SELECT s_suppkey, s_suppkey::DOUBLE AS k FROM supplier)
SELECT s_suppkey, CASE WHEN k <= 0 THEN 0 WHEN k * 25 <= 500 THEN {_R.format("k * 25.0::DOUBLE / 500::DOUBLE * 0.6::DOUBLE * 120::DOUBLE")} WHEN k * 25 <= 2000 THEN {_R.format("(0.6::DOUBLE + (k * 25 - 500) / 1500 * (0.99::DOUBLE - 0.6::DOUBLE)) * 120")} ELSE 120 END::DOUBLE AS bullet,
{_R.format("k * 300.0::DOUBLE / 100")} AS x, floor(least(greatest(k * 3 / 280, 0), 1) * 59 + 0.5)::BIGINT AS nearest, {_R.format("greatest(0.8::DOUBLE - (s_suppkey % 5) * 0.25::DOUBLE, 0.15::DOUBLE)")} AS opacity, greatest(least(k - 50, 20), 0)::DOUBLE AS clamped FROM x"""


def ring_segments(spark, d):
    return C.ring_segments(table(spark, d, "region").select("r_regionkey"), "r_regionkey", 10.0, 2.0)


RING_SEGMENTS = f"""
WITH s AS (SELECT r_regionkey, unnest(range(r_regionkey))::INTEGER AS segment, 2 * 3.141592653589793::DOUBLE * 10 AS c FROM region)
SELECT r_regionkey, segment, CASE WHEN r_regionkey = 1 THEN {_R.format("c")} ELSE {_R.format("c / r_regionkey - 2")} END AS length, {_R.format("-segment * (c / r_regionkey)")} AS "offset" FROM s"""
