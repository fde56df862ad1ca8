"""Scalar functions over orders, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing as X
from tidemark.functions import levels as L
from tidemark.functions import text as T
from tidemark.functions import units as U
from tidemark.plans.common import table


def validators(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 5 == 0, "-").otherwise(""), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "/..").otherwise("")).alias("s"))
    s = F.col("s")
    return x.select("p_partkey", T.valid_id(s).alias("id_ok"), T.valid_node_id(s).alias("node_ok"), T.valid_object_name(s).alias("name_ok"), T.sanitize(s).alias("clean"))


VALIDATORS = """
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN '/..' ELSE '' END AS s FROM part)
SELECT p_partkey, regexp_matches(s, '^[A-Za-z0-9_-]{1,128}$') AS id_ok, regexp_matches(s, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS node_ok,
s <> '' AND s NOT LIKE '/%' AND NOT regexp_matches(s, '(^|/)(\\.|\\.\\.|)(/|$)') AS name_ok, regexp_replace(s, '[^A-Za-z0-9_-]', '_', 'g')[1:32] AS clean FROM x"""


def key_round_trips(spark, d):
    s = table(spark, d, "supplier")
    key = T.manifest_key(F.col("s_name"), F.lit("2024-01-02T03:04:05.678Z"))
    return s.select("s_suppkey", key.alias("key"), T.manifest_key_node(key).alias("node"), T.manifest_key_name(key).alias("name"), T.manifest_name(F.concat(T.manifest_key_name(key), F.lit(".json"))).alias("parsed"), T.volume_from_file_name(T.volume_file_name(F.col("s_name"))).alias("volume"), T.chunk_id_from_key(F.concat(F.lit("chunks/"), "s_name")).alias("chunk"))


KEY_ROUND_TRIPS = """
SELECT s_suppkey, 'manifests/' || s_name || '/2024-01-02T03:04:05.678Z.json' AS key, s_name AS node, '2024-01-02T03:04:05.678Z' AS name, '2024-01-02T03:04:05.678Z' AS parsed,
s_name AS volume, CASE WHEN regexp_matches(s_name, '^[A-Za-z0-9_-]{1,128}$') THEN s_name END AS chunk FROM supplier"""


def path_functions(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.redact_target(F.concat(F.lit("https://user:pw@"), F.expr("substring(url, 9)"), F.lit("?q=1#x"))).alias("redacted"), F.array_join(T.path_parts(F.col("url")), "|").alias("parts"), T.relative_name(F.lit("https://"), F.col("url")).alias("relative"))


PATH_FUNCTIONS = """
SELECT page_id, 'https://' || regexp_replace(regexp_replace(url[9:] || '?q=1#x', '[?#;].*$', ''), '^[^/@]*@', '') AS redacted,
array_to_string(list_filter(string_split(url, '/'), lambda p: p NOT IN ('', '.')), '|') AS parts, CASE WHEN starts_with(url, 'https://') THEN url[9:] END AS relative FROM pages"""


def size_parsers(spark, d):
    k = F.col("p_partkey")
    unit = F.get(F.array(*(F.lit(u) for u in ("", "K", "M", "G", "T", "X"))), (k % 6).cast("int"))
    x = table(spark, d, "part").select("p_partkey", F.concat((k * 37).cast("string"), unit).alias("s"))
    return x.select("p_partkey", T.parse_size(F.col("s")).alias("bytes"), T.parse_byte_size(F.concat(F.lit(" "), "s", F.when(k % 2 == 0, "i").otherwise(""))).alias("byte_size"), T.parse_int64(F.col("s")).alias("int64"))


SIZE_PARSERS = """
WITH x AS (SELECT p_partkey AS k, p_partkey * 37 AS n, ['', 'K', 'M', 'G', 'T', 'X'][p_partkey % 6 + 1] AS u FROM part),
y AS (SELECT *, CASE u WHEN 'X' THEN NULL ELSE (n * (1024 ** (k % 6))::HUGEINT)::BIGINT END AS b FROM x)
SELECT k AS p_partkey, b AS bytes, CASE WHEN u = '' AND k % 2 = 0 THEN NULL ELSE b END AS byte_size, CASE u WHEN '' THEN n END AS int64 FROM y"""


def formats(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    wide = n.cast("decimal(12,0)")
    size = wide * wide * wide  # beyond a BIGINT from 2,097,152 orders on
    return o.select(
        "o_orderkey", U.format_duration(n * 7).alias("duration"), U.format_millis(n * 3).alias("millis"), U.format_skew(n - 5000).alias("skew"), U.format_ago(n - 100).alias("ago"), U.format_in(n - 100).alias("until"),
        U.format_interval(n * 60 - 600).alias("interval"), U.format_horizon(n * 9000).alias("horizon"), U.format_percent(n / 20000).alias("percent"), U.format_count(size).alias("count"), U.humanize_age(n * 5 - 50).alias("age"),
        F.regexp_extract(U.format_bytes(size), "([KMGTPE]i)?B$", 0).alias("unit"), U.backoff_ms(n % 8).alias("backoff"), U.round_half_up_2((n - 7000) / 8).alias("num"))


def _duration(s: str) -> str:
    s = f"greatest(floor({s}), 0)::BIGINT"
    return f"CASE WHEN {s} < 60 THEN {s} || ' s' WHEN {s} < 3600 THEN {s} // 60 || ' min' WHEN {s} < 86400 THEN {s} // 3600 || ' h' ELSE {s} // 86400 || ' d' END"


FORMATS = f"""
WITH x AS (SELECT o_orderkey, o_orderkey AS n FROM orders)
SELECT o_orderkey, {_duration('n * 7')} AS duration, CASE WHEN n * 3 < 1000 THEN n * 3 || ' ms' ELSE {_duration('n * 3 / 1000.0')} END AS millis,
CASE WHEN n > 5000 THEN '+' WHEN n < 5000 THEN '-' ELSE '' END || format('{{:,}}', abs(n - 5000)) || ' ms' AS skew,
CASE WHEN n - 100 < 5 THEN 'now' ELSE {_duration('(n - 100)')} || ' ago' END AS ago, CASE WHEN n - 100 < 5 THEN 'due' ELSE 'in ' || {_duration('(n - 100)')} END AS until,
CASE WHEN n * 60 - 600 <= 0 THEN 'none' ELSE 'every ' || {_duration('(n * 60 - 600)')} END AS "interval",
CASE WHEN n * 9000 / 86400.0 < 60 THEN {_duration('n * 9000')} WHEN n * 9000 / 86400.0 < 730 THEN n * 9000 // 86400 // 30 || ' mo' ELSE n * 9000 // 86400 // 365 || ' y' END AS horizon,
CASE WHEN n > 0 AND n < 200 THEN '<1%' ELSE floor(least(greatest(n / 20000.0, 0), 1) * 100 + 0.5)::BIGINT || '%' END AS percent, format('{{:,}}', n * n * n) AS count,
CASE WHEN n * 5 < 50 THEN 'just now' WHEN n * 5 - 50 < 60 THEN n * 5 - 50 || 's ago' WHEN n * 5 - 50 < 3600 THEN (n * 5 - 50) // 60 || 'm ago' WHEN n * 5 - 50 < 86400 THEN (n * 5 - 50) // 3600 || 'h ago' ELSE (n * 5 - 50) // 86400 || 'd ago' END AS age,
CASE WHEN n * n * n < 1024 THEN 'B' WHEN n * n * n < 1048576 THEN 'KiB' WHEN n * n * n < 1073741824 THEN 'MiB' WHEN n * n * n < 1099511627776 THEN 'GiB' ELSE 'TiB' END AS unit,
least(2000 * 2 ** greatest(n % 8 - 1, 0), 30000)::BIGINT AS backoff, floor((n - 7000) / 8.0 * 100 + 0.5) / 100 AS num FROM x"""


def levels(spark, d):
    n = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("used"), F.when(F.col("s_suppkey") % 9 == 0, 0).otherwise(1000).alias("capacity"))
    k = F.col("s_suppkey")
    error = F.when(k % 3 == 0, "").when(k % 3 == 1, "skipped:  maps differ").otherwise("disk failed")
    ratio = L.usage_ratio(F.col("used"), F.col("capacity"))
    return n.select(
        "s_suppkey", ratio.alias("ratio"), L.fill_level(ratio).alias("fill"), L.skew_level(k * 50 - 2500).alias("skew"), L.state_label((k % 6).cast("int")).alias("state"), L.gc_outcome(error).alias("outcome"), L.gc_skip_reason(error).alias("reason"),
        L.gc_kind(k % 5 != 0, k % 7 == 0, error, F.when(k % 2 == 0, k)).alias("gc"), L.replication_kind(k % 4, F.lit(3)).alias("replication"), L.version_class((k % 5).cast("int"), 3, 2).alias("version"),
        L.backup_kind(k % 6 != 0, k % 11 == 0, F.when(k % 4 != 0, k % 3 != 0), k * 100000, k * 90000, k * 10, F.lit(6000000)).alias("backup"), L.may_write(F.col("capacity"), F.lit(1000) - F.col("used"), F.lit(100)).alias("admitted"))


LEVELS = """
WITH x AS (SELECT s_suppkey, s_suppkey AS k, s_suppkey * 10 AS used, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1000 END AS cap, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'skipped:  maps differ' ELSE 'disk failed' END AS e FROM supplier),
y AS (SELECT *, CASE WHEN cap > 0 THEN least(used / 1000.0, 1.0)::DOUBLE END AS ratio, CASE WHEN e = '' THEN 'ok' WHEN e LIKE 'skipped:%' THEN 'skipped' ELSE 'failed' END AS outcome, CASE WHEN k % 4 <> 0 THEN k % 3 <> 0 END AS ok FROM x)
SELECT s_suppkey, ratio, CASE WHEN ratio >= 0.9 THEN 'degraded' WHEN ratio >= 0.8 THEN 'attention' ELSE 'healthy' END AS fill,
CASE WHEN abs(k * 50 - 2500) >= 2000 THEN 'degraded' WHEN abs(k * 50 - 2500) >= 500 THEN 'attention' ELSE 'healthy' END AS skew,
CASE k % 6 WHEN 0 THEN 'alive' WHEN 1 THEN 'suspect' WHEN 2 THEN 'dead' WHEN 3 THEN 'left' ELSE 'state(' || k % 6 || ')' END AS state, outcome, CASE k % 3 WHEN 1 THEN 'maps differ' ELSE e END AS reason,
CASE WHEN k % 5 = 0 THEN 'off' WHEN k % 7 = 0 THEN 'running' WHEN e <> '' THEN outcome WHEN k % 2 = 0 THEN 'ok' ELSE 'never' END AS gc, CASE WHEN k % 4 >= 3 THEN 'healthy' ELSE 'degraded' END AS replication,
CASE WHEN k % 5 IN (0, 1) THEN 'too-old' WHEN k % 5 = 4 THEN 'newer' ELSE 'compatible' END AS version,
CASE WHEN k % 6 = 0 THEN 'unconfigured' WHEN k % 11 = 0 THEN 'running' WHEN NOT ok THEN 'failed' WHEN 6000000 - k * 90000 > 900000 OR (k > 0 AND 6000000 - k * 100000 > 20000 * k) THEN 'overdue' WHEN ok THEN 'ok' ELSE 'never' END AS backup,
cap = 0 OR 1000 - used - 100 >= 1000 * (1 - 0.95::DOUBLE) AS admitted FROM y"""


def hlc_order(spark, d):
    li = table(spark, d, "lineitem")
    a = X.hlc(F.col("l_partkey") % 5, F.col("l_suppkey") % 3, F.col("l_returnflag"))
    b = X.hlc(F.col("l_orderkey") % 5, F.col("l_linenumber") % 3, F.col("l_linestatus"))
    return li.groupBy(X.hlc_compare(a, b).alias("order"), X.hlc_is_zero(a).alias("zero"), X.hlc_text(b).alias("text")).agg(F.count("*").alias("n"))


HLC_ORDER = """
WITH x AS (SELECT (l_partkey % 5, l_suppkey % 3, l_returnflag) AS a, (l_orderkey % 5, l_linenumber % 3, l_linestatus) AS b, l_orderkey % 5 || '.' || l_linenumber % 3 || '.' || l_linestatus AS text FROM lineitem)
SELECT (CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)::INTEGER AS "order", false AS zero, text, count(*) AS n FROM x GROUP BY 1, 2, 3"""
