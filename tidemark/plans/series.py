"""Time series of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.common import micros, table

_NOW, _SPAN, _N = 1706745600, 2592000, 60
_SQL_T = "(epoch_us(ts) // 1000000)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("t", F.floor(micros("ts") / 1000000).cast("long")).withColumn("ms", F.floor(micros("ts") / 1000).cast("long"))


def bucket_means(spark, d):
    got = S.bucket_means(_events(spark, d), "event_type", "t", "value", _NOW, _SPAN, _N)
    return got.withColumn("mean", F.round("mean", 6))


_BUCKETS = f"""(WITH g AS (SELECT event_type, s::INTEGER AS slot FROM (SELECT DISTINCT event_type FROM events), range({_N}) t(s)),
m AS (SELECT event_type, least(({_SQL_T} - {_NOW - _SPAN}) // {_SPAN // _N}, {_N - 1})::INTEGER AS slot, avg(value) AS mean FROM events WHERE {_SQL_T} BETWEEN {_NOW - _SPAN} AND {_NOW} GROUP BY 1, 2)
SELECT event_type, ({_NOW - _SPAN} + (slot + 1) * {_SPAN // _N})::BIGINT AS bucket_end, mean FROM g LEFT JOIN m USING (event_type, slot))"""
BUCKET_MEANS = f"SELECT event_type, bucket_end, round(mean, 6) AS mean FROM {_BUCKETS}"


def resampled(spark, d):
    got = S.resample(_events(spark, d), "event_type", "t", "value", _NOW, _SPAN, _N)
    return got.withColumn("mean", F.round("mean", 6))


RESAMPLED = f"""
WITH b AS {_BUCKETS}
SELECT event_type, bucket_end, round(coalesce(last_value(mean IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket_end),
first_value(mean IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket_end ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS mean FROM b"""


def counter_rate(spark, d):
    return S.last_rate(_events(spark, d), "user_id", "ms", "value").withColumn("rate", F.round("rate", 9))


COUNTER_RATE = """
WITH r AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC) AS i FROM events),
p AS (SELECT user_id, max(ms) FILTER (i = 1) AS m1, max(ms) FILTER (i = 2) AS m2, max(value) FILTER (i = 1) AS v1, max(value) FILTER (i = 2) AS v2 FROM r GROUP BY 1)
SELECT user_id, CASE WHEN m1 > m2 AND v1 >= v2 THEN round((v1 - v2) * 1000.0 / (m1 - m2), 9) END AS rate FROM p"""


def counter_deltas(spark, d):
    return S.counter_deltas(_events(spark, d), "user_id", "ts", "value").select("event_id", F.round("delta", 6).alias("delta"))


COUNTER_DELTAS = "SELECT event_id, round(greatest(value - w, 0), 6) AS delta FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM events) WHERE w IS NOT NULL"


def linear_trend(spark, d):
    got = S.linear_trend(_events(spark, d), "user_id", "ms", "value", 1000.0)
    return got.select("user_id", F.round("slope", 10).alias("slope"), F.round(F.col("seconds_until") / 1e6, 3).alias("megaseconds"))


LINEAR_TREND = """
WITH x AS (SELECT user_id, value, ts, (epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id)) / 1000.0 AS s FROM events),
f AS (SELECT user_id, CASE WHEN count(*) > 1 AND max(s) > min(s) THEN regr_slope(value, s) ELSE 0 END AS slope, arg_max(value, ts) AS last FROM x GROUP BY 1)
SELECT user_id, round(slope, 10) AS slope, CASE WHEN slope > 0 THEN round(greatest((1000.0 - last) / slope, 0) / 1e6, 3) END AS megaseconds FROM f"""


def _flagged(spark, d):
    return S.hysteresis(_events(spark, d), "user_id", "ts", "value", 80.0, 20.0)


def hysteresis(spark, d):
    return _flagged(spark, d).select("event_id", "on")


_HYST = """(SELECT event_id, user_id, ts, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value <= 20 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), false) AS "on" FROM events)"""
HYSTERESIS = f'SELECT event_id, "on" FROM {_HYST}'


def pressure_edges(spark, d):
    return S.edges(_flagged(spark, d), "user_id", "ts", "on").select("event_id", "on")


PRESSURE_EDGES = f'SELECT event_id, "on" FROM (SELECT *, coalesce(lag("on") OVER (PARTITION BY user_id ORDER BY ts), false) AS was FROM {_HYST}) WHERE "on" <> was'


def histogram(spark, d):
    got = S.histogram(_events(spark, d), "event_type", "value", (1.0, 5.0, 10.0, 50.0, 100.0, 250.0))
    return got.select("event_type", "le", "cumulative", "total", F.round("sum", 2).alias("sum"))


HISTOGRAM = """
WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 250.0, NULL])::DOUBLE AS le)
SELECT event_type, le, count(*) FILTER (le IS NULL OR value <= le) AS cumulative, count(*) AS total, round(sum(value), 2) AS sum FROM events, b GROUP BY 1, 2"""


def _daily(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("DAY", "ts").alias("day"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))


_DAILY = "(SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY 1, 2)"


def stacked_bands(spark, d):
    return S.stacked(_daily(spark, d), "day", "event_type", "v").select("day", "event_type", "lower", "upper")


STACKED_BANDS = f"SELECT day, event_type, (u - v)::BIGINT AS lower, u::BIGINT AS upper FROM (SELECT *, sum(v) OVER (PARTITION BY day ORDER BY event_type) AS u FROM {_DAILY})"


def newest_samples(spark, d):
    return S.newest(_events(spark, d), "user_id", "ts", 8).select("event_id", "user_id")


NEWEST_SAMPLES = "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 8"


def grown_per_day(spark, d):
    return S.grown(_daily(spark, d), "event_type", "day", "v")


GROWN_PER_DAY = f"""
WITH o AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM {_DAILY})),
s AS (SELECT day, i, v, lag(v) OVER w AS was, lag(i) OVER w AS prev FROM {_DAILY} JOIN o USING (day) WINDOW w AS (PARTITION BY event_type ORDER BY i))
SELECT day, sum(CASE WHEN prev = i - 1 THEN greatest(v - was, 0) ELSE 0 END)::BIGINT AS grown FROM s GROUP BY 1"""


def aligned_matrix(spark, d):
    return S.aligned(_daily(spark, d).where("v % 3 <> 0"), "day", "event_type", "v")


ALIGNED_MATRIX = f"""
WITH x AS (SELECT * FROM {_DAILY} WHERE v % 3 <> 0)
SELECT day, event_type, coalesce(v, 0)::BIGINT AS v FROM (SELECT DISTINCT day FROM x) CROSS JOIN (SELECT DISTINCT event_type FROM x) LEFT JOIN x USING (day, event_type)"""


def stack_peak(spark, d):
    return _daily(spark, d).groupBy("day").agg(F.sum("v").alias("v")).agg(F.max("v").alias("peak"))


STACK_PEAK = f"SELECT max(v)::BIGINT AS peak FROM (SELECT day, sum(v) AS v FROM {_DAILY} GROUP BY 1)"


def down_sampled(spark, d):
    """An ordered fold per series."""
    return S.down_sample(_events(spark, d).select("event_id", "user_id", "t"), "user_id", "t", 7200)


DOWN_SAMPLED = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events),
a AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT a.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.t >= a.t + 7200) FROM a WHERE a.t IS NOT NULL)
SELECT event_id, user_id, t FROM e JOIN a USING (user_id, t)"""
