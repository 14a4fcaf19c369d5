"""Queries over histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import timeseries as T
from netloom.plans.catalog import query
from netloom.plans.graph import OBSERVATIONS, observations, table

_CHANGES = f"""{OBSERVATIONS}, lagged AS (SELECT element, at_ms, state, event_id, lag(state) OVER (PARTITION BY element ORDER BY at_ms, state) AS prev FROM observations),
changes AS (SELECT element, at_ms, prev, state, prev IS NULL AS seed FROM lagged WHERE prev IS NULL OR prev <> state), clock AS (SELECT max(at_ms) AS now_ms FROM observations)"""
_CLASS = "CASE WHEN flap_count_1h >= 5 THEN 'flapping' WHEN flap_count_24h >= 5 THEN 'unstable' ELSE 'stable' END"


@query("flap_transitions", f"WITH {_CHANGES} SELECT element, at_ms AS at, prev AS from_state, state, seed FROM changes")
def flap_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return T.transitions(observations(spark, folder), ["element"])


@query("flap_stats", f"""
WITH {_CHANGES}, s AS (SELECT element, count(*) FILTER (at_ms >= now_ms - 3600000) AS flap_count_1h, count(*) FILTER (at_ms >= now_ms - 86400000) AS flap_count_24h, max(at_ms) AS last_change_at,
  max(at_ms) FILTER (NOT seed) AS changed_at, arg_max(state, at_ms) AS state FROM changes, clock WHERE at_ms >= now_ms - 604800000 GROUP BY element)
SELECT *, least(1.0, flap_count_1h / 6.0)::DOUBLE AS flap_score_1h, {_CLASS} AS flap_state FROM s""")  # fmt: skip
def flap_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder)
    now = F.lit(rows.agg(F.max("at")).first()[0])
    changes = T.transitions(rows, ["element"])
    return T.flap_stats(T.kept(changes, ["element"], now), ["element"], now)


@query("flap_rolling", f"""
WITH {_CHANGES}, s AS (SELECT element, at_ms AS at, state, count(*) OVER (PARTITION BY element ORDER BY at_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS flap_count_1h,
  count(*) OVER (PARTITION BY element ORDER BY at_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS flap_count_24h FROM changes)
SELECT *, {_CLASS} AS flap_state FROM s""")  # fmt: skip
def flap_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return T.rolling_flaps(T.transitions(observations(spark, folder), ["element"]), ["element"]).select("element", "at", "state", "flap_count_1h", "flap_count_24h", "flap_state")


@query("hourly_metric", f"""
WITH {OBSERVATIONS} SELECT element, CAST(at_ms // 3600000 * 3600000 AS BIGINT) AS bucket, avg(value) AS avg, count(value) AS cnt FROM observations GROUP BY ALL""")  # fmt: skip
def hourly_metric(spark: SparkSession, folder: str) -> DataFrame:
    return T.hourly(observations(spark, folder), ["element"])


@query("hourly_weighted_avg", f"""
WITH {OBSERVATIONS}, clock AS (SELECT max(at_ms) AS now_ms FROM observations), b AS (SELECT element, at_ms // 3600000 * 3600000 AS bucket, avg(value) AS a, count(value) AS c FROM observations GROUP BY ALL)
SELECT element, sum(a * c) FILTER (bucket >= now_ms - 3600000) / sum(c) FILTER (bucket >= now_ms - 3600000) AS avg_1h, sum(a * c) FILTER (bucket >= now_ms - 86400000) / sum(c) FILTER (bucket >= now_ms - 86400000) AS avg_24h,
  coalesce(sum(c) FILTER (bucket >= now_ms - 3600000), 0)::BIGINT AS count_1h, coalesce(sum(c) FILTER (bucket >= now_ms - 86400000), 0)::BIGINT AS count_24h
FROM b, clock WHERE bucket >= now_ms - 604800000 GROUP BY element""")  # fmt: skip
def hourly_weighted_avg(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder)
    return T.hourly_windows(T.hourly(rows, ["element"]), ["element"], F.lit(rows.agg(F.max("at")).first()[0]))


@query("sliding_hour_mean", f"""
WITH {OBSERVATIONS} SELECT event_id, avg(value) OVER (PARTITION BY element ORDER BY at_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS mean FROM observations""")  # fmt: skip
def sliding_hour_mean(spark: SparkSession, folder: str) -> DataFrame:
    return T.sliding_mean(observations(spark, folder), ["element"]).select("event_id", "mean")


@query("counter_rate", """
WITH t AS (SELECT user_id AS device, event_id % 3 AS ifindex, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, event_id, CAST(round(value * 40000) AS BIGINT) AS step FROM events),
s AS (SELECT *, (sum(step) OVER (PARTITION BY device, ifindex ORDER BY ts, event_id) + 4294000000) % 4294967296 AS c FROM t),
l AS (SELECT *, lag(c) OVER w AS pc, lag(ts) OVER w AS pt FROM s WINDOW w AS (PARTITION BY device, ifindex ORDER BY ts)),
d AS (SELECT device, ifindex, ts, CASE WHEN ts - pt > 0 AND ts - pt <= 86400 THEN CASE WHEN c >= pc THEN c - pc WHEN (4294967296 - pc + c) * 2 <= 4294967296 THEN 4294967296 - pc + c END END AS delta, ts - pt AS dt FROM l)
SELECT device, ifindex, ts, delta::DOUBLE / dt AS error_rate_in_per_s FROM d""")  # fmt: skip
def counter_rate(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, folder, "events").select(F.col("user_id").alias("device"), (F.col("event_id") % 3).alias("ifindex"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("ts"), "event_id", F.round(F.col("value") * 40000).cast("bigint").alias("step"))
    total = F.sum("step").over(Window.partitionBy("device", "ifindex").orderBy("ts", "event_id"))
    none = F.lit(None).cast("bigint")
    rows = e.withColumn("in_errors", (total + 4294000000) % 4294967296).withColumns({"in_octets": none, "out_octets": none, "out_errors": none, "speed_mbps": F.lit(1000)})
    return T.counter_rates(rows, ttl_s=86400).select("device", "ifindex", "ts", "error_rate_in_per_s")


@query("history_trim", f"""
WITH {_CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY element ORDER BY at_ms DESC, state) AS k FROM changes) SELECT element, at_ms AS at, state FROM r WHERE k <= 20""")  # fmt: skip
def history_trim(spark: SparkSession, folder: str) -> DataFrame:
    changes = T.transitions(observations(spark, folder), ["element"])
    return T.kept(changes, ["element"], F.lit(0), window_ms=0, most=20).select("element", "at", "state")
