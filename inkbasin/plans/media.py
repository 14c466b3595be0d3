"""Queries on frames, scenes and event windows. Event windows are an extension of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkbasin.operators import frames
from inkbasin.plans.inputs import table
from inkbasin.plans.register import registry
from inkbasin.streaming.ingest import event_counts

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN [] ELSE list_transform(range(0, least(CAST(ceil((c_custkey % 50) * 30 / 7.0) AS BIGINT), 100)), lambda i: i * 7.0::DOUBLE) END AS times FROM customer")
def frame_sampling(spark, d):
    return table(spark, d, "customer").select("c_custkey", frames.sample_times((F.col("c_custkey") % 50) * 30, 7.0, 100).alias("times"))


_TIMES = "t AS (SELECT user_id, list(CAST(event_id % 2000 AS DOUBLE) ORDER BY event_id % 2000) AS times, CAST(user_id % 3000 AS DOUBLE) AS duration FROM events GROUP BY user_id)"


def _times(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list((F.col("event_id") % 2000).cast("double"))).alias("times"))
    return e.withColumn("duration", (F.col("user_id") % 3000).cast("double"))


@query(f"WITH {_TIMES} SELECT user_id, CASE WHEN len(times) < 8 AND duration > 600 THEN list_sort(list_distinct(list_concat(times, list_transform(range(0, CAST(ceil(duration / 45) AS BIGINT)), lambda i: i * 45.0::DOUBLE)))) ELSE times END AS times FROM t")
def scene_floor(spark, d):
    return _times(spark, d).select("user_id", frames.with_floor(F.col("times"), F.col("duration")).alias("times"))


@query("WITH t AS (SELECT event_type, list(CAST(event_id AS DOUBLE) ORDER BY event_id) AS times FROM events GROUP BY event_type) SELECT event_type, CASE WHEN len(times) > 60 THEN list_transform(range(0, 35), lambda i: times[CAST(floor(i * len(times) / 35) AS BIGINT) + 1]) ELSE times END AS times FROM t")
def scene_breaker(spark, d):
    t = table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_list(F.col("event_id").cast("double"))).alias("times"))
    return t.select("event_type", frames.with_breaker(F.col("times")).alias("times"))


@query("WITH RECURSIVE e AS (SELECT user_id, round(value, 3) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), k AS (SELECT user_id, n, v AS last, [v] AS kept FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN abs(e.v - k.last) > 5 THEN e.v ELSE k.last END, CASE WHEN abs(e.v - k.last) > 5 THEN list_append(k.kept, e.v) ELSE k.kept END FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1) SELECT user_id, arg_max(kept, n) AS kept FROM k GROUP BY user_id")
def frame_dedup_last_kept(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value", 3).alias("v")))).alias("all"))
    return e.select("user_id", frames.kept_by_change(F.transform("all", lambda x: x["v"]), 5.0).alias("kept"))


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, floor(event_id / 60) ORDER BY event_id) AS n FROM events) SELECT event_id, event_type FROM r WHERE n <= 4")
def frames_per_minute_cap(spark, d):
    return frames.per_minute(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 4)


@query("SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS BIGINT) AS chunk FROM events")
def frame_chunks(spark, d):
    return frames.chunks(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return event_counts(table(spark, d, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})
