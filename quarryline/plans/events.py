"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import load

_ev = lambda s, d: load(s, d, "events")

QUERIES = {
    "usage_summary": lambda s, d: M.usage_summary(_ev(s, d).withColumn("device", F.col("user_id") % 10), F.col("event_type") == "error", "value", "event_type", "device"),
    "model_stats": lambda s, d: M.key_stats(_ev(s, d).withColumn("failed_", F.col("user_id") % 7 == 0), "event_type", F.col("failed_"), "value"),
    "rollup_hourly": lambda s, d: M.time_buckets(_ev(s, d), "hour"),
    "rollup_daily": lambda s, d: M.time_buckets(_ev(s, d), "day", "event_type"),
    "rollup_monthly": lambda s, d: M.time_buckets(_ev(s, d), "month", "user_id"),
    "performance_trend": lambda s, d: M.time_buckets(_ev(s, d).where("event_type = 'purchase'"), "hour"),
    "error_rate_alerts": lambda s, d: M.trailing_error_rate(_ev(s, d), "user_id", F.col("event_type") == "error", 24 * 60, 3, 0.4),
    "tiered_alerts": lambda s, d: M.tiered_alerts(_ev(s, d), "value", {"critical": 90.0, "warning": 80.0}),
    "counter_running": lambda s, d: M.running_counter(_ev(s, d), "event_type"),
    "gauge_last": lambda s, d: M.gauge(_ev(s, d), "event_type", "user_id"),
    "histogram_bins": lambda s, d: M.histogram(_ev(s, d), 10.0, "event_type"),
    "timer_stats": lambda s, d: M.timer_stats(_ev(s, d), "event_type"),
    "exclusive_quantiles": lambda s, d: M.exclusive_quantiles(_ev(s, d), "event_type", {"p95": 0.95, "p99": 0.99, "median": 0.5}),
    "monthly_costs": lambda s, d: M.monthly_costs(_ev(s, d), "event_type", "value"),
    "counts_by_each": lambda s, d: M.counts_by_each(load(s, d, "documents"), "source", "lang"),
    "trend_classes": lambda s, d: M.trend(_ev(s, d), "user_id"),
    "batch_trend_classes": lambda s, d: M.trend(_ev(s, d), "event_type", 5, 0.05),
    "error_groups": lambda s, d: M.error_groups(_ev(s, d).where("event_type = 'error'"), "event_type", "user_id"),
    "error_threshold_alerts": lambda s, d: M.over_threshold(M.error_groups(_ev(s, d), "event_type", "user_id"), F.when(F.col("n") % 2 == 0, "high").otherwise("low"), {"critical": 1, "high": 5, "medium": 20, "low": 50}),
    "error_retention": lambda s, d: M.retained(M.error_groups(_ev(s, d), "event_type", "user_id"), 1704067200 + 86400 * 14, 100),
    "top_models": lambda s, d: M.top_keys(_ev(s, d), "user_id", F.round(F.sum("value"), 3), 10),
    "budget_use": lambda s, d: M.budget_use(_ev(s, d), "user_id", 100.0, 2000.0),
    "recent_efficiency": lambda s, d: M.recent_efficiency(_ev(s, d), "user_id", F.col("event_type") == "error"),
    "best_keys": lambda s, d: M.best_keys(_ev(s, d), "user_id", F.col("event_type") == "error"),
    "adaptive_batch": lambda s, d: M.adaptive_batch(_ev(s, d), "event_type", 32, 1000.0),
    "down_sampled": lambda s, d: M.down_sampled(_ev(s, d), "user_id", 6 * 3600),
    "smoothed_values": lambda s, d: M.smoothed(_ev(s, d), "event_type"),
    "daily_report": lambda s, d: M.daily_extremes(_ev(s, d)),
    "request_spikes": lambda s, d: M.request_spikes(_ev(s, d), 3600, 1.3),
    "alert_page": lambda s, d: M.tiered_alerts(_ev(s, d), "value", {"critical": 90.0}).join(_ev(s, d).select("event_id", "ts"), "event_id").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "severity"),
    "recent_usage": lambda s, d: _ev(s, d).where(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n")),
    "prop_labels": lambda s, d: _ev(s, d).groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n")),
}

_GROUP = "md5(event_type || ':' || user_id::varchar)[1:16]"
ORACLES = {
    "usage_summary": "SELECT event_type, device, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS successes, round(avg((event_type <> 'error')::int::double), 6) AS success_rate, round(sum(value) FILTER (event_type <> 'error'), 4) AS value_sum FROM (SELECT *, user_id % 10 AS device FROM events) GROUP BY GROUPING SETS ((), (event_type), (device))",
    "model_stats": "SELECT event_type, count(*) AS requests, count(*) FILTER (user_id % 7 = 0) AS failures, floor(epoch(min(ts)))::bigint AS first_used, floor(epoch(max(ts)))::bigint AS last_used, round(avg(value) FILTER (user_id % 7 <> 0), 6) AS mean_value FROM events GROUP BY 1",
    "rollup_hourly": "SELECT strftime(ts, '%Y-%m-%d-%H') AS bucket, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "rollup_daily": "SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "rollup_monthly": "SELECT strftime(ts, '%Y-%m') AS bucket, user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "performance_trend": "SELECT strftime(ts, '%Y-%m-%d-%H') AS bucket, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "error_rate_alerts": "SELECT * FROM (SELECT event_id, user_id, count(*) OVER w AS n, round(avg((event_type = 'error')::int::double) OVER w, 6) AS rate FROM (SELECT *, floor(epoch(ts))::bigint AS second FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) WHERE n >= 3 AND rate > 0.4",
    "tiered_alerts": "SELECT event_id, value, CASE WHEN value > 90 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE value > 80",
    "counter_running": "SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS counter FROM events",
    "gauge_last": "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "histogram_bins": "SELECT event_type, floor(value / 10)::bigint AS bin, count(*) AS n FROM events GROUP BY 1, 2",
    "timer_stats": "WITH r AS (SELECT event_type, list_sort(list(value)) AS x FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 1000 GROUP BY 1) SELECT event_type, n, least, most, mean, x[floor(len(x) * 0.5)::int + 1] AS p50, x[floor(len(x) * 0.95)::int + 1] AS p95, x[floor(len(x) * 0.99)::int + 1] AS p99 FROM (SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1) JOIN r USING (event_type)",
    "exclusive_quantiles": "WITH s AS (SELECT event_type, list_sort(list(value)) AS x, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, greatest(1, least(floor((n + 1) * 0.95), n - 1)) AS a, greatest(1, least(floor((n + 1) * 0.99), n - 1)) AS b, greatest(1, least(floor((n + 1) * 0.5), n - 1)) AS c FROM s) SELECT event_type, round(x[a::int] * (1 - ((n + 1) * 0.95 - a)) + x[a::int + 1] * ((n + 1) * 0.95 - a), 6) AS p95, round(x[b::int] * (1 - ((n + 1) * 0.99 - b)) + x[b::int + 1] * ((n + 1) * 0.99 - b), 6) AS p99, round(x[c::int] * (1 - ((n + 1) * 0.5 - c)) + x[c::int + 1] * ((n + 1) * 0.5 - c), 6) AS median FROM p",
    "monthly_costs": "SELECT month, event_type AS model, requests, round(cost, 4) AS cost, round(total, 4) AS total, round(cost / total, 6) AS share FROM (SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS requests, sum(value) AS cost, sum(sum(value)) OVER (PARTITION BY strftime(ts, '%Y-%m')) AS total FROM events GROUP BY 1, 2)",
    "counts_by_each": "SELECT kind, value, n, (row_number() OVER (PARTITION BY kind ORDER BY n DESC, value NULLS FIRST))::int AS place FROM (SELECT 'source' AS kind, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2)",
    "error_groups": f"SELECT {_GROUP} AS error_hash, count(*) AS n, floor(epoch(max(ts)))::bigint AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1",
    "error_threshold_alerts": f"SELECT * FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM (SELECT {_GROUP} AS error_hash, count(*) AS n, floor(epoch(max(ts)))::bigint AS last_seen FROM events GROUP BY 1)) WHERE n >= CASE severity WHEN 'high' THEN 5 ELSE 50 END",
    "error_retention": f"SELECT {_GROUP} AS error_hash, count(*) AS n, floor(epoch(max(ts)))::bigint AS last_seen FROM events GROUP BY 1 HAVING last_seen >= 1704067200 + 86400 * 14 ORDER BY last_seen DESC, error_hash LIMIT 100",
    "top_models": "SELECT user_id, round(sum(value), 3) AS metric FROM events GROUP BY 1 ORDER BY metric DESC, user_id LIMIT 10",
    "budget_use": "SELECT *, CASE WHEN day_total > 100 OR month_total > 2000 THEN 'over' WHEN day_total > 80 OR month_total > 1600 THEN 'near' ELSE 'within' END AS state FROM (SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS day_total, round(sum(value) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS month_total FROM events)",
    "recent_efficiency": "SELECT user_id, round(s, 6) AS success, round(c, 6) AS cost, round(s / (c + 0.001), 6) AS efficiency FROM (SELECT user_id, avg((event_type <> 'error')::int::double) AS s, avg(value) AS c, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20 GROUP BY 1) WHERE n >= 10",
    "best_keys": "WITH m AS (SELECT user_id, avg(value) AS mean, count(*) AS n, avg((event_type <> 'error')::int::double) AS rate FROM events GROUP BY 1) SELECT (SELECT user_id FROM m ORDER BY mean DESC, user_id LIMIT 1) AS by_mean, (SELECT user_id FROM m ORDER BY n DESC, user_id LIMIT 1) AS by_count, (SELECT user_id FROM m ORDER BY rate DESC, user_id LIMIT 1) AS by_rate",
    "adaptive_batch": "SELECT event_id, event_type, round(CASE WHEN count(value) OVER w < 3 THEN 32.0::double ELSE greatest(16.0::double, least(64.0::double, 32.0::double + 0.1::double * (1000.0::double / greatest(abs(avg(value) OVER w), 0.001::double) - 32))) END, 4) AS batch_size FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "daily_report": "SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "request_spikes": "WITH b AS (SELECT (floor(floor(epoch(ts)) / 3600) * 3600)::bigint AS start, count(*) AS n FROM events GROUP BY 1) SELECT start, n FROM b WHERE n > 1.3 * (SELECT avg(n) FROM b)",
    "alert_page": "SELECT event_id, 'critical' AS severity FROM events WHERE value > 90 ORDER BY ts DESC, event_id LIMIT 100",
    "recent_usage": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1",
    "prop_labels": "SELECT json_extract(props, '$.k')::int AS k, count(*) AS n FROM events GROUP BY 1",
}
# the next record kept is the first one an interval after the last
ORACLES["down_sampled"] = "WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, floor(epoch(ts))::bigint AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS p FROM events), j AS MATERIALIZED (SELECT a.user_id, a.p, min(b.p) AS nx FROM e a JOIN e b ON b.user_id = a.user_id AND b.s >= a.s + 21600 GROUP BY 1, 2), r AS (SELECT user_id, 1::bigint AS p FROM e WHERE p = 1 UNION ALL SELECT r.user_id, j.nx FROM r JOIN j ON j.user_id = r.user_id AND j.p = r.p) SELECT user_id, event_id FROM r JOIN e USING (user_id, p)"
ORACLES["smoothed_values"] = "WITH RECURSIVE d AS MATERIALIZED (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS p, count(*) OVER (PARTITION BY event_type) AS n, m FROM (SELECT event_type, ts::date AS day, avg(value) AS m FROM events GROUP BY 1, 2)), r AS (SELECT event_type, p, n, m AS x FROM d WHERE p = 1 UNION ALL SELECT r.event_type, d.p, d.n, 0.7::double * x + 0.3::double * d.m FROM r JOIN d ON d.event_type = r.event_type AND d.p = r.p + 1) SELECT event_type, round(x, 6) AS smoothed FROM r WHERE p = n"
for _name, _key, _tol in (("trend_classes", "user_id", 0.1), ("batch_trend_classes", "event_type", 0.05)):
    ORACLES[_name] = f"SELECT {_key}, round(a, 6) AS recent_mean, CASE WHEN n < 10 THEN 'unknown' WHEN a > b * {1 + _tol} THEN 'rising' WHEN a < b * {1 - _tol} THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT {_key}, count(*) AS n, avg(value) FILTER (place <= 5) AS a, avg(value) FILTER (place > 5) AS b FROM (SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10 GROUP BY 1)"
