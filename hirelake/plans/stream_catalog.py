"""Queries on the states of runs, with SQL that steps through the reports one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import poll_runs
from hirelake.plans.catalog import query, table

NOW, LIMIT = "2024-01-31 00:00:00", 129_600
EVENTS = {"signup": "queued", "view": "started", "click": "board", "purchase": "completed", "error": "failed"}  # a user's week is a run


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t, seq) AS n FROM (
        SELECT user_id || '-' || CAST(floor(epoch(ts) / 604800) AS BIGINT) AS run, ts AS t, event_id AS seq, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENTS.items())} END AS event,
        CAST(floor(value) AS BIGINT) AS found, event_id % 5 AS new_jobs, event_id % 3 AS filtered, 'e' || event_id % 4 AS error FROM events)),
    s AS (SELECT DISTINCT run, 0::BIGINT AS n, 'none' AS status, NULL::TIMESTAMP AS last, NULL::TIMESTAMP AS queued, NULL::TIMESTAMP AS started, NULL::TIMESTAMP AS ended, 0::BIGINT AS found, 0::BIGINT AS new_jobs, 0::BIGINT AS filtered, NULL::VARCHAR AS error FROM r
        UNION ALL
        SELECT run, n, CASE act WHEN 'queued' THEN 'pending' WHEN 'started' THEN 'running' WHEN 'late' THEN 'timed_out' WHEN 'completed' THEN act WHEN 'failed' THEN act ELSE status END,
            CASE WHEN act IS NULL OR act = 'late' THEN last ELSE t END, CASE WHEN act = 'queued' THEN t ELSE queued END, CASE WHEN act = 'started' THEN t ELSE started END,
            CASE WHEN act = 'late' THEN last + INTERVAL {LIMIT} SECOND WHEN act IN ('completed', 'failed') THEN t ELSE ended END,
            found + CASE WHEN act = 'board' THEN f ELSE 0 END, new_jobs + CASE WHEN act = 'board' THEN nj ELSE 0 END, filtered + CASE WHEN act = 'board' THEN fi ELSE 0 END,
            CASE act WHEN 'late' THEN 'no report in time' WHEN 'failed' THEN e ELSE error END
        FROM (SELECT s.*exclude (n), r.n, r.t, r.found AS f, r.new_jobs AS nj, r.filtered AS fi, r.error AS e,
            CASE WHEN status = 'none' THEN CASE WHEN event = 'queued' THEN event END WHEN status NOT IN ('pending', 'running') THEN NULL WHEN t > last + INTERVAL {LIMIT} SECOND THEN 'late'
                WHEN event = 'started' AND status = 'pending' THEN event WHEN event = 'board' AND status = 'running' THEN event WHEN event = 'failed' OR (event = 'completed' AND status = 'running') THEN event END AS act
            FROM s JOIN r ON r.run = s.run AND r.n = s.n + 1)),
    z AS (SELECT *, status IN ('pending', 'running') AND TIMESTAMP '{NOW}' > last + INTERVAL {LIMIT} SECOND AS silent FROM s WHERE status <> 'none' QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1)
    SELECT run, CASE WHEN silent THEN 'timed_out' ELSE status END AS status, queued, started, CASE WHEN silent THEN last + INTERVAL {LIMIT} SECOND ELSE ended END AS ended, found, new_jobs, filtered, CASE WHEN silent THEN 'no report in time' ELSE error END AS error FROM z"""
)
def poll_run_states(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    week = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604_800)
    event = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in EVENTS.items()))
    counts = {"found": F.floor("value").cast("long"), "new_jobs": F.col("event_id") % 5, "filtered": F.col("event_id") % 3, "error": F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string"))}
    reports = events.select(F.concat_ws("-", "user_id", week.cast("string")).alias("run"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), event.alias("event"), *(c.alias(k) for k, c in counts.items()))
    return poll_runs.run_states(reports, F.lit(NOW).cast(events.schema["ts"].dataType), LIMIT)
