"""What became of poll runs, from the reports they send.

A run is queued, starts, reports each board it has polled, and is completed or fails; it may fail before it starts. A
second start, reports of what has not been queued or started, and reports after the end don't count. A run that says
nothing for longer than a time limit has timed out at the end of that limit, and what it says later doesn't count
either. streaming.poll_runs keeps the same states as reports come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENDS = ("completed", "failed")
COUNTS = ("found", "new_jobs", "filtered")
STATES = "run string, status string, queued timestamp, started timestamp, ended timestamp, found long, new_jobs long, filtered long, error string"


def _count(test: Column, over) -> Column:
    return F.coalesce(F.count_if(test).over(over), F.lit(0))


def counted_reports(reports: DataFrame) -> DataFrame:
    """The reports that count, as if there were no time limit. reports: run, at, seq (order among equal times), event (queued,
    started, board, completed or failed), found, new_jobs, filtered and error."""
    w = W.partitionBy("run").orderBy("at", "seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    is_ = lambda *events: F.col("event").isin(*events)
    d = reports.withColumn("_queued", _count(is_("queued"), before))
    d = d.withColumn("_started", _count(is_("started") & (F.col("_queued") > 0), before))
    ends = (is_("failed") & (F.col("_queued") > 0)) | (is_("completed") & (F.col("_started") > 0))
    d = d.withColumn("_ended", _count(ends, before)).filter("_ended = 0")
    first = (is_("queued") & (F.col("_queued") == 0)) | (is_("started") & (F.col("_queued") > 0) & (F.col("_started") == 0))
    return d.filter(first | ends | (is_("board") & (F.col("_started") > 0))).drop("_queued", "_started", "_ended")


def run_states(reports: DataFrame, now: Column, limit_seconds: int) -> DataFrame:
    """One row a run that was queued, as of `now`: STATES. A run's counters are those of the boards it reported in time."""
    w = W.partitionBy("run").orderBy("at", "seq")
    limit = F.make_dt_interval(secs=F.lit(limit_seconds))
    d = counted_reports(reports).withColumn("_until", F.col("at") + limit)
    over = F.coalesce(F.lead("at").over(w), now) > F.col("_until")
    d = d.withColumn("_late", F.when(F.col("event").isin(*ENDS), False).otherwise(over))
    d = d.withColumn("_over", _count(F.col("_late"), w.rowsBetween(W.unboundedPreceding, -1))).filter("_over = 0")
    one = d.groupBy("run").agg(
        F.max_by(F.struct("event", "at", "error", "_late", "_until"), F.struct("at", "seq")).alias("_last"),
        *(F.min(F.when(F.col("event") == e, F.col("at"))).alias(e) for e in ("queued", "started")),
        *(F.coalesce(F.sum(F.when(F.col("event") == "board", F.col(c))), F.lit(0)).cast("long").alias(c) for c in COUNTS),
    )
    last, ended = F.col("_last"), F.col("_last.event").isin(*ENDS)
    status = F.when(last["_late"], "timed_out").when(ended, last["event"]).when(F.col("started").isNotNull(), "running").otherwise("pending")
    end = F.when(last["_late"], last["_until"]).when(ended, last["at"])
    error = F.when(last["_late"], "no report in time").when(last["event"] == "failed", F.coalesce(last["error"], F.lit("failed")))
    return one.select("run", status.alias("status"), "queued", "started", end.alias("ended"), *COUNTS, error.alias("error"))
