"""Verification of boards: when each may be asked, and what an answer means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.sources.shared import stored

# How many boards of a provider are asked at a time, and the pause after that, in milliseconds.
RATES = {"greenhouse": (20, 150), "lever": (15, 200), "ashby": (5, 400)}


def schedule(boards: DataFrame, done: DataFrame | None = None, rates: dict[str, tuple[int, int]] = RATES) -> DataFrame:
    """boards (id, provider, each id once) that are not done yet, with slot (from 0) and start_ms: a provider's boards in the
    order of their ids, as many to a slot as it allows. A run that is taken up again passes the ids it has done.

    A board's place among those of its provider is the number of that provider's boards in earlier ranges of ids, plus its
    place in its own range; so three providers make no three tasks."""
    d = boards.filter(F.col("provider").isin(*rates))
    d = d if done is None else d.join(done.select("id"), "id", "left_anti")
    placed = d.repartitionByRange("provider", "id").sortWithinPartitions("provider", "id").withColumn("_at", F.monotonically_increasing_id())
    placed = stored(boards.sparkSession, placed, "boards").withColumn("_part", F.shiftright("_at", 33))
    parts = stored(boards.sparkSession, placed.groupBy("provider", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low")), "board-parts")
    # one row for each range and provider it has
    over = W.partitionBy("provider").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    d = placed.join(parts.select("provider", "_part", "_low", F.sum("_n").over(over).alias("_before")), ["provider", "_part"])
    rank = F.coalesce("_before", F.lit(0)) + F.col("_at") - F.col("_low")
    at_once = F.coalesce(*(F.when(F.col("provider") == p, n) for p, (n, _) in rates.items()))
    pause = F.coalesce(*(F.when(F.col("provider") == p, ms) for p, (_, ms) in rates.items()))
    slot = F.floor(rank / at_once).cast("long")
    return d.select(*boards.columns, slot.alias("slot"), (slot * pause).alias("start_ms"))


def status(error: Column, job_count: Column, provider: Column | None = None) -> Column:
    """What an answer says about a board: verified, empty, unavailable, invalid, rate_limited or verification_failed."""
    known = F.lit(True) if provider is None else provider.isin(*RATES)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "verification_failed")
        .when(error.rlike("(?i)timed out"), "unavailable")
        .when(error.rlike("(?i)404|not found"), "invalid")
        .when(error.rlike("(?i)429|rate limit"), "rate_limited")
        .when(error.isNotNull(), "verification_failed")
        .when(F.coalesce(job_count, F.lit(0)) == 0, "empty")
        .otherwise("verified")
    )
