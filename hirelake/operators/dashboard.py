"""Counts over the tables of a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRONG = ["excellent", "strong"]
INTERVIEWS = ["recruiter_screen", "technical_interview", "final_interview"]


def count_where(**tests: Column) -> list[Column]:
    return [F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()]


def stats(jobs: DataFrame, applications: DataFrame, boards: DataFrame, week_ago: Column) -> DataFrame:
    """One row. jobs: status, saved, classification (of the newest analysis), discovered; applications: status;
    boards: polled, new_jobs, filtered."""
    active = jobs.filter("status <> 'dismissed'")
    strong = F.col("classification").isin(STRONG)
    a = active.agg(F.count(F.lit(1)).alias("total_jobs"), *count_where(saved_jobs=F.col("saved"), strong_matches=strong, new_this_week=F.col("discovered") >= week_ago, strong_unseen=strong & ~F.col("saved")))
    b = applications.agg(*count_where(applied=F.col("status") == "applied", interviews=F.col("status").isin(INTERVIEWS), offers=F.col("status") == "offer"))
    c = boards.agg(*count_where(boards_needing_attention=F.col("polled").isNull() | ((F.col("new_jobs") == 0) & (F.col("filtered") == 0))))
    return a.crossJoin(b).crossJoin(c)  # one row each


def board_health(boards: DataFrame, jobs: DataFrame, url: str = "url") -> DataFrame:
    """Adds job_count and consider_removing (polled, no jobs, nothing new)."""
    n = jobs.filter(F.col(url).isNotNull()).groupBy(url).agg(F.count(F.lit(1)).alias("job_count"))
    d = boards.join(n, url, "left").withColumn("job_count", F.coalesce("job_count", F.lit(0)))
    return d.withColumn("consider_removing", F.col("polled").isNotNull() & (F.col("job_count") == 0) & (F.coalesce("new_jobs", F.lit(0)) == 0))


def signals_by(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """For each key how many rows have each flag, and whether any has."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"{name}_count") for name, c in flags.items()]
    return df.groupBy(key).agg(*counts).select("*", *((F.col(f"{n}_count") > 0).alias(f"has_{n}") for n in flags))


def with_all_statuses(counted: DataFrame, statuses: DataFrame, column: str) -> DataFrame:
    """One row per status of the fixed list, 0 where nothing has it."""
    return statuses.join(counted, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
