"""The corpus pipeline: each stage takes what the one before kept and its decisions take effect."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import decontam, mixing, ngram_join, quality, sharding
from hirelake.llm.common import drop_scratch, made, read, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_own = threading.local()  # scratch tables of the stage that this thread has called last by STAGES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of 5-word shingles one stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def sharding_by_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in shards of nearly equal bytes: size, shard and slot are added."""
    return sharding.shard(docs)


WORK: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", sharding_by_bytes),
]


def _stage(work: Stage) -> Stage:
    """A stage called by itself: what it returns is written before the next stage is called, which then drops the scratch
    tables that it read."""

    @functools.wraps(work)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, getattr(_own, "left", []))
        _own.left, since = [], len(made())
        out = work(spark, docs, sf_dir)
        _own.left = made()[since:]
        return out

    return called


STAGES: list[tuple[str, Stage]] = [(name, _stage(work)) for name, work in WORK]

#: Expectation-maximisation and dependent rounding have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Once a stage is written, its scratch tables and its input go; those that the result
    itself reads stay. Runs share nothing, so one may begin before the result of another has been read."""
    docs, since = read(spark, sf_dir, "documents"), len(made())
    for name, work in WORK[:-1]:
        docs = settle(work(spark, docs, sf_dir), f"pipeline-{name}", since)
    return WORK[-1][1](spark, docs, sf_dir)
