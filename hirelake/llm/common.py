"""Shared pieces: reading tables, scratch space that all executors see, words and digests."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: a blank and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, else the checkpoint folder of the context. Where neither is set, a
    temporary folder if all of Spark runs in one process, as in tests, else an error: executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hirelake-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_made = threading.local()


def made() -> list[str]:
    """The scratch paths that this thread has made and not dropped."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def scratch_path(spark: SparkSession, tag: str) -> str:
    made().append(f"{scratch_root(spark)}/hirelake/{tag}-{uuid.uuid4().hex}")
    return made()[-1]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables; what still reads from them becomes unusable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    made()[:] = [p for p in made() if p not in set(paths)]


def settle(df: DataFrame, tag: str, since: int, batch_rows: int | None = None) -> DataFrame:
    """materialise(), then drop the scratch tables that were made since made() had `since` entries, which df was the last to need."""
    old = made()[since:]
    out = materialise(df, tag, batch_rows)
    drop_scratch(df.sparkSession, old)
    return out


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors, runs once.
    batch_rows: how many rows go to Python at a time, where they hold long texts."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows (counted here unless given); larger ones are shuffled."""
    rows = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null or blank texts."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(none)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def free_names(taken, *bases: str) -> dict[str, str]:
    """A free name for each base; the names differ from one another too."""
    out: dict[str, str] = {}
    for base in bases:
        out[base] = free_name([*taken, *out.values()], base)
    return out


def free_name(taken, base: str) -> str:
    """A column name that no column of the input has, whatever its letter case."""
    lower, name = {c.lower() for c in taken}, base
    while name.lower() in lower:
        name += "_"
    return name
