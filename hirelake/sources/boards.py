"""Board payloads from files: one row per board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """provider, url, file and payload of the files named <provider>-<anything>.json under a path that Spark reads; the payload is the whole file."""
    d = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return d.select(F.lower(F.regexp_extract("file", r"^([A-Za-z]+)", 1)).alias("provider"), F.col("_metadata.file_path").alias("url"), "file", F.col("value").alias("payload"))


def fetch(spark: SparkSession, boards: DataFrame, path: str) -> DataFrame:
    """boards (provider, url, file) with payload and error: not_found where there is no such file under the path, invalid
    where it holds no JSON, else null. A board that can't be read stays as a row, so that a poll can count it."""
    found = read_payloads(spark, path).select("file", "payload")
    d = boards.join(found, "file", "left")
    parsed = F.try_parse_json("payload")
    return d.withColumn("error", F.when(F.col("payload").isNull(), "not_found").when(parsed.isNull(), "invalid"))
