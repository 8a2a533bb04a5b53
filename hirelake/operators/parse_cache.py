"""What resumes were parsed to, kept by content: a table in buckets of the key that look-ups don't move.

The key is a digest of user, content and version of the parser, so another version is another entry. Entries are only added;
of several under one key the newest counts. The table is bucketed and sorted by the key: a look-up shuffles the documents
that ask, into as many buckets, and reads the table where it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64
ENTRY = "key string, user string, hash string, version string, created long, parsed string"


def cache_key(user: Column, content_hash: Column, version: Column) -> Column:
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in (user, content_hash, version)]
    return F.sha2(F.concat(*parts), 256)


class ParseCache:
    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            self._add(spark.createDataFrame([], ENTRY))

    def _add(self, entries: DataFrame) -> None:
        placed = entries.repartition(self.buckets, "key")
        placed.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).mode("append").format("parquet").saveAsTable(self.name)

    def add(self, parsed: DataFrame) -> None:
        """parsed: user, hash, version, created and parsed."""
        key = cache_key(F.col("user"), F.col("hash"), F.col("version"))
        self._add(parsed.select(key.alias("key"), "user", "hash", "version", F.col("created").cast("long").alias("created"), "parsed"))

    def look_up(self, docs: DataFrame, version: str) -> DataFrame:
        """docs (user, hash and more) with parsed and created of the newest entry; null where there is none of this version."""
        newest = W.partitionBy("key").orderBy(F.col("created").desc(), F.col("parsed").desc())
        known = self.spark.table(self.name).select("key", "created", "parsed").withColumn("_no", F.row_number().over(newest)).filter("_no = 1").drop("_no")
        asked = docs.withColumn("key", cache_key(F.col("user"), F.col("hash"), F.lit(version)))
        return asked.hint("shuffle_merge").join(known, "key", "left").drop("key")
