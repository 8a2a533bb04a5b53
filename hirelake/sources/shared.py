"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir, else in the checkpoint folder of the context. Where neither is
    set, in a temporary folder if all of Spark is one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hirelake-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/hirelake/{tag}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: worked out once, with a lineage that lost executors don't lengthen."""
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
