"""Connected components of a link table by alternating stars, in jobs that each shuffle the links twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import made, materialise, settle

MOST_ROUNDS = 60


def _rewire(links: DataFrame, large: bool) -> DataFrame:
    """Large star: of each node's neighbours, those above it are hung on the least. Small star: those below it and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    hung = both.join(least, "a")
    if large:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    moved = hung.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.filter("a <> low").select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b of one orderable type. Gives node and component, the least node it is linked with; nodes without links are not in it."""
    since = len(made())
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        now = settle(_rewire(_rewire(now, True), False), "links", since)
        # done when the links are stars: no node hangs on two, and what nodes hang on hangs on nothing
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        inner = now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi")
        if twice.unionByName(inner).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
