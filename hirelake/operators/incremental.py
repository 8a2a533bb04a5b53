"""Incremental intake: what a poll changes, and how much of it a run takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.text import BLANK, trim_blank
from hirelake.functions.urls import description_hash

NOT_BLANK = BLANK.replace("[", "[^", 1)


def actions(stored: DataFrame, incoming: DataFrame, key: str, text: str) -> DataFrame:
    """incoming with action insert, update or skip: by key, and by the hash of the text. stored: key and hash."""
    d = incoming.withColumn("hash", description_hash(F.col(text)))
    old = stored.select(key, F.col("hash").alias("old_hash"))
    d = d.join(old, key, "left")
    return d.withColumn("action", F.when(F.col("old_hash").isNull(), "insert").when(F.col("old_hash") == F.col("hash"), "skip").otherwise("update"))


def capped(df: DataFrame, is_new: Column, most: int, order: list[str], group: str | None = None) -> DataFrame:
    """The rows before the budget of new ones is spent; of a key only its first row is new. The budget is shared by all
    rows of a group in the given order, or by all rows. Then the row at which it is spent is found by a top-k of the new
    ones, and no task holds the whole table."""
    if group is None:
        # the last new row that is taken is the `most`-th; rows up to the next new one are taken too
        new = df.filter(F.coalesce(is_new, F.lit(False))).select(F.struct(*order).alias("_o")).orderBy("_o").limit(most)
        last = new.agg(F.max("_o").alias("_last"), F.count(F.lit(1)).alias("_n"))
        at = df.withColumn("_at", F.struct(*order)).join(F.broadcast(last))  # one row
        return at.filter((F.col("_n") < most) | (F.col("_at") <= F.col("_last"))).drop("_at", "_last", "_n")
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.when(is_new, 1).otherwise(0)).over(w), F.lit(0))
    return df.withColumn("_spent", spent).filter(F.col("_spent") < most).drop("_spent")


def poll_summary(runs: DataFrame) -> DataFrame:
    """total, ok and failed runs with the sums of their counters."""
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "new_jobs", "filtered")))


def queue(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The oldest pending jobs."""
    return jobs.filter("match_status = 'pending'").orderBy("discovered", "id").limit(n)


def cascade_delete(gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each child table without the rows whose parent is gone. children: name to (table, foreign key)."""
    return {name: t.join(gone.select(F.col(key).alias(fk)), fk, "left_anti") for name, (t, fk) in children.items()}


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_kept: lines that hold something, and of these the ones that no other document of the source has.
    docs: doc_id, source, text; a document may be several rows. A line that one document has tells whose it is and how often
    it is there, so counts need no join with the lines, and a frequent line is one row of partial sums. Lines travel as 128 bits."""
    filled = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))
    total = docs.select("doc_id", F.size(filled).cast("long").alias("n_lines"), F.when(F.col("source").isNull(), F.size(filled)).otherwise(0).cast("long").alias("n_kept"))
    lines = docs.filter("source is not null").select("doc_id", "source", F.explode(F.transform(filled, lambda x: F.unhex(F.md5(trim_blank(x))))).alias("key"))
    named = F.col("doc_id").isNotNull()
    one = lines.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.count_if(named).alias("n"), F.count_if(~named).alias("unnamed"))
    one = one.filter("doc_id is null or doc_id = last")
    none = F.lit(None).cast(dict(docs.dtypes)["doc_id"])
    kept = one.select(F.inline(F.array(F.struct("doc_id", "n"), F.struct(none.alias("doc_id"), F.col("unnamed").alias("n"))))).filter("n > 0")
    d = total.filter("n_lines > 0").unionByName(kept.select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.col("n").alias("n_kept")))
    return d.groupBy("doc_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_kept").alias("n_kept"))
