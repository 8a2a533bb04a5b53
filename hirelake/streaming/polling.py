"""Incremental polls as Structured Streaming: each micro-batch of postings is compared with the stored table by content
hash, and what changed is written. Late and repeated postings change nothing.

The stored table is a base and the changes of later batches, each a folder of Parquet files that no one writes to
again. A small file in `_commits`, moved into place once a folder is complete, makes it part of the table. A batch that
runs again after a crash finds its file there and has nothing to do; without the file it writes a new folder, and
what the first attempt left is never read. Every COMPACT batches the table becomes a new base, and folders older than
the base before that go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelake.functions.urls import description_hash
from hirelake.operators.feed import latest
from hirelake.operators.incremental import actions

COMPACT = 20
BROADCAST_ROWS = 100_000  # keys of a batch; larger batches are joined by shuffle


class Commits:
    """The commit files under a path: <batch>.changes and <batch>.base, each with the name of its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm, conf = path.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.store = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def listed(self) -> list[tuple[int, str, str]]:
        """(batch, kind, file name), oldest first."""
        root = self._at("_commits")
        names = [s.getPath().getName() for s in self.store.listStatus(root)] if self.store.exists(root) else []
        return sorted((int(n.split(".")[0]), n.split(".")[1], n) for n in names if n.endswith((".base", ".changes")))

    def folder(self, name: str) -> str:
        stream = self.store.open(self._at(f"_commits/{name}"))
        try:
            return f"{self.path}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def done(self, batch: int, kind: str) -> bool:
        return self.store.exists(self._at(f"_commits/{batch:012d}.{kind}"))

    def write(self, df: DataFrame, batch: int, kind: str) -> None:
        folder = f"{kind}-{batch:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        temp = self._at(f"_commits/.{folder}")
        stream = self.store.create(temp, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        self.store.rename(temp, self._at(f"_commits/{batch:012d}.{kind}"))

    def drop_before(self, batch: int) -> None:
        """Deletes what the base of this batch has replaced: its commit files first, then all folders of earlier batches."""
        for n, kind, name in self.listed():
            if n < batch or (n == batch and kind == "changes"):
                self.store.delete(self._at(f"_commits/{name}"), False)
        for s in self.store.listStatus(self._at("")):
            parts = s.getPath().getName().split("-")
            if parts[0] in ("base", "changes") and (int(parts[1]) < batch or (int(parts[1]) == batch and parts[0] == "changes")):
                self.store.delete(s.getPath(), True)


def stored(spark: SparkSession, path: str, schema: str, key: str = "id", before: int | None = None) -> DataFrame:
    """The table under a path, of the batches before `before` if given. schema: of the postings, for a table that is empty."""
    commits = Commits(spark, path)
    listed = [c for c in commits.listed() if before is None or c[0] < before]
    base = max((n for n, kind, _ in listed if kind == "base"), default=-1)
    whole = [commits.folder(name) for n, kind, name in listed if kind == "base" and n == base]
    changed = [commits.folder(name) for n, kind, name in listed if kind == "changes" and n > base]
    out = spark.read.parquet(*whole) if whole else spark.createDataFrame([], f"{schema}, hash string, action string, batch long")
    if not changed:
        return out
    newest = latest(spark.read.parquet(*changed), key, "batch").select(*out.columns)
    return out.join(newest.select(key), key, "left_anti").unionByName(newest)


def poll(incoming: DataFrame, path: str, checkpoint: str, key: str = "id", text: str = "description", order: str = "seen") -> StreamingQuery:
    """Runs until the source has nothing new. Every row of the table has hash, action (of its last change) and batch."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema.fields)

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, path)
        if not commits.done(number, "changes"):
            new = latest(batch, key, order)
            keys = new.select(key)
            small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            # only keys and hashes of the stored rows that the batch speaks of
            old = stored(spark, path, schema, key, number).select(key, "hash").join(F.broadcast(keys) if small else keys, key, "left_semi")
            changed = actions(old, new, key, text).drop("old_hash").filter("action <> 'skip'").withColumn("batch", F.lit(number).cast("long"))
            commits.write(changed.select(*incoming.columns, "hash", "action", "batch"), number, "changes")
        if number % COMPACT == COMPACT - 1 and not commits.done(number, "base"):
            bases = [n for n, kind, _ in commits.listed() if kind == "base" and n < number]
            commits.write(stored(spark, path, schema, key), number, "base")
            if bases:
                commits.drop_before(bases[-1])

    return incoming.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and time window; late rows are taken while the watermark allows. An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: no gap longer than `gap`. An extension."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def hashed(postings: DataFrame, text: str = "description") -> DataFrame:
    return postings.withColumn("hash", description_hash(F.col(text)))
