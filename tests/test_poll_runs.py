import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import incremental, poll_runs
from hirelake.streaming import poll_runs as live

REPORT = "run string, at timestamp, seq long, event string, found long, new_jobs long, filtered long, error string"
START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
LIMIT = 600


def report(run, second, event, found=None, new=None, filtered=None, error=None):
    return (run, START + dt.timedelta(seconds=second), second * 10, event, found, new, filtered, error)


def plain(rows, now):
    """The state machine, one report after the other."""
    runs = {}
    for run, at, _, event, found, new, filtered, error in sorted(rows, key=lambda r: (r[1], r[2])):
        s = runs.get(run)
        if s is None:
            if event == "queued":
                runs[run] = {"status": "pending", "last": at, "counts": [0, 0, 0], "error": None}
            continue
        if s["status"] not in ("pending", "running"):
            continue
        if (at - s["last"]).total_seconds() > LIMIT:
            s |= {"status": "timed_out", "error": "no report in time"}
        elif event == "started" and s["status"] == "pending":
            s |= {"status": "running", "last": at}
        elif event == "board" and s["status"] == "running":
            s |= {"last": at, "counts": [a + (b or 0) for a, b in zip(s["counts"], (found, new, filtered), strict=True)]}
        elif event == "failed" or (event == "completed" and s["status"] == "running"):
            s |= {"status": event, "last": at, "error": (error or "failed") if event == "failed" else None}
    for s in runs.values():
        if s["status"] in ("pending", "running") and (now - s["last"]).total_seconds() > LIMIT:
            s |= {"status": "timed_out", "error": "no report in time"}
    return sorted((k, s["status"], *s["counts"], s["error"] or "") for k, s in runs.items())


def got(df):
    return sorted((r["run"], r["status"], r["found"], r["new_jobs"], r["filtered"], r["error"] or "") for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(2), []
    for n in range(120):
        second = rnd.randrange(2_000)
        for event in [rnd.choice(["queued", "started"]), *rnd.choices(["started", "board", "board", "queued", "completed", "failed"], k=rnd.randrange(8))]:
            out.append(report(f"r{n}", second, event, rnd.choice([None, 1, 5]), rnd.choice([0, 2]), rnd.choice([None, 1]), rnd.choice([None, "oops"]) if event == "failed" else None))
            second += rnd.choice([1, 30, 599, 600, 601, 900])
    return out


def test_states(spark, rows):
    now = START + dt.timedelta(seconds=6_000)
    past = [r for r in rows if r[1] <= now]
    df = poll_runs.run_states(spark.createDataFrame(past, REPORT), F.lit(now), LIMIT)
    assert got(df) == plain(past, now)
    counts = incremental.poll_summary(df).first()
    assert counts["total"] == len(plain(past, now)) and counts["found"] == sum(r[2] for r in plain(past, now))
    assert poll_runs.run_states(spark.createDataFrame([], REPORT), F.lit(now), LIMIT).count() == 0


def test_a_stream_of_reports(spark, rows, tmp_path):
    """The same states from micro-batches, and a silent run is closed by its timer alone."""
    live.use_rocks(spark)
    silent = [report("silent", 10, "queued"), report("silent", 20, "started"), report("silent", 30, "board", 3, 1, 2)]
    rows = sorted([*rows, *silent], key=lambda r: r[1])
    end = [report("clock", 100_000, "queued"), report("clock", 100_001, "started")]  # moves the watermark past every limit
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    parts = [rows[: len(rows) // 2], rows[len(rows) // 2 :], end, [report("clock", 100_002, "completed")]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, REPORT).coalesce(1).write.parquet(str(src / str(n)))
        stream = live.run_changes(spark.readStream.schema(REPORT).parquet(str(src / "*")), LIMIT, "0 seconds", 10**9)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(out)
    order = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    last = changes.groupBy("run").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
    everything = [r for part in parts for r in part]
    assert got(last) == plain(everything, START + dt.timedelta(seconds=100_002))
    closed = changes.filter("run = 'silent' AND status = 'timed_out'").collect()
    assert [(r["found"], r["new_jobs"], r["filtered"]) for r in closed] == [(3, 1, 2)]
    seconds = changes.filter("run = 'silent' AND status = 'timed_out'").select(F.unix_seconds("ended")).first()[0]
    assert seconds == (START + dt.timedelta(seconds=630)).timestamp()
