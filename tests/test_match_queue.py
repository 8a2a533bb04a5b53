import time
from collections import Counter

import pytest

from hirelake.streaming import match_queue
from hirelake.streaming.poll_runs import use_rocks


class Queue:
    """A running queue that is sent messages and gives what it says to each."""

    def __init__(self, spark, folder, name, lease_ms, pause_ms):
        use_rocks(spark)
        self.spark, self.folder, self.name, self.seen, self.sent, self.read = spark, folder, name, Counter(), 0, {}
        spark.createDataFrame([], match_queue.MESSAGES).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(match_queue.MESSAGES).parquet(f"{folder}/in")
        out = match_queue.claims(stream, lease_ms, pause_ms)
        # one file is one micro-batch
        self.query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(processingTime="200 milliseconds").start()

    def send(self, *messages):
        rows = [(*m, None, None, None, None)[:5] for m in messages]
        rows = [(u, kind, job, attempt, worker, i) for i, (u, kind, job, attempt, worker) in enumerate(rows)]
        self.spark.createDataFrame(rows, match_queue.MESSAGES).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.sent += len(rows)
        until = time.time() + 60
        while sum(self.read.values()) < self.sent and time.time() < until:  # batches without input never end, so there is nothing to wait for but these rows
            assert self.query.exception() is None
            time.sleep(0.2)
            self.read |= {p.batchId: p.numInputRows for p in self.query.recentProgress}
        now = Counter(tuple(r) for r in self.spark.table(self.name).select("event", "job", "attempt", "worker").collect())
        new, self.seen = now - self.seen, now
        return sorted(new.elements())


@pytest.fixture
def queue(spark, tmp_path):
    """Makes a queue; its stream ends with the test."""
    made = []

    def make(*args):
        made.append(Queue(spark, str(tmp_path), f"claims{len(spark.catalog.listTables())}", *args))
        return made[-1]

    yield make
    for q in made:
        q.query.stop()


def test_leases(queue):
    q = queue(20_000, 100)
    jobs = [f"job{i}" for i in range(12)]
    assert q.send(*(("u", "queue", j) for j in jobs)) == []
    first = q.send(("u", "ask", None, None, "w1"), ("u", "ask", None, None, "w2"))
    assert 1 <= len(first) <= match_queue.LANES and all(e == "claim" and a == 1 and w == "w1" for e, _, a, w in first)
    took = [j for _, j, _, _ in first]
    assert q.send(("u", "ask", None, None, "w2")) == []  # every lane is at work
    done = q.send(("u", "done", took[0], 1, "w1"), ("u", "done", took[1], 1, "w2"), ("u", "ask", None, None, "w2"))
    assert ("done", took[0], 1, "w1") in done and not [x for x in done if x[0] == "done" and x[1] != took[0]]  # w2 does not hold took[1]
    second = [j for e, j, _, _ in done if e == "claim"]
    assert len(second) <= 1 and not set(second) & set(took)
    time.sleep(21)  # the workers have crashed: all leases end
    open_ = sorted({*took[1:], *second})
    lapsed = q.send(("u", "ask", None, None, "w3"))
    assert sorted(j for e, j, a, _ in lapsed if e == "waits" and a == 1) == open_
    time.sleep(1)
    said = [x for x in lapsed if x[0] == "claim"]
    q.send(*(("u", "done", j, a, w) for _, j, a, w in said))
    assert q.send(("u", "done", open_[0], 1, "w1")) == []  # too late: the lease was over
    claimed = Counter((j, a) for e, j, a, _ in q.send(("u", "ask", None, None, "w4")) if e == "claim")
    assert all(n == 1 for n in claimed.values())
    everything = Counter((j, a) for e, j, a, _ in q.seen.elements() if e == "claim")
    assert max(everything.values()) == 1  # no attempt is given to two


def test_gives_up(queue):
    q = queue(300_000, 1)
    said = q.send(("u", "queue", "x"), ("v", "queue", "x"), ("u", "ask", None, None, "w"))
    assert said == [("claim", "x", 1, "w")]
    for attempt in (1, 2):
        assert q.send(("u", "failed", "x", attempt, "w")) == [("waits", "x", attempt, "w")]
        assert q.send(("u", "ask", None, None, "w")) == [("claim", "x", attempt + 1, "w")]
    assert q.send(("u", "failed", "x", 3, "w")) == [("gave_up", "x", 3, "w")]
    assert q.send(("u", "ask", None, None, "w")) == []
    assert q.send(("v", "ask", None, None, "w")) == [("claim", "x", 1, "w")]
