"""The queue of postings that wait for their match, with leases: what a crashed worker had taken comes back by itself.

Each user has LANES lanes and a posting's hash picks its lane, oldest first. A lane gives out one posting at a time, so a
user has no more than LANES in work, without a counter that lanes share. A claim is a lease: state with a time to
live. A worker reports done or failed; where the lease ends without a report, or the worker failed, the posting waits for
PAUSE, then twice as long after each attempt, and is claimed again, ATTEMPTS times in all. Reports of an attempt whose
lease is over don't count, so that no posting is done twice by two workers' word.

A lane's queue is a map from numbers to postings with a head and a tail, so that taking one touches one entry,
however long the queue is."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from hirelake.streaming.poll_runs import use_rocks

LANES = 3
ATTEMPTS = 3
MESSAGES = "user string, kind string, job string, attempt int, worker string, seq long"
CLAIMS = "user string, lane int, event string, job string, attempt int, worker string"


class Lane(StatefulProcessor):
    def __init__(self, lease_ms: int, pause_ms: int, attempts: int):
        self.lease_ms, self.pause_ms, self.attempts = lease_ms, pause_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "head long, tail long")
        self.queue = handle.getMapState("queue", "at long", "job string")
        self.again = handle.getMapState("again", "job string", "attempt int, due long")
        self.out = handle.getValueState("out", "job string, attempt int, worker string")
        self.lease = handle.getValueState("lease", "job string", self.lease_ms)  # gone when the lease is over

    def close(self) -> None:
        pass

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(())

    def _back(self, job: str, attempt: int, now: int) -> str:
        """A posting whose attempt came to nothing: it waits, or is given up."""
        self.out.clear()
        self.lease.clear()
        if attempt >= self.attempts:
            return "gave_up"
        self.again.updateValue((job,), (attempt, now + self.pause_ms * 2 ** (attempt - 1)))
        return "waits"

    def _next(self, now: int) -> tuple[str, int] | None:
        """The posting to give out: one whose pause is over first, then the head of the queue."""
        due = sorted((v[1], k[0], v[0]) for k, v in self.again.iterator() if v[1] <= now)  # those that failed and wait
        if due:
            self.again.removeKey((due[0][1],))
            return due[0][1], due[0][2] + 1
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        if head == tail:
            return None
        job = self.queue.getValue((head,))[0]
        self.queue.removeKey((head,))
        self.ends.update((head + 1, tail))
        return job, 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        user, lane = key
        now = timerValues.getCurrentProcessingTimeInMs()
        said: list[Row] = []
        tell = lambda event, job, attempt, worker: said.append(Row(user=user, lane=lane, event=event, job=job, attempt=attempt, worker=worker))
        # reports before requests, and what is queued before both
        rank = {"queue": 0, "done": 1, "failed": 1, "ask": 2}
        for r in sorted(rows, key=lambda r: (rank[r["kind"]], r["seq"])):
            if r["kind"] == "queue":
                head, tail = self.ends.get() if self.ends.exists() else (0, 0)
                self.queue.updateValue((tail,), (r["job"],))
                self.ends.update((head, tail + 1))
                continue
            job, attempt, worker = self.out.get() if self.out.exists() else (None, 0, None)
            held = job is not None and self.lease.exists()
            if job is not None and not held:
                tell(self._back(job, attempt, now), job, attempt, worker)
            if r["kind"] == "ask":
                if not held and (found := self._next(now)) is not None:
                    self.out.update((*found, r["worker"]))
                    self.lease.update((found[0],))
                    tell("claim", *found, r["worker"])
            elif held and (r["job"], r["attempt"], r["worker"]) == (job, attempt, worker):
                if r["kind"] == "done":
                    self.out.clear()
                    self.lease.clear()
                    tell("done", job, attempt, worker)
                else:
                    tell(self._back(job, attempt, now), job, attempt, worker)
        yield from said


def claims(messages: DataFrame, lease_ms: int, pause_ms: int, attempts: int = ATTEMPTS, lanes: int = LANES) -> DataFrame:
    """What the queue says: CLAIMS, where event is claim, done, waits (for another attempt) or gave_up. messages: a stream
    of MESSAGES, where kind is queue, ask (for one posting from each lane that is free), done or failed."""
    use_rocks(messages.sparkSession)
    lane = F.pmod(F.xxhash64("job"), F.lit(lanes)).cast("int")
    every = F.sequence(F.lit(0), F.lit(lanes - 1))
    d = messages.withColumn("lane", F.explode(F.when(F.col("kind") == "ask", every).otherwise(F.array(lane))))
    return d.groupBy("user", "lane").transformWithState(Lane(lease_ms, pause_ms, attempts), CLAIMS, "Append", "ProcessingTime")
