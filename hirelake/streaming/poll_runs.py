"""The states of poll runs as reports come in: a state machine for each run, with a timer that closes a run that falls silent.

States and rules are those of operators.poll_runs. Each change of a run's status gives a row; the newest row of a run is
its state. A timer stands at the last report that counts plus the limit; it goes off when the watermark has passed it,
and a report that comes with a later time closes the run before it is looked at. A report that is older than one of the
same run that was handled already doesn't count. State of a run that has ended is kept for `forget` more seconds of event
time, so that late reports of it don't begin it anew."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from hirelake.operators.poll_runs import COUNTS, STATES

# times are microseconds here, so that no time zone of a worker plays a part
_STATE = "status string, queued long, started long, last long, found long, new_jobs long, filtered long"
_FIELDS = [x.split()[0] for x in _STATE.split(", ")]
_CHANGES = STATES.replace("timestamp", "long")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunMachine(StatefulProcessor):
    def __init__(self, limit_seconds: int, forget_seconds: int):
        self.limit, self.forget = limit_seconds * 1_000_000, forget_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def close(self) -> None:
        pass

    def _kept(self) -> dict | None:
        return dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None

    def _wait_until(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at // 1000))

    def _row(self, run: str, s: dict, ended: int | None, error: str | None) -> Row:
        return Row(run=run, status=s["status"], queued=s["queued"], started=s["started"], ended=ended, **{c: s[c] for c in COUNTS}, error=error)

    def _timed_out(self, run: str, s: dict) -> Row:
        s["status"] = "timed_out"
        return self._row(run, s, s["last"] + self.limit, "no report in time")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803 (names of the API)
        run, out, s = key[0], [], self._kept()
        for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            event, at = r["event"], r["us"]
            if s is None:
                if event == "queued":
                    s = {"status": "pending", "queued": at, "started": None, "last": at, **dict.fromkeys(COUNTS, 0)}
                    out.append(self._row(run, s, None, None))
                continue
            if s["status"] not in ("pending", "running") or at < s["last"]:
                continue
            if at > s["last"] + self.limit:
                out.append(self._timed_out(run, s))
            elif event == "started" and s["status"] == "pending":
                s |= {"status": "running", "started": at, "last": at}
                out.append(self._row(run, s, None, None))
            elif event == "board" and s["status"] == "running":
                s |= {"last": at, **{c: s[c] + (r[c] or 0) for c in COUNTS}}
            elif event == "failed" or (event == "completed" and s["status"] == "running"):
                s |= {"status": event, "last": at}
                out.append(self._row(run, s, at, (r["error"] or "failed") if event == "failed" else None))
        if s is not None:
            self.state.update(tuple(s.values()))
            self._wait_until(s["last"] + self.limit + (0 if s["status"] in ("pending", "running") else self.forget))
        yield from out

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        s = self._kept()
        if s is None:
            return
        if s["status"] in ("pending", "running"):
            yield self._timed_out(key[0], s)
            self.state.update(tuple(s.values()))
            self.handle.registerTimer(-(-(s["last"] + self.limit + self.forget) // 1000))
        else:
            self.state.clear()


def use_rocks(spark: SparkSession) -> None:
    """The state store that these operators need; to be set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def run_changes(reports: DataFrame, limit_seconds: int, late: str = "10 minutes", forget_seconds: int = 86_400) -> DataFrame:
    """Every change of a run's status: STATES. reports: as for operators.poll_runs.run_states, a stream."""
    use_rocks(reports.sparkSession)
    keyed = reports.withColumn("us", F.unix_micros("at")).withWatermark("at", late).groupBy("run")
    changes = keyed.transformWithState(RunMachine(limit_seconds, forget_seconds), _CHANGES, "Append", "EventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("queued", "started", "ended")})
