"""Attempts with back-off as keyed stream state: a request is tried after a pause that doubles, a bounded number of times.

Each request is a key with a state of its own (the attempts made, the errors so far, when the next is due) and a timer in
event time. A timer that is due makes the attempt, and those after it that the stream's clock has passed already; one that
fails with the next still to come sets the next timer, so no task ever sleeps and a restarted stream goes on with the
timers of its checkpoint. An attempt that was made and whose batch was lost is made
again, so what it does has to bear that (see mutations: a change is looked up before it is made).

    attempts(requests, attempt).writeStream...

requests: key, ts, payload. A key that comes again while it is being tried, or after it has ended, is left alone; rows
without a key or a time are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The first pause in seconds, and how often a request is tried.
PAUSE, ATTEMPTS = 2, 5

STATE = "attempt int, due long, payload string, errors array<string>, ended boolean"
OUT = "key string, attempt int, due_ms long, outcome string, error string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    def __init__(self, attempt: Callable[[str, str, int], str | None], pause: int, most: int):
        self.attempt, self.pause, self.most = attempt, pause, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("request", STATE)

    def _due(self, after_ms: int, made: int) -> int:
        return after_ms + self.pause * 1000 * 2**made

    def _wait(self, due: int, made: int, payload: str | None, errors: list[str]) -> None:
        self.state.update((made, due, payload, errors, False))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        if not self.state.exists():
            ms, payload = min((r["ms"], r["payload"] or "") for r in rows)
            self._wait(self._due(ms, 0), 0, payload, [])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        n, due, payload, errors, ended = self.state.get()
        if ended or due != expiredTimerInfo.getExpiryTimeInMs():
            return
        name, errors, clock = key[0], list(errors), timerValues.getCurrentWatermarkInMs()
        while True:
            n += 1
            error = self.attempt(name, payload, n)
            if error is None:
                outcome, said = "made", None
            elif n < self.most:
                outcome, said = "failed", error
            else:
                outcome, said = "given up", f"failed after {self.most} attempts: {error}"
            yield Row(key=name, attempt=n, due_ms=due, outcome=outcome, error=said)
            if outcome != "failed":
                return self.state.update((n, due, payload, errors, True))
            errors.append(error)
            due = self._due(due, n)
            if due >= clock:
                return self._wait(due, n, payload, errors)

    def close(self) -> None:
        pass


def attempts(requests: DataFrame, attempt: Callable[[str, str, int], str | None], pause: int = PAUSE, most: int = ATTEMPTS, delay: str = "0 seconds") -> DataFrame:
    """A row for each attempt on the requests of a stream: key, attempt, due_ms, outcome (made, failed, given up),
    error. attempt: (key, payload, number) -> an error or None. The session keeps state in RocksDB, as timers need it."""
    use_rocks(requests.sparkSession)
    timed = requests.filter("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = timed.select("key", "ts", F.unix_millis("ts").alias("ms"), F.col("payload").cast("string"))
    return rows.groupBy("key").transformWithState(Attempts(attempt, pause, most), OUT, "Append", "EventTime")


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
