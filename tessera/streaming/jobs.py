"""Enrichment jobs as a stream with state: each job keeps its progress, its messages and its result, and ends by itself.

Commands are rows (job_id, seq, ts, op, percent, message): create, start, update, fail, complete and read. A job's state,
its last messages and its result are state variables of their own, so an update doesn't rewrite a result; a result is
given once and then cleared with its job. A timer ends jobs that nothing was heard of for ``idle_ms``. By the server's
clock (``processing``), messages also leave the state by their time to live; replays go by the time of the commands
(``event``), for which Spark has timers but no time to live.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "job_id string, seq long, ts timestamp, op string, percent int, message string"
TRANSITIONS = "job_id string, seq long, state string, percent int, message string, result string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 30 * 60_000
MESSAGES = 20  # of a job that are kept
_SAID = Row(*(x.split()[0] for x in TRANSITIONS.split(", ")))


class JobProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int = IDLE_MS, clock: str = "event"):
        self.idle_ms, self.event = idle_ms, clock == "event"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, percent int, heard long")
        self.result = handle.getValueState("result", "text string")
        self.messages = handle.getListState("messages", "text string", None if self.event else self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A batch's commands of a job are run in memory, between one look at the state and one write of what is left, as
        each call to the state is a message to another process."""
        held = self.now.get()
        state, percent, heard = held or (None, 0, None)
        fresh, kept = held is None, None  # fresh: nothing that the store has is of this job any more; kept: a result of this batch
        said = []
        for c in sorted(rows, key=lambda c: c.seq):
            op, message, result = c.op, c.message, None
            heard = max(c.ms if self.event else timerValues.getCurrentProcessingTimeInMs(), heard or 0)
            if op == "create" and state is None:
                state, percent, message = "QUEUED", 0, "Queued…"
            elif state is None:
                continue  # an unknown job, or one that was read and cleared
            elif op == "start":
                state, percent, message = "RUNNING", max(percent, 1), message or "Running…"
            elif op == "update":
                percent = percent if c.percent is None else max(0, min(100, c.percent))
            elif op == "fail":
                state, message = "FAILED", message or "Failed."
            elif op == "complete":
                state, percent, kept, message = "DONE", 100, message or "", "Done."
            elif op == "read" and state == "DONE":
                result = self.result.get()[0] if kept is None else kept
            else:
                continue
            if message:
                said.append((message,))
            yield _SAID(key[0], c.seq, "CLEARED" if result is not None else state, percent, message, result)
            if result is not None:
                state, percent, heard, said, fresh, kept = None, 0, None, [], True, None
        if held is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held is not None and fresh:
            self._clear()
        if state is not None:
            self.now.update((state, percent, heard))
            if kept is not None:
                self.result.update((kept,))
            before = [tuple(m) for m in self.messages.get()] if not fresh and self.messages.exists() else []
            self.messages.put((before + said)[-MESSAGES:] or [("",)])
            self.handle.registerTimer(heard + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, percent, _ = self.now.get()
        self._clear()
        yield _SAID(key[0], None, "EXPIRED", percent, f"Last {state}.", None)

    def _clear(self) -> None:
        for held in (self.now, self.result, self.messages):
            if held.exists():
                held.clear()

    def close(self) -> None:
        pass


def job_transitions(commands: DataFrame, idle_ms: int = IDLE_MS, clock: str = "processing") -> DataFrame:
    """A row for each command that a job took (job_id, seq, state, percent, message, result), and one, without seq, for
    each job that was given up. Commands of unknown jobs do nothing; a second create doesn't either; a result is read
    once, which clears the job, and only when it is done. Percentages are kept within 0 and 100."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's stream worker may not see this package
    rows = commands.where("job_id is not null and seq is not null").withColumn("ms", F.unix_millis("ts"))
    if clock == "event":
        rows = rows.withWatermark("ts", "0 seconds")
    return rows.groupBy("job_id").transformWithState(JobProcessor(idle_ms, clock), TRANSITIONS, "append", f"{clock}Time")


def replay(spark: SparkSession, source: str, target: str, idle_ms: int = IDLE_MS, files: int = 1, clock: str = "event"):
    """Run the commands that are stored at ``source`` through ``job_transitions``, ``files`` files a batch, and append
    the transitions to ``target``/out; returns the query. State is kept in RocksDB, in ``target``/state. By ``event`` time the
    query ends with the input; by ``processing`` time, whose timers go on, it runs until it is stopped."""
    name, when = "spark.sql.streaming.stateStore.providerClass", {"availableNow": True} if clock == "event" else {"processingTime": "1 second"}
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        commands = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files).parquet(source)
        out = job_transitions(commands, idle_ms, clock)
        return out.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(**when).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
