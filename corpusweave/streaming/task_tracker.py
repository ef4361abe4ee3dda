"""Tasks as keyed state with event-time timers: progress, warnings, timeouts, and state that goes when a task is over.

Use it where state must not grow with all tokens ever seen, or where a waiting task must be reported by
itself. It needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`) and runs Python per token and
batch; `progress_state` and `task_alerts` give the same answers in batch, in the JVM.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, title string, message string, percentage int, begin_id bigint, begin_ms bigint, last_ms bigint, last_id bigint, warned boolean"
OUT = ("token string, state string, level string, reason string, title string, message string, percentage int, "
       "begin_id bigint, at timestamp")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _moment(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000)


class TaskTracker(StatefulProcessor):
    """One state row per token that is in progress, or was until `keep_ms` ago."""

    def __init__(self, warn_ms: int, timeout_ms: int, keep_ms: int):
        self.warn_ms, self.timeout_ms, self.keep_ms = warn_ms, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE)

    def _row(self, token: str, task: dict, level: str, reason: str | None, at_ms: int) -> Row:
        return Row(token=token, state=task["status"], level=level, reason=reason, title=task["title"], message=task["message"],
                   percentage=task["percentage"], begin_id=task["begin_id"], at=_moment(at_ms))

    def _settle(self, task: dict) -> None:
        """Keep the task, with timers for the limits that still lie ahead of it."""
        self.task.update(tuple(task.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if task["status"] == "in_progress" and task["begin_ms"] is not None:
            self.handle.registerTimer(task["begin_ms"] + (self.timeout_ms if task["warned"] else self.warn_ms))
        else:
            self.handle.registerTimer(task["last_ms"] + self.keep_ms)

    def _overdue(self, token: str, task: dict, now_ms: int) -> Iterator[Row]:
        """Limits that were reached before the moment `now_ms`."""
        if task["status"] != "in_progress" or task["begin_ms"] is None:
            return
        if not task["warned"] and now_ms > task["begin_ms"] + self.warn_ms:
            task["warned"] = True
            yield self._row(token, task, "warning", "slow", task["begin_ms"] + self.warn_ms)
        if now_ms > task["begin_ms"] + self.timeout_ms:
            task.update(status="failed", percentage=None)
            yield self._row(token, task, "failed", "timeout", task["begin_ms"] + self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        token = key[0]
        task = dict(zip([c.split()[0] for c in STATE.split(", ")], self.task.get())) if self.task.exists() else None
        events = sorted(rows, key=lambda r: (r.ts, r.event_id))
        last = None
        for e in events:
            at_ms = int(e.ts.timestamp() * 1000)
            if task and (at_ms, e.event_id) <= (task["last_ms"], task["last_id"]):
                continue  # replayed, or behind what is known
            if task:
                yield from self._overdue(token, task, at_ms)
            share = getattr(e, "percentage", None)
            if e.kind == "begin":
                task = dict(status="in_progress", title=e.title, message=e.message, percentage=share, begin_id=e.event_id,
                            begin_ms=at_ms, last_ms=at_ms, last_id=e.event_id, warned=False)
            elif task is None:
                over = e.kind == "end"
                task = dict(status="completed" if over else "in_progress", title=None if over else "Unknown", message=e.message, percentage=None if over else share,
                            begin_id=None, begin_ms=None, last_ms=at_ms, last_id=e.event_id, warned=False)
            elif e.kind == "end" and task["status"] == "in_progress":
                task.update(status="completed", title=None, message=e.message, percentage=None, last_ms=at_ms, last_id=e.event_id)
            elif e.kind == "report" and task["status"] == "in_progress":
                task.update(message=e.message, percentage=share, last_ms=at_ms, last_id=e.event_id)
            else:
                task.update(last_ms=at_ms, last_id=e.event_id)  # over already: a late report or end changes nothing
                continue
            last = self._row(token, task, "progress", None, at_ms)
        if task:
            self._settle(task)
        if last:
            yield last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.task.exists():
            return
        task = dict(zip([c.split()[0] for c in STATE.split(", ")], self.task.get()))
        if task["status"] != "in_progress" or task["begin_ms"] is None:
            self.task.clear()
            return
        yield from self._overdue(key[0], task, expiredTimerInfo.getExpiryTimeInMs() + 1)
        self._settle(task)

    def close(self) -> None:
        pass


def tracked_tasks(progress: DataFrame, warn_s: int = 30, timeout_s: int = 300, keep_s: int = 600, delay: str = "0 seconds") -> DataFrame:
    """Updates of tasks from a stream of events (token, kind, title, message, ts, event_id, and `percentage` if there is one).

    `progress` rows give a token's state after each batch in which it changed; `warning` and `failed` rows come once the watermark passes the begin by
    `warn_s` and `timeout_s` seconds, also where no further event arrives. A timed-out task stays failed: a later end is ignored, a later
    begin starts over. Reports without a begin have no limit. A token that is over, or was never begun, leaves the state `keep_s` seconds after its
    last event; until then late reports are ignored. Events behind the watermark by `delay` are dropped.
    """
    columns = ["token", "kind", "title", "message", "ts", "event_id", *(["percentage"] if "percentage" in progress.columns else [])]
    timed = progress.select(*columns).withWatermark("ts", delay)
    return timed.groupBy("token").transformWithState(
        TaskTracker(warn_s * 1000, timeout_s * 1000, keep_s * 1000), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
