"""Stateful streams on keyed state: checks, admission of uploads, and retention.

Each processor keeps its state in Spark's state store (RocksDB, set by `prepare`), one key at a time and with nothing
gathered per key: rows come as an iterator, and timers and lifetimes belong to the key. State outlives restarts with the query's
checkpoint. The rules are those of the tables: `checks.advanced`, `jobs.admitted`, `jobs.expired`, `jobs.retained`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from folio.operators.jobs import ENDED, Limits
from folio.sources import word
from folio.sources.docx import Limits as Archive
from folio.streaming.checks import FRESH, OUT, STATE, advanced, inbox

DAY_MS = 86_400_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def prepare(spark: SparkSession) -> None:
    """State in RocksDB: on disk, so it isn't bounded by the heap, and what transformWithState needs."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Check(StatefulProcessor):
    """The state of one check, with a timer while it runs or sends."""

    def __init__(self, limits: Limits, timers: bool) -> None:
        self.limits, self.timers = limits, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("check", STATE)

    def held(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else FRESH

    def moved(self, key: tuple, state: tuple, now: int) -> Iterator[Row]:
        self.state.update(state)
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if state[0] == "running" or state[2] == "sending":
                self.handle.registerTimer(now + (self.limits.job_seconds + self.limits.grace_seconds) * 1000)
        yield Row(check_id=key[0], status=state[0], attempts=state[1], delivery=state[2], delivery_attempts=state[3])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = self.held()
        for event in sorted(rows, key=lambda r: (r.ts, r.kind or "")):
            state = advanced(state, event.kind or "", self.limits)
        yield from self.moved(key, state, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self.moved(key, advanced(self.held(), "stale", self.limits), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def states(events: DataFrame, limits: Limits = Limits(), timers: bool = True) -> DataFrame:
    """The state of each check after each micro-batch that touches it (ST1, ST3, ST5, ST6); events: check_id, kind, ts.

    With timers, a check that runs or sends for too long becomes pending by itself. A query that takes what is there and
    ends (available-now) goes without them."""
    return events.groupBy("check_id").transformWithState(Check(limits, timers), OUT, "update", "processingTime" if timers else "none")


class Admission(StatefulProcessor):
    """The requests of one user that count against the quota: accepted and of the same day, or not done.

    With lifetimes, the map from request to its times forgets an entry after two days without a change: by then an
    unfinished check has failed (jobs.expired), so this drops only what counts no more."""

    def __init__(self, limits: Limits, lifetimes: bool) -> None:
        self.limits, self.lifetimes = limits, lifetimes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "request_id long", "day int, done long", 2 * DAY_MS if self.lifetimes else None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        held = dict(before)
        for r in sorted(rows, key=lambda r: (r.at, r.request_id)):
            if r.request_id in held:  # told again: nothing, or that it is done
                day, done = held[r.request_id]
                held[r.request_id] = day, r.done if done is None else done
                continue
            busy = {k for k, (_, done) in held.items() if done is None or done > r.at}
            today = {k for k, (day, _) in held.items() if day == r.day}
            held = {k: v for k, v in held.items() if k in busy or k in today}
            ok = len(busy) < self.limits.active and len(today) < self.limits.per_day
            if ok:
                held[r.request_id] = r.day, r.done
            yield Row(request_id=r.request_id, user_id=key[0], at=r.at, is_admitted=ok, path=r.path)
        for k in before.keys() - held.keys():
            self.held.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.held.updateValue((k,), v)

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, limits: Limits = Limits(), lifetimes: bool = True) -> DataFrame:
    """request_id, user_id, ts, is_admitted and, where requests have it, path of each request (ST2), in the order in which they come, by ts inside a micro-batch.

    requests: request_id, user_id, ts, done_at. A later row of an accepted request may tell done_at. A refused
    request does not count against later ones; one that comes twice while it counts is answered once. Days are those of
    the session's time zone, as in jobs.admitted. A query that takes what is there and ends (available-now) goes without lifetimes."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    path = F.col("path") if "path" in requests.columns else F.lit(None).cast("string")
    r = requests.select(F.col("request_id").cast("long").alias("request_id"), "user_id", micros("ts").alias("at"), F.unix_date(F.to_date("ts")).alias("day"), micros("done_at").alias("done"), path.alias("path"))
    user = r.schema["user_id"].dataType.simpleString()
    out = r.groupBy("user_id").transformWithState(Admission(limits, lifetimes), f"request_id long, user_id {user}, at long, is_admitted boolean, path string", "append", "processingTime" if lifetimes else "none")
    return out.select("request_id", "user_id", F.timestamp_micros("at").alias("ts"), "is_admitted", *(["path"] if "path" in requests.columns else []))


def uploaded(files: DataFrame) -> DataFrame:
    """Requests from a stream of files (path, modificationTime) in folders named by their user (S15): the folder is the user, the path the request."""
    user = F.element_at(F.split("path", "/"), -2)
    return files.select(F.xxhash64("path").alias("request_id"), user.alias("user_id"), F.col("modificationTime").alias("ts"), F.lit(None).cast("timestamp").alias("done_at"), "path")


def documents(spark: SparkSession, folder: str, quota: Limits = Limits(), limits: Archive = Archive(), per_trigger: int = 100, lifetimes: bool = True) -> DataFrame:
    """The uploads of a folder as decoded documents with user_id and is_admitted, as they come (S15 with ST2).

    A file is opened, inside a task, only if its user's quota lets it in; a refused one has no content and the error code of a full quota."""
    asked = admitted(uploaded(inbox(spark, folder, per_trigger=per_trigger).where(F.lower("path").endswith(".docx"))), quota, lifetimes)
    return word.opened(asked.select("path", "user_id", "is_admitted"), folder, limits)


class Retention(StatefulProcessor):
    """What is known of one check, with an event-time timer at the moment when its age changes something."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("check", "status string, created long, completed long, delivery string")

    def due(self, status: str, created: int, completed: int | None, delivery: str | None) -> int | None:
        """Milliseconds at which the check is old."""
        if status == "pending":
            return created + self.limits.file_hours * 3_600_000
        if status in ENDED and delivery is not None and delivery != "sending" and completed is not None:
            return completed + self.limits.result_days * DAY_MS
        return None

    def kept(self, state: tuple) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.state.update(state)
        if (at := self.due(*state)) is not None:
            self.handle.registerTimer(at + 1)  # older than, not as old as

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r.order)
        self.kept((last.status, last.created, last.completed, last.delivery_status))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        status, created, _, delivery = self.state.get()
        at = timerValues.getCurrentWatermarkInMs()
        if status == "pending":
            self.kept(("failed", created, at, delivery))
            yield Row(id=key[0], action="failed", at=at)
        else:
            self.state.clear()
            yield Row(id=key[0], action="deleted", at=at)

    def close(self) -> None:
        pass


def aged(changes: DataFrame, limits: Limits = Limits(), late: str = "0 seconds") -> DataFrame:
    """id, action (failed: it waited too long; deleted: it ended long ago) and at of each check whose time has come (ST4).

    changes: id, ts, status, created_at, completed_at, delivery_status: a check as it is from ts on. Time is what the
    changes tell less `late`, so old changes read again give the same actions; the state of a deleted check goes with it."""
    ms = lambda c: F.unix_millis(c)
    rows = changes.select("id", "ts", F.unix_micros("ts").alias("order"), "status", ms("created_at").alias("created"), ms("completed_at").alias("completed"), "delivery_status").withWatermark("ts", late)
    key = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("id").transformWithState(Retention(limits), f"id {key}, action string, at long", "append", "eventTime")
    return out.select("id", "action", F.timestamp_millis("at").alias("at"))
