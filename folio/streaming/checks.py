"""Checks as a stream: a state machine over events, recovery of what got stuck, and an outbox.

Events: check_id, kind, ts. Kinds: submit, claim, complete, fail (a domain error), error (may be tried
again), cancel, send, sent, unsent. One check's events meet in one key; its state is a few numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.jobs import Limits

STATE = "status string, attempts int, delivery string, delivery_attempts int"
OUT = f"check_id long, {STATE}"
# Fixed value: the columns of whole files.
FILE = "path string, modificationTime timestamp, length long, content binary"
#: What a check is before its first event.
FRESH = ("new", 0, "none", 0)


def advanced(state: tuple, kind: str, limits: Limits = Limits()) -> tuple:
    """The state after an event; events that don't fit the state change nothing, so replays are harmless."""
    status, attempts, delivery, sends = state
    if kind == "submit" and status == "new":
        return "pending", 0, "none", 0
    if kind == "claim" and status == "pending":
        return "running", attempts + 1, delivery, sends
    if kind == "complete" and status in ("running", "pending"):
        return "completed", attempts, "pending", sends
    if kind == "fail" and status in ("running", "pending"):
        return "failed", attempts, delivery, sends
    if kind == "error" and status == "running":
        return ("failed" if attempts >= limits.attempts else "pending"), attempts, delivery, sends
    if kind in ("cancel", "stale") and status == "running":
        return "pending", attempts, delivery, sends
    if kind == "send" and status == "completed" and delivery == "pending":
        return status, attempts, "sending", sends + 1
    if kind == "sent" and delivery == "sending":
        return status, attempts, "sent", sends
    if kind in ("unsent", "stale") and delivery == "sending":
        return status, attempts, ("failed" if sends >= limits.delivery_attempts else "pending"), sends
    return state


def state_task(limits: Limits, timers: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else FRESH
        if held.hasTimedOut:
            state = advanced(state, "stale", limits)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "kind"], kind="stable")
            for kind in rows["kind"]:
                state = advanced(state, kind, limits)
        held.update(state)
        if timers and (state[0] == "running" or state[2] == "sending"):
            held.setTimeoutDuration((limits.job_seconds + limits.grace_seconds) * 1000)
        yield pd.DataFrame([(key[0], *state)], columns=["check_id", "status", "attempts", "delivery", "delivery_attempts"])

    return run


def states(events: DataFrame, limits: Limits = Limits(), timers: bool = True) -> DataFrame:
    """The state of each check after each micro-batch that touches it (ST1, ST3, ST5, ST6).

    With timers, a check that runs or sends for too long becomes pending by itself; a query that takes
    what is there and ends (available-now) must go without, since timers keep it waiting."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return events.groupBy("check_id").applyInPandasWithState(state_task(limits, timers), OUT, STATE, "update", timeout)


def advanced_column(state: Column, kind: Column, limits: Limits = Limits()) -> Column:
    """advanced() as an expression over a struct of STATE."""
    status, attempts, delivery, sends = (state[c] for c in ("status", "attempts", "delivery", "delivery_attempts"))
    new = lambda a=status, b=attempts, c=delivery, d=sends: F.struct(*(x.alias(n) if isinstance(x, Column) else F.lit(x).alias(n) for x, n in zip((a, b, c, d), ("status", "attempts", "delivery", "delivery_attempts"), strict=True)))
    busy = status.isin("running", "pending")
    rules = (
        ((kind == "submit") & (status == "new"), new("pending", 0, "none", 0)),
        ((kind == "claim") & (status == "pending"), new("running", attempts + 1)),
        ((kind == "complete") & busy, new("completed", c="pending")),
        ((kind == "fail") & busy, new("failed")),
        ((kind == "error") & (status == "running"), new(F.when(attempts >= limits.attempts, "failed").otherwise("pending"))),
        ((kind == "cancel") & (status == "running"), new("pending")),
        ((kind == "send") & (status == "completed") & (delivery == "pending"), new(c="sending", d=sends + 1)),
        ((kind == "sent") & (delivery == "sending"), new(c="sent")),
        ((kind == "unsent") & (delivery == "sending"), new(c=F.when(sends >= limits.delivery_attempts, "failed").otherwise("pending"))),
    )
    out = new()
    for when, then in reversed(rules):
        out = F.when(when, then).otherwise(out)
    return out


def states_batch(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same for a table of events, as a fold inside the JVM; events of one moment go by their kind."""
    fresh = F.struct(*(F.lit(v).alias(n) for v, n in zip(FRESH, ("status", "attempts", "delivery", "delivery_attempts"), strict=True)))
    rows = events.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("ts", F.coalesce("kind", F.lit("")).alias("kind")))).alias("each"))
    return rows.select("check_id", F.aggregate("each", fresh, lambda s, e: advanced_column(s, e["kind"], limits)).alias("s")).select("check_id", "s.*")


def once(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each job once within the watermark (ST7); jobs: job_id, ts."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id"])


def inbox(spark, path: str, schema: str | None = None, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream (S15): whole files, or JSON rows where a schema is given."""
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger)
    return reader.schema(schema).json(path) if schema else reader.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(path)


def dispatched(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 15):
    """Starts a query that hands each micro-batch to send, at least once (ST3); without seconds it takes what is there and ends."""
    writer = stream.writeStream.outputMode("update").foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
