"""Keyed state of streams, held against the same rules over tables."""

import datetime as dt
import json
import os
import shutil

import pytest
from docs import SHAPES
from pyspark.sql import functions as F

from folio.operators import jobs
from folio.operators.scoring import lookup
from folio.plans.catalogue import _KINDS
from folio.plans.harness import as_checks
from folio.session import table
from folio.streaming import checks as C
from folio.streaming import stateful as S

NOW = dt.datetime(2026, 1, 31, 12)


@pytest.fixture(autouse=True)
def rocks(spark):
    S.prepare(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def cut(df, folder, order, parts):
    """A table as files in the given order; the stream takes them one by one."""
    rows = df.orderBy(*order).toPandas()
    size = -(-len(rows) // parts)
    folder.mkdir()
    for i in range(parts):
        rows.iloc[i * size : (i + 1) * size].to_parquet(folder / f"{i:03}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(folder / f"{i:03}.parquet", (1_700_000_000 + i,) * 2)  # a stream takes files by age
    return df.schema


def stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(folder))


def run(df, checkpoint, mode):
    out = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda d, b: out.extend((b, r) for r in d.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return out


def test_states_are_those_of_the_table_over_restarts(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("check_id"), lookup(F.col("event_type"), _KINDS).alias("kind"), "ts")
    schema = cut(events, tmp_path / "all", ["ts", "check_id", "kind"], 6)
    (tmp_path / "in").mkdir()
    last = {}
    for files in (range(2), range(2, 3), range(3, 6)):  # a restart after each
        for i in files:
            shutil.copy2(tmp_path / "all" / f"{i:03}.parquet", tmp_path / "in")
        for _, r in run(S.states(stream(spark, tmp_path / "in", schema), timers=False), tmp_path / "cp", "update"):
            last[r.check_id] = tuple(r)
    assert sorted(last.values()) == sorted(map(tuple, C.states_batch(events).collect())) and len({r[1:] for r in last.values()}) > 2


def test_stuck_checks_come_back_by_timer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"check_id": 1, "kind": k, "ts": (NOW + dt.timedelta(seconds=i)).isoformat()}) for i, k in enumerate(("submit", "claim"))))
    seen = []
    df = S.states(C.inbox(spark, str(tmp_path / "in"), "check_id long, kind string, ts timestamp"), jobs.Limits(job_seconds=1, grace_seconds=1))
    q = df.writeStream.outputMode("update").foreachBatch(lambda d, _: seen.extend(r.status for r in d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if "pending" in seen:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert seen == ["running", "pending"]


@pytest.mark.parametrize("parts", [1, 7])
def test_admission_in_any_cut_is_that_of_the_table(spark, sf_dir, tmp_path, parts):
    limits = jobs.Limits(per_day=3, active=2)
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "user_id", "ts", F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("done_at"))
    schema = cut(requests, tmp_path / "in", ["ts", "request_id"], parts)
    got = {r.request_id: (r.user_id, r.is_admitted) for _, r in run(S.admitted(stream(spark, tmp_path / "in", schema), limits, False), tmp_path / "cp", "append")}
    want = {r.request_id: (r.user_id, r.is_admitted) for r in jobs.admitted(requests, limits).collect()}
    assert got == want and {ok for _, ok in want.values()} == {True, False}


def test_uploads_are_admitted_as_they_come(spark, tmp_path):
    """Files of two users; a done row frees a place, and a file is answered once."""
    for k, (user, name) in enumerate([("ann", "1"), ("ann", "2"), ("ann", "3"), ("bob", "1")]):
        (tmp_path / "in" / user).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / user / f"{name}.docx").write_bytes(SHAPES["correct.docx"])
    files = C.inbox(spark, str(tmp_path / "in"))
    requests = S.uploaded(files)
    limits = jobs.Limits(active=2)
    got = [(r.user_id, r.is_admitted) for _, r in run(S.admitted(requests, limits, False), tmp_path / "cp", "append")]
    assert sorted(got) == [("ann", False), ("ann", True), ("ann", True), ("bob", True)]
    assert run(S.admitted(requests, limits, False), tmp_path / "cp", "append") == []


def test_admitted_uploads_are_decoded(spark, tmp_path):
    for k, (user, name) in enumerate([("ann", "correct.docx"), ("ann", "bad.docx"), ("ann", "x.txt"), ("bob", "wrong_font.docx")]):
        (tmp_path / "in" / user).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / user / name).write_bytes(SHAPES.get(name, b"PK"))
        os.utime(tmp_path / "in" / user / name, (1_700_000_000 + k,) * 2)
    got = lambda: {(r.user_id, r.filename): (r.is_admitted, r.error_code, len(r.paragraphs) > 3) for _, r in run(S.documents(spark, str(tmp_path / "in"), jobs.Limits(active=2), lifetimes=False), tmp_path / "cp", "append")}
    assert got() == {("ann", "correct.docx"): (True, None, True), ("ann", "bad.docx"): (True, "corrupted_document", False), ("bob", "wrong_font.docx"): (True, None, True)}
    (tmp_path / "in" / "ann" / "third.docx").write_bytes(SHAPES["correct.docx"])
    assert got() == {("ann", "third.docx"): (False, "daily_limit", False)}


def test_lifetimes_need_no_end(spark, tmp_path):
    """With lifetimes a query runs on; it gives the same answers."""
    rows = [(i, 7, NOW + dt.timedelta(minutes=i), None) for i in range(3)]
    schema = cut(spark.createDataFrame(rows, "request_id long, user_id long, ts timestamp, done_at timestamp"), tmp_path / "in", ["ts"], 3)
    got = []
    q = S.admitted(stream(spark, tmp_path / "in", schema), jobs.Limits(active=2)).writeStream.outputMode("append").foreachBatch(lambda d, _: got.extend((r.request_id, r.is_admitted) for r in d.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if len(got) == 3:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert got == [(0, True), (1, True), (2, False)]


def test_a_request_that_is_done_frees_its_place(spark, tmp_path):
    at = lambda h: NOW + dt.timedelta(hours=h)
    rows = [(1, 7, at(0), None), (2, 7, at(0.1), None), (1, 7, at(0.2), at(0.2)), (3, 7, at(0.3), None), (4, 7, at(0.4), None)]
    schema = cut(spark.createDataFrame(rows, "request_id long, user_id long, ts timestamp, done_at timestamp"), tmp_path / "in", ["ts"], 5)
    got = [(r.request_id, r.is_admitted) for _, r in run(S.admitted(stream(spark, tmp_path / "in", schema), jobs.Limits(active=2), False), tmp_path / "cp", "append")]
    assert got == [(1, True), (2, True), (3, True), (4, False)]


def test_retention_is_that_of_the_table(spark, sf_dir, tmp_path):
    now = dt.datetime(1996, 6, 1)
    checks = as_checks(table(spark, sf_dir, "orders")).where(F.col("created_at") < F.lit(now))
    changes = checks.select("id", F.col("created_at").alias("ts"), "status", "created_at", "completed_at", "delivery_status")
    clock = spark.createDataFrame([(-1, now, "running", now, None, None)], "id long, ts timestamp, status string, created_at timestamp, completed_at timestamp, delivery_status string")  # tells the time
    schema = cut(clock.union(changes), tmp_path / "in", ["ts", "id"], 5)
    got = [r for _, r in run(S.aged(stream(spark, tmp_path / "in", schema)), tmp_path / "cp", "append")]
    f = F.lit(now)
    after = {r.id: r.status for r in jobs.retained(jobs.expired(checks, f), f).collect()}
    before = {r.id: r.status for r in checks.collect()}
    assert {r.id for r in got if r.action == "deleted" and before[r.id] == "completed"} == before.keys() - after.keys() and before.keys() - after.keys()
    failed = {k for k, v in after.items() if v == "failed" and before[k] == "pending"}
    assert {r.id for r in got if r.action == "failed"} == failed and failed
    # What failed long ago by the stream's own clock has been deleted by it, too.
    assert {r.id for r in got if r.action == "deleted" and before[r.id] == "pending"} <= failed
