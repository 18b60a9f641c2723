"""Deliveries happen once, also where a batch is replayed after it was cut off."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from folio.streaming import checks as C
from folio.streaming.ledger import Ledger


class Outbox:
    """Notes each message that leaves as a file of its own, from any process."""

    def __init__(self, folder):
        self.folder = folder
        folder.mkdir()

    def __call__(self, rows):
        import uuid

        for k in rows["check_id"]:
            (self.folder / f"{k}-{uuid.uuid4().hex}").touch()
        return [k % 5 != 0 for k in rows["check_id"]]

    def sent(self):
        return sorted(int(p.name.split("-")[0]) for p in self.folder.iterdir())


def inbox(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"check_id": i}) for i in ids))


def run(spark, tmp_path, step):
    q = C.dispatched(C.inbox(spark, str(tmp_path / "in"), "check_id long"), step, str(tmp_path / "cp"), None)
    return q.awaitTermination(120)


def outcomes(ledger):
    return sorted((r.check_id, r.ok, r.in_doubt) for r in ledger.outcomes().collect())


def test_a_batch_is_delivered_once(spark, tmp_path):
    out, ledger = Outbox(tmp_path / "out"), Ledger(spark, f"file://{tmp_path}/ledger")
    step = lambda df, b: ledger.delivered(df, b, out)
    inbox(tmp_path / "in", "a", [1, 2, 5, 5])
    assert run(spark, tmp_path, step) and out.sent() == [1, 2, 5]
    inbox(tmp_path / "in", "b", [7])
    assert run(spark, tmp_path, step) and run(spark, tmp_path, step) and out.sent() == [1, 2, 5, 7]
    assert outcomes(ledger) == [(1, True, False), (2, True, False), (5, False, False), (7, True, False)]


@pytest.mark.parametrize("cut", ["after the ledger", "before the ledger", "before sending"])
def test_killed_between_send_and_commit(spark, tmp_path, cut):
    """The driver dies in a batch; Spark replays it with the same number."""
    out, ledger = Outbox(tmp_path / "out"), Ledger(spark, f"file://{tmp_path}/ledger")
    seen = []

    def dies(df, batch):
        seen.append(batch)
        if cut == "before sending":
            raise RuntimeError("killed")
        if cut == "before the ledger":  # everything has left, nothing is written
            ledger.files.create(f"{batch}.open", b"")
            out(df.toPandas())
            raise RuntimeError("killed")
        ledger.delivered(df, batch, out)
        raise RuntimeError("killed")

    inbox(tmp_path / "in", "a", [1, 2, 3])
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, dies)
    assert ledger.state(0) == {"after the ledger": "closed", "before the ledger": "sending", "before sending": "new"}[cut]
    for _ in range(2):
        assert run(spark, tmp_path, lambda df, b: (seen.append(b), ledger.delivered(df, b, out)))
    assert set(seen) == {0} and len(seen) == 2 and out.sent() == [1, 2, 3]
    doubt = cut == "before the ledger"
    assert outcomes(ledger) == [(k, not doubt, doubt) for k in (1, 2, 3)]


def test_a_task_that_is_tried_again_sends_nothing(spark, tmp_path, monkeypatch):
    from folio.streaming import ledger as L

    class Second:
        """Stands in for the context of a second try; the task finds it in its module."""

        @staticmethod
        def get():
            return type("Context", (), {"attemptNumber": lambda s: 1})()

    held = {}
    monkeypatch.setattr(L, "TaskContext", Second)
    out, ledger = Outbox(tmp_path / "out"), Ledger(spark, f"file://{tmp_path}/ledger")
    monkeypatch.setattr(Classic, "mapInPandas", lambda self, f, form, *a, **k: held.update(f=f) or self)
    ledger.delivered(spark.createDataFrame([(1,), (2,)], "check_id long"), 0, out)
    got = next(held["f"](iter([pd.DataFrame({"check_id": [1, 2]})])))
    assert out.sent() == [] and got["in_doubt"].tolist() == [True, True] and got["ok"].tolist() == [False, False]


def test_deliveries_in_doubt_come_back_with_an_attempt_more(spark, tmp_path):
    import datetime as dt

    from folio.operators import jobs

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.outcomes().count() == 0
    ledger.files.create("0.open", b"")
    now = dt.datetime(2026, 1, 31, 12)
    rows = spark.createDataFrame([(1, "completed", "sending", 1, now - dt.timedelta(hours=1)), (2, "completed", "sending", 1, now)], "id long, status string, delivery_status string, delivery_attempts int, started_at timestamp")
    ledger.delivered(rows.select(F.col("id").alias("check_id")), 0, lambda f: [True] * len(f))
    assert outcomes(ledger) == [(1, False, True), (2, False, True)]
    after = {r.id: r.delivery_status for r in jobs.recovered(rows, F.lit(now)).collect()}
    assert after == {1: "pending", 2: "sending"}
