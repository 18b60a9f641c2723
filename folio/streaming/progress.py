"""Where checks stand while their stream runs: stages observed in the plan, told by a listener."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, StreamingQueryListener

from folio.operators.jobs import STAGES
from folio.sources.store import Files

EVENTS = "check_id string, stage string, batch long, at timestamp"


def at_stage(df: DataFrame, stage: str, key: str = "check_id") -> DataFrame:
    """The same rows; that they came so far is observed on the way, without a pass of its own.

    A micro-batch's keys are gathered, so the stream's source must bound its batches (maxFilesPerTrigger)."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return df.observe(stage, F.collect_set(F.col(key).cast("string")).alias("keys"))


class StageListener(StreamingQueryListener):
    """Writes one file of rows for each micro-batch in which a stage was observed; a batch that is told twice is written once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = Files(spark, folder)
        self.files.fs.mkdirs(self.files.at)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        rows = [{"check_id": k, "stage": stage, "batch": p.batchId, "at": p.timestamp} for stage in STAGES if stage in p.observedMetrics for k in p.observedMetrics[stage]["keys"] or []]
        if rows:
            self.files.create(f"{p.id}-{p.batchId}.json", "\n".join(map(json.dumps, rows)).encode())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def events(spark: SparkSession, folder: str) -> DataFrame:
    """What listeners wrote, for jobs.progress (ST8)."""
    return spark.read.schema(EVENTS).json(folder)
