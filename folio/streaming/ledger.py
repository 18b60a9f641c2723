"""Deliveries of a stream that happen once, whatever is replayed.

Spark replays a micro-batch whose end it did not record. The ledger knows better: before anything is sent, batch N
is opened by a file that only one caller can create; what was sent is written as Parquet, and then the batch is
closed. On a replay a closed batch is left alone. A batch that is open but not closed was cut off while
sending, so nobody can tell which of its messages left: none is sent again, each is reported as in doubt, and
`jobs.recovered` puts it back in line with one attempt more, as for any delivery that never ended. The same holds for
the rows of a single task that Spark tries a second time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.store import Files

OUTCOME = "check_id long, ok boolean, in_doubt boolean"


class Ledger:
    """One query's batches below a folder in any store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.files.fs.mkdirs(self.files.at)

    def state(self, batch: int) -> str:
        """new, sending or closed."""
        if self.files.exists(f"{batch}.closed"):
            return "closed"
        return "sending" if self.files.exists(f"{batch}.open") else "new"

    def outcomes(self) -> DataFrame:
        """batch, check_id, ok and in_doubt of all closed batches; each batch is in it once."""
        done = sorted(int(n.split(".")[0]) for n in self.files.names() if n.endswith(".closed"))
        paths = [f"{self.files.root}/batch={k}" for k in done]
        if not paths:
            return self.spark.createDataFrame([], f"{OUTCOME}, batch int")
        return self.spark.read.schema(f"{OUTCOME}, batch int").option("basePath", self.files.root).parquet(*paths)

    def delivered(self, rows: DataFrame, batch: int, send: Callable[[pd.DataFrame], list[bool]]) -> None:
        """Sends rows (check_id and what send needs) once, in tasks; send tells of each row whether it left.

        For foreachBatch: `lambda df, batch: ledger.delivered(df, batch, send)`. A check that is twice in a batch is sent once."""
        if self.state(batch) == "closed":
            return
        place = f"{self.files.root}/batch={batch}"
        mine = self.files.create(f"{batch}.open", b"")
        # Written first, so that sending is a plain scan: nothing before it can be lost, which would run its tasks anew.
        asked = f"{self.files.root}/asked/{batch}"
        rows.dropDuplicates(["check_id"]).write.mode("overwrite").parquet(asked)
        once = self.spark.read.schema(rows.schema).parquet(asked)
        if mine:

            def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                # A task that is tried again, or beside itself, may have sent already: it sends nothing.
                again = TaskContext.get().attemptNumber() > 0
                for f in frames:
                    yield pd.DataFrame({"check_id": f["check_id"], "ok": False if again else send(f), "in_doubt": again})

            result = once.mapInPandas(task, OUTCOME)
        else:
            result = once.select(F.col("check_id").cast("long").alias("check_id"), F.lit(False).alias("ok"), F.lit(True).alias("in_doubt"))
        result.write.mode("overwrite").parquet(place)
        self.files.create(f"{batch}.closed", b"")
