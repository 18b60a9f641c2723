"""The message catalogue that comes with the package: seq, key, lang, template; callers can union their own rows with a higher seq."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED = Path(__file__).resolve().parent.parent / "resources" / "messages.csv"


def message_rows(path: str | None = None) -> list[tuple[int, str, str, str]]:
    with open(path or SHIPPED, encoding="utf-8", newline="") as f:
        return [(int(r["seq"]), r["key"], r["lang"], r["template"]) for r in csv.DictReader(f)]


def message_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.createDataFrame(message_rows(path), "seq int, key string, lang string, template string")
