"""Session construction for local runs; cluster settings stay as the cluster gives them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "folio", **extra: str) -> SparkSession:
    """A local session with adaptive execution on and UTC timestamps."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("FOLIO_DRIVER_MEMORY", "8g"),
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table by name; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_until_exit(spark: SparkSession, name: str) -> None:
    """Has the folder of a table in the warehouse deleted when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
