"""Tables of a database file in a folder that driver and executors share, through the sqlite3 that comes with Python.

An embedded JDBC database such as Derby lives in the memory of one JVM, so executors can't see the driver's. Where a cluster
has no database server, the file is what all of them reach. Each task writes its rows by batches, each batch one transaction;
SQLite lets one writer in at a time and the others wait. Scans are queries over ranges of the key, with the condition in the
statement. The folder has to be a path of the file system with locks; other stores need a server and sources.relational."""

from __future__ import annotations

import math
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.relational import BATCH, CONNECTIONS, PARTITION_ROWS, named, quoted

#: Seconds that a writer waits for the others.
PATIENCE = 3600
_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}


def one_jvm(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's JVM, so that they see what is in its memory."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def database(spark: SparkSession) -> str:
    """The path of a new database in the folder of spark.checkpoint.dir; the file goes with the application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    at = urlsplit(root or "")
    if not root or at.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir has to be a shared folder of the file system for a database file, not {root}")
    jvm = spark.sparkContext._jvm
    path = f"{unquote(at.path).rstrip('/')}/folio-{uuid.uuid4().hex}.db"
    file = jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    file.getParent().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(file.getParent())
    with closing(sqlite3.connect(path)) as link:
        link.execute("PRAGMA user_version = 1")  # makes the file, which deleteOnExit asks for
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(file)
    return path


def created(df: DataFrame, path: str, table: str, key: str) -> None:
    """An empty table with the columns of df and a primary key; there is none of that name."""
    columns = ", ".join(f"{quoted(c)} {_TYPES[kind]}{' PRIMARY KEY' if c == key else ''}" for c, kind in df.dtypes)
    with closing(sqlite3.connect(path, timeout=PATIENCE)) as link:
        link.execute(f"CREATE TABLE {named(table)} ({columns})")


def save(df: DataFrame, path: str, table: str) -> int:
    """Writes the rows and tells how many. A row takes the place of the one with its key, so a task that runs again adds nothing."""
    sql = f"INSERT OR REPLACE INTO {named(table)} ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(sqlite3.connect(path, timeout=PATIENCE, isolation_level=None)) as link:
            for batch in batches:
                link.execute("BEGIN IMMEDIATE")
                link.executemany(sql, zip(*(c.to_pylist() for c in batch.columns), strict=True))
                link.execute("COMMIT")
                yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    return df.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load(spark: SparkSession, path: str, table: str, key: str, schema: str, where: str = "1 = 1", rows: int = PARTITION_ROWS) -> DataFrame:
    """The columns of schema of the rows that meet a condition, as many ranges of the key at once as the rows fill partitions.

    schema: Spark's, with bigint, int, double and string; where: the database's SQL. key: a whole number, the primary key."""
    with closing(sqlite3.connect(path, timeout=PATIENCE)) as link:
        ((low, high, n),) = link.execute(f"SELECT min({quoted(key)}), max({quoted(key)}), count(*) FROM {named(table)} WHERE {where}")
    kind = spark.createDataFrame([], schema).schema
    parts = max(1, min(CONNECTIONS, math.ceil(n / rows)))
    edges = [(low or 0) + ((high or 0) + 1 - (low or 0)) * k // parts for k in range(parts + 1)]
    sql = f"SELECT {', '.join(map(quoted, kind.names))} FROM {named(table)} WHERE ({where}) AND {quoted(key)} >= ? AND {quoted(key)} < ?"
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in kind])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(sqlite3.connect(path, timeout=PATIENCE)) as link:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    found = link.execute(sql, edges[part : part + 2])
                    while some := found.fetchmany(BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return spark.range(0, parts, 1, parts).mapInArrow(read, kind)
