"""Tables of a relational database: partitioned scans, bulk writes, and changes that the database does in one statement.

Scans and writes are Spark's JDBC source, so filters, columns and limits reach the database (EXPLAIN shows PushedFilters)
and each partition is a query over a range of the key. What must be atomic for several writers (a claim, an upsert) is
staged with Spark beside its table and then done by one UPDATE or MERGE; the driver passes statements, never rows."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition, connections at once, rows of a batch.
PARTITION_ROWS, CONNECTIONS, BATCH = 200_000, 16, 5000
#: Characters of the string columns that statements compare; other strings have no bound, and some databases can't compare them.
CHARS = 1000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


@dataclass(frozen=True)
class Database:
    """Where the tables are; properties: user, password, driver and others of the JDBC driver."""

    url: str
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    connections: int = CONNECTIONS


def named(name: str) -> str:
    """A table's or column's name that can stand in a statement."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


def quoted(column: str) -> str:
    return f'"{named(column)}"'


def _options(db: Database) -> dict[str, str]:
    return db.properties | {"url": db.url}


def load(spark: SparkSession, db: Database, table: str, key: str | None = None, rows: int = PARTITION_ROWS, fetch: int = BATCH) -> DataFrame:
    """A table, as many key ranges at once as its rows fill partitions (S14); key: a number, date or timestamp that isn't null where it counts.

    Bounds and count are one aggregate that the database answers; rows with a null key go with the first range."""
    reader = spark.read.format("jdbc").options(**_options(db)).option("dbtable", named(table)).option("fetchsize", fetch)
    if key is None:
        return reader.load()
    ask = f"(SELECT MIN({quoted(key)}) AS {quoted('low')}, MAX({quoted(key)}) AS {quoted('high')}, COUNT(*) AS {quoted('n')} FROM {named(table)}) b"
    low, high, n = spark.read.format("jdbc").options(**_options(db)).option("dbtable", ask).load().select(F.col("low").cast("string"), F.col("high").cast("string"), "n").first()
    parts = min(db.connections, math.ceil(n / rows))
    if low is None or parts < 2:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def save(df: DataFrame, db: Database, table: str, mode: str = "append", compared: tuple[str, ...] = ()) -> None:
    """Writes rows in batches over at most `connections` connections; overwrite empties the table and keeps its definition."""
    # Derby sets a null as its widest string, so compared columns are never null there.
    short = [f"{named(c)} VARCHAR({CHARS})" for c, kind in df.dtypes if kind == "string" and c in compared]
    out = df.coalesce(db.connections).write.format("jdbc").options(**_options(db)).option("dbtable", named(table))
    if short:
        out = out.option("createTableColumnTypes", ", ".join(short))  # where the table is made
    out.option("batchsize", BATCH).option("truncate", "true").mode(mode).save()


@contextmanager
def _connected(spark: SparkSession, db: Database) -> Iterator:
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in db.properties.items():
        given.setProperty(k, v)
    if "driver" in db.properties:
        jvm.java.lang.Class.forName(db.properties["driver"])
    link = jvm.java.sql.DriverManager.getConnection(db.url, given)
    try:
        yield link
    finally:
        link.close()


def done(spark: SparkSession, db: Database, *statements: str) -> list[int]:
    """Runs statements in one transaction and tells how many rows each changed; all or none take effect."""
    with _connected(spark, db) as link:
        link.setAutoCommit(False)
        try:
            out = []
            for sql in statements:
                statement = link.createStatement()
                out.append(statement.executeUpdate(sql))
                statement.close()
            link.commit()
            return out
        except BaseException:
            link.rollback()
            raise


@contextmanager
def _staged(df: DataFrame, db: Database, table: str, compared: tuple[str, ...] = ()) -> Iterator[str]:
    """The rows in a table of their own beside `table`, which goes afterwards."""
    name = f"{named(table)}_{uuid.uuid4().hex[:12]}"
    save(df, db, name, "errorifexists", compared)
    try:
        yield name
    finally:
        done(df.sparkSession, db, f"DROP TABLE {name}")


def created(df: DataFrame, db: Database, table: str, *key: str, compared: tuple[str, ...] = ()) -> bool:
    """Makes an empty table with the columns of df and the given primary key, unless it is there; whether it was made."""
    spark = df.sparkSession
    try:
        spark.read.format("jdbc").options(**_options(db)).option("dbtable", named(table)).load()
        return False
    except Exception as e:  # what a missing table raises depends on the driver
        if not re.search(r"does not exist|doesn't exist|no such table|not found|invalid object", str(e), re.I):
            raise
    save(df.limit(0), db, table, "errorifexists", compared)
    done(spark, db, *(f"ALTER TABLE {named(table)} ALTER COLUMN {quoted(k)} NOT NULL" for k in key), *([f"ALTER TABLE {named(table)} ADD PRIMARY KEY ({', '.join(map(quoted, key))})"] if key else []))
    return True


def merged(df: DataFrame, db: Database, table: str, *key: str, keep: tuple[str, ...] = (), compared: tuple[str, ...] = ()) -> int:
    """Rows by key: those that are there get the new values (but for the columns in keep), others are added; how many.

    One MERGE, so readers see all or nothing, and doing it again changes nothing more. df has a key once."""
    new = [c for c in df.columns if c not in key and c not in keep]
    on = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in key)
    with _staged(df, db, table, compared) as stage:
        sql = f"MERGE INTO {named(table)} t USING {stage} s ON {on}"
        if new:
            sql += " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{quoted(c)} = s.{quoted(c)}" for c in new)
        sql += f" WHEN NOT MATCHED THEN INSERT ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join(f's.{quoted(c)}' for c in df.columns)})"
        return done(df.sparkSession, db, sql)[0]


def claimed(ids: DataFrame, db: Database, table: str = "checks") -> DataFrame:
    """Claims pending checks among ids (check_id) for this caller alone, and gives those that it got (M4 in the store).

    Each is running with one more attempt afterwards. Of callers that ask for a check at once the database lets one
    change it; the mark of the caller tells which."""
    spark, mark = ids.sparkSession, uuid.uuid4().hex
    with _staged(ids.select("check_id").distinct(), db, table) as stage:
        set_ = f'"status" = \'running\', "attempts" = "attempts" + 1, "started_at" = CURRENT_TIMESTAMP, "claim" = \'{mark}\''
        done(spark, db, f'UPDATE {named(table)} SET {set_} WHERE "status" = \'pending\' AND "id" IN (SELECT "check_id" FROM {stage})')
    return load(spark, db, table).where(F.col("claim") == mark)


def columns(spark: SparkSession, db: Database, *tables: str) -> DataFrame:
    """table_name and column_name of some tables, for jobs.missing_columns."""
    rows = [(t, c) for t in tables for c in load(spark, db, t).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")
