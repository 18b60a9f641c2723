"""Job tables in a relational database; the Derby that comes with Spark serves."""

import datetime as dt
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from folio.operators import jobs
from folio.plans import harness as H
from folio.session import table
from folio.sources import relational as R


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "log"))
    return R.Database(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", connections=4)


@pytest.fixture(scope="module")
def checks(spark, sf_dir, db):
    c = H.as_checks(table(spark, sf_dir, "orders")).select("id", "document_id", "status", "score", "created_at", "attempts", "started_at", F.lit("").alias("claim"))
    assert R.created(c, db, "checks", "id", compared=("status",)) and not R.created(c, db, "checks", "id")
    R.save(c, db, "checks")
    return c


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("key", [None, "id", "created_at"])
def test_scan_is_partitioned_and_whole(spark, db, checks, key):
    got = R.load(spark, db, "checks", key, rows=300)
    assert got.rdd.getNumPartitions() == (1 if key is None else 4) and rows(got) == rows(checks)
    assert R.load(spark, db, "checks", "id").rdd.getNumPartitions() == 1  # few rows


def test_filters_and_columns_reach_the_database(spark, db, checks):
    got = R.load(spark, db, "checks", "id", rows=300).where("status = 'completed' AND score > 1000 AND id < 900").select("id", "score")
    text = plan(got)
    assert "PushedFilters: [" in text and "*EqualTo(status,completed)" in text and "*GreaterThan(score,1000.0)" in text and "*LessThan(id,900)" in text
    assert "document_id" not in text.split("ReadSchema:")[1]
    assert rows(got) == rows(checks.where("status = 'completed' AND score > 1000 AND id < 900").select("id", "score"))


def test_operators_run_on_loaded_tables(spark, db, checks):
    now = F.lit(dt.datetime(1996, 6, 1))
    own = R.load(spark, db, "checks", "id", rows=300).withColumns({"completed_at": F.when(F.col("status") == "completed", F.col("created_at")), "delivery_status": F.lit("sent"), "error_detail": F.lit(None).cast("string")})
    there = checks.withColumns({"completed_at": F.when(F.col("status") == "completed", F.col("created_at")), "delivery_status": F.lit("sent"), "error_detail": F.lit(None).cast("string")})
    after = lambda c: jobs.retained(jobs.expired(c, now), now).select("id", "status")
    assert rows(after(own)) == rows(after(there))


def test_merge_is_whole_and_repeats(spark, db):
    users = spark.createDataFrame([(1, "a", "ru"), (2, "b", None), (3, "c's", "kk")], "telegram_id long, username string, language string")
    R.created(users, db, "users", "telegram_id")
    R.save(users, db, "users")
    news = spark.createDataFrame([(2, "b2", "en"), (4, "d", "en")], "telegram_id long, username string, language string")
    for _ in range(2):
        assert R.merged(news, db, "users", "telegram_id", keep=("language",)) == 2
        assert rows(R.load(spark, db, "users")) == [(1, "a", "ru"), (2, "b2", None), (3, "c's", "kk"), (4, "d", "en")]
    twice = spark.createDataFrame([(5, "x", None), (5, "y", None)], "telegram_id long, username string, language string")
    with pytest.raises(Exception):  # noqa: B017  the key forbids it
        R.merged(twice, db, "users", "telegram_id")
    assert R.load(spark, db, "users").count() == 4
    R.save(users.limit(1), db, "users", "overwrite")
    assert R.load(spark, db, "users").count() == 1
    with pytest.raises(Exception):  # noqa: B017  the definition was kept
        R.save(users.limit(1), db, "users")


def test_a_check_is_claimed_once(spark, db):
    c = spark.createDataFrame([(i, "pending" if i % 3 else "running", 0, None, "") for i in range(60)], "id long, status string, attempts int, started_at timestamp, claim string")
    R.created(c, db, "jobs", "id", compared=("status", "claim"))
    R.save(c, db, "jobs")
    got: list[list[int]] = []

    def claim(ids):
        df = spark.createDataFrame([(i,) for i in ids], "check_id long")
        got.append([r.id for r in R.claimed(df, db, "jobs").collect()])

    threads = [threading.Thread(target=claim, args=(ids,)) for ids in (range(40), range(20, 70), range(5))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    mine = [i for ids in got for i in ids]
    assert sorted(mine) == [i for i in range(60) if i % 3]
    after = R.load(spark, db, "jobs")
    assert after.where("status = 'pending'").count() == 0 and after.where("attempts = 1").count() == 40 == after.where("started_at IS NOT NULL").count()


def test_statements_are_one_transaction(spark, db):
    c = spark.createDataFrame([(1, "a")], "id long, name string")
    R.created(c, db, "words", "id")
    R.save(c, db, "words")
    with pytest.raises(Exception):  # noqa: B017
        R.done(spark, db, 'UPDATE words SET "name" = \'b\'', 'INSERT INTO words VALUES (1, \'c\')')
    assert R.load(spark, db, "words").first().name == "a"
    with pytest.raises(ValueError):
        R.load(spark, db, "words; DROP TABLE words")


def test_missing_columns_of_a_database(spark, db, checks):
    want = spark.createDataFrame([("checks", "id"), ("checks", "lost")], "table_name string, column_name string")
    assert rows(jobs.missing_columns(want, R.columns(spark, db, "checks"))) == [("checks", ["lost"])]
