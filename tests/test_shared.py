"""A database file that driver and executors share."""

import os
import subprocess
import sys

import duckdb
import pytest

from folio.plans import catalogue as C
from folio.sources import shared

CLUSTER = """
import sys
from pyspark.sql import SparkSession
from folio.plans import catalogue
out, sf = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{out}/warehouse", "spark.checkpoint.dir": f"file://{out}/shared", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for r in sorted(map(tuple, catalogue.q_relational(spark, sf).collect())):
    print("ROW", *r)
spark.stop()
"""


def test_executors_of_their_own_reach_the_database(tmp_path, sf_dir):
    """Executors in other JVMs than the driver, which a database in the driver's memory can't serve."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), sf_dir], env=env, capture_output=True, text=True, timeout=240)
    got = [tuple(map(int, x.split()[1:])) for x in done.stdout.splitlines() if x.startswith("ROW ")]
    duck = duckdb.connect()
    duck.sql(f"create view orders as select * from read_parquet('{sf_dir}/orders.parquet')")
    assert got == sorted(duck.sql(f"select bucket, n, last from ({C.ORACLES['q_relational']})").fetchall()), done.stderr[-2000:]
    assert not list((tmp_path / "shared").glob("*.db"))


@pytest.mark.parametrize("rows", [7, 1000])
def test_file_keeps_rows_and_repeats_add_none(spark, rows):
    df = spark.createDataFrame([(i * 3 - 50, None if i % 5 == 0 else f"'{i}ж", None if i % 7 == 0 else i / 3) for i in range(100)], "id bigint, name string, score double").repartition(4)
    file = shared.database(spark)
    shared.created(df, file, "t", "id")
    for _ in range(2):
        assert shared.save(df, file, "t") == 100
    got = shared.load(spark, file, "t", "id", "id bigint, name string, score double", rows=rows)
    assert got.rdd.getNumPartitions() == (15 if rows == 7 else 1) and sorted(got.collect(), key=repr) == sorted(df.collect(), key=repr)
    some = shared.load(spark, file, "t", "id", "id bigint", "score > 20", rows=rows)
    assert sorted(r.id for r in some.collect()) == [i * 3 - 50 for i in range(61, 100) if i % 7]
    assert shared.load(spark, file, "t", "id", "id bigint", "score > 2000").count() == 0
