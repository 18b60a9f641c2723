"""Shared pieces: staged tables, distributed ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spaces and control characters that separate words: x20 and x09 to x0D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master may go without: then a temporary folder of this machine serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folio-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: lineage ends here, and sizes are known."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/folio/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(schema).parquet(path)
    out._folio_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df._folio_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes staged tables, and lets Spark delete the shuffle files of what is done.

    Spark keeps those until the driver's JVM has collected what named them, which a heap with room puts off. Listeners may
    still hold the last query, whose files then go with a later call."""
    for table in tables:
        unstage(table)
    SparkSession.active()._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[Column], rank: str = "rank", name: str = "ranked") -> DataFrame:
    """Adds the position from 0 of each row in the order of keys, without one task that sees all rows.

    Rows are range-partitioned and sorted, numbered inside their partition, written, and shifted by
    the counts of earlier partitions. Only one count per partition meets in a single task."""
    n = shuffle_parts(df.sparkSession)
    at = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = stage(at, name)
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # At most one row for each partition, so the broadcast has a fixed bound.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(rank))


def edge_sum(edges: DataFrame) -> tuple:
    """A count and a sum of hashes that tell whether a step changed the edges, in one pass without a shuffle of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "cc", limit: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps; every step is a shuffle of the edge table, which is
    written to the shared folder, so neither lineage nor the driver grows with the graph. A hub is
    handled by aggregates with map-side combine and by joins that adaptive execution can split."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, mark = stage(e, f"{name}-edges"), None
    for _ in range(limit):
        # Large star: each node links its larger neighbours to the least node around it.
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join are plain exchanges and a hub's edges can be split over tasks.
        around = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-around")
        large = both.join(around, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), f"{name}-large")
        # Small star: each node links its smaller neighbours, and itself, to the least of them.
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        own = least.select("a", F.col("m").alias("b"))
        new = stage(small.union(own).distinct(), f"{name}-small")
        for used in (around, large, least, e):
            unstage(used)
        e, last, mark = new, mark, edge_sum(new)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
