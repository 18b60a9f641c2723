"""Mixing sources to target weights by entropy balancing.

Sources share the words of all documents by weight; no target exceeds CAP times its source, and what
a source can't take is shared again among the others. For each source the rates r of its documents
are those closest to one in relative entropy, with 0 <= r <= CAP, that give the target:
r = min(CAP, exp(x * size / scale)), one multiplier x per source. Newton steps, kept inside a bracket,
solve the dual on the table of distinct (source, size); each step is an aggregate over it.

Rates become copies by carrying the rounding on from document to document, largest first. Twice, what
a source then lacks or has too much is made up by one copy more or less of the document whose size
comes nearest to it. Sums are decimals, so reruns agree to the word. DataFrame functions only.

Edge cases: null text has size 0; documents of size 0 have rate 1; null source comes last; repeated
rows and rows that share an id are rated each; an empty table gives no rows; if there are no words, all
targets are 0; other columns are carried along whatever their names. If a source has not settled after
STEPS steps, the operator fails instead of mixing by a wrong rate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.base import WORD_RE, ranked, stage, unstage

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 80
#: A source has settled when its words are so near its target, relatively.
NEAR = 1e-9


def text_words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(hist: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target and what the solver needs; hist: source, size, n."""
    s = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).alias("squares"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    s = ranked(s, [F.col("source").asc_nulls_last()], "place", "sources")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int"))
    s = stage(s.withColumn("weight", weight.cast("double")), "source-weights")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share = 0.0
    while True:  # the share of one unit of weight only rises, so each source is capped once
        capped = F.col("source_size") * cap < F.col("weight") * F.lit(share)
        held, rest = s.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / rest if rest else share
        if new <= share:
            break
        share = new
    most = (F.col("source_size") * cap).cast("double")
    return stage(s.select("source", "source_size", F.least(F.col("weight") * F.lit(share), most).alias("target"), F.greatest(F.col("squares").cast("double") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1.0)).alias("scale"), F.coalesce("least", F.lit(1)).alias("least")), "source-targets")


def rate(x: Column, size: Column, scale: Column, cap: int = CAP) -> Column:
    return F.exp(F.least(x * size / scale, F.lit(math.log(cap))))


def multipliers(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """targets with the multiplier x of each source."""
    top = F.lit(math.log(cap)) * F.col("scale") / F.col("least")  # every document at the cap
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    x = targets.select("*", F.when(full, top).otherwise(F.lit(0.0)).alias("x"), F.when(F.col("target") < F.col("source_size"), F.lit(-math.inf)).otherwise(F.lit(0.0)).alias("low"), F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(top).alias("high"), (full | (F.col("target") <= 0)).alias("done"))
    x = stage(x, "multipliers")
    same = lambda a, b: a.source.eqNullSafe(b["_source"])
    h = hist.where("size > 0").withColumnRenamed("source", "_source")
    for _ in range(STEPS):
        if x.where("NOT done").isEmpty():
            return x
        open_ = x.where("NOT done")
        r = rate(F.col("x"), F.col("size"), F.col("scale"), cap)
        words = (F.col("n") * F.col("size") * r).cast("decimal(38,9)")
        slope = (F.when(F.col("x") * F.col("size") / F.col("scale") < math.log(cap), F.col("n") * F.col("size") * F.col("size") / F.col("scale") * r).otherwise(0.0)).cast("decimal(38,9)")
        sums = h.join(open_, same(open_, h)).groupBy("_source").agg(F.sum(words).cast("double").alias("words"), F.sum(slope).cast("double").alias("slope"))
        n = x.join(sums, same(x, sums), "left").drop("_source")
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("x")).otherwise(F.col("low")), F.when(gap > 0, F.col("x")).otherwise(F.col("high"))
        n = n.withColumn("low", low).withColumn("high", high)
        newton = F.col("x") - F.try_divide(gap, F.col("slope"))
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        halved = F.when(F.col("low") == -math.inf, F.col("x") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        settled = F.abs(gap) <= F.col("target") * NEAR
        new = F.when(F.col("done") | settled, F.col("x")).when(inside, newton).otherwise(halved)
        n = n.select("source", "source_size", "target", "scale", "least", new.alias("x"), "low", "high", (F.col("done") | settled).alias("done"))
        x, old = stage(n, "multipliers"), x
        unstage(old)
    if x.where("NOT done").isEmpty():
        return x
    raise RuntimeError(f"a source has not settled after {STEPS} steps")


def weighed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """rid, doc_id, source, size, a mark of the text, and row with the carried columns, written once so that rids stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    rows = docs.select("doc_id", "source", text_words().alias("size"), F.xxhash64("text").alias("mark"), row)
    return stage(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-rows")


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each document."""
    out = planned(weighed(docs, ["doc_id"]), weights, cap)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def planned(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """rid, doc_id, source, size, source_size, target and copies of each row of weighed()."""
    rows = rows.select("rid", "doc_id", "source", "size", "mark")
    hist = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    x = multipliers(hist, source_targets(hist, weights, cap), cap).withColumnRenamed("source", "_source")
    h = hist.join(x, hist.source.eqNullSafe(x["_source"])).drop("_source")
    h = h.withColumn("rate", F.least(rate(F.col("x"), F.col("size"), F.col("scale"), cap), F.lit(float(cap))).cast("decimal(16,12)"))
    # Copies due to larger documents of the source; a source has no more rows here than distinct sizes.
    before = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    due = F.coalesce(F.sum((F.col("n") * F.col("rate")).cast("decimal(38,12)")).over(before), F.lit(0).cast("decimal(38,12)"))
    at = ranked(rows, [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id"), F.col("mark")], "place", "mix-order")
    first = at.groupBy("source", "size").agg(F.min("place").alias("first")).withColumnsRenamed({"source": "_s", "size": "_z"})
    h = h.withColumn("due", due).join(first, h.source.eqNullSafe(first["_s"]) & (h["size"] == first["_z"])).drop("_s", "_z")
    h = stage(h.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", "due", "first"), "mix-rates")
    out = at.join(h, at.source.eqNullSafe(h["_s"]) & (at["size"] == h["_z"]))
    upto = lambda k: F.floor((F.col("due") + (F.col("place") - F.col("first") + k).cast("decimal(18,0)") * F.col("rate") + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(38,12)"))
    copies = (upto(1) - upto(0)).cast("long")
    out = stage(out.select("place", "rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies")), "mix-copies")
    for _ in range(2):
        out, old = stage(evened(out, cap), "mix-copies"), out
        unstage(old)
    return out.drop("place")


def evened(rows: DataFrame, cap: int) -> DataFrame:
    """One document of each source gets a copy more or less, if that brings the source nearer to its target."""
    left = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack")).withColumnRenamed("source", "_s")
    near = rows.where("size > 0").join(left, rows.source.eqNullSafe(left["_s"]))
    able = F.when(F.col("lack") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    off = F.abs(F.col("size") - F.abs("lack"))
    near = near.where(able & (off < F.abs("lack"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place", F.signum("lack").cast("long").alias("more"))).alias("best"))
    change = near.select(F.col("best.place").alias("place"), F.col("best.more").alias("more"))
    return rows.join(change, "place", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def copied(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Each row as often as the mix takes it; columns as before."""
    rows = weighed(docs, docs.columns)
    plan = planned(rows, weights, cap).where("copies > 0").select("rid", "copies")
    # Merge join at every size, by a number that no two rows share: the plan grows with the documents.
    out = rows.select("rid", "row").join(plan.hint("merge"), "rid")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
