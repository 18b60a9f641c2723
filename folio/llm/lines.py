"""Line dedup: lines found in many documents stay only in the last document that holds them.

Lines are exploded and hashed; a document sends each key once, so counting its hashes counts
documents, and partial counts meet per hash before the shuffle however common a line is. Only
positions come back to the texts, which are cut once, in their own row.

Edge cases: null or empty text is one empty line; lines shorter than the least key length always
stay; a document id that repeats counts as one document, and each of its rows loses its own lines; rows
without an id count for no line and lose none; other columns are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.base import LOWER, SPACE_CHARS, UPPER, ascii_lower, stage

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _hash(key: Column) -> list[Column]:
    """128 bits of two seeds."""
    return [F.xxhash64(key), F.xxhash64(F.lit(7), key)]


def _mark() -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, mark of the text and the sorted positions of the lines that it loses, for texts that lose any."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", _mark().alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_chars)
    h, g = _hash(F.col("key"))
    hashed = stage(lines.select("doc_id", "mark", "pos", h.alias("h"), g.alias("g")), "line-hashes")
    once = hashed.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
    common = once.groupBy("h", "g").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = stage(common.drop("n"), "common-lines")
    hit = hashed.join(common, ["h", "g"]).where("doc_id <> keeper")
    return hit.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def deduped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text after the cut, n_lines and n_dropped."""
    # A merge join at every size: the table of cuts grows with the documents, so it is never broadcast.
    gone = stage(dropped_positions(docs, min_chars, min_docs), "dropped-lines")
    d = docs.select("doc_id", _mark().alias("mark"), F.coalesce("text", F.lit("")).alias("text")).join(gone.hint("merge"), ["doc_id", "mark"], "left")
    d = d.withColumn("lines", F.split("text", "\n", -1))
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get("lines", i))
    return d.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of the deduplicated documents."""
    return deduped(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def digest_sql(docs: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}),
l AS (SELECT rid, doc_id, pos, lines[pos] AS line, translate(regexp_replace(regexp_replace(lines[pos], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER}', '{LOWER}') AS k
      FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS lines FROM d), unnest(generate_series(1, len(lines))) AS t(pos)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT rid, l.doc_id, pos, line, coalesce(l.doc_id <> keeper, false) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id"""
