"""Admission of uploaded files as predicates, before anything is expanded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.docx import REQUIRED_PARTS, Limits

# Fixed value: the media type of Word documents.
MIME_TYPES = ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)


def name_reason(filename: Column) -> Column:
    return F.when(~F.endswith(F.lower(filename), F.lit(".docx")), "extension is not .docx")


def mime_reason(mime: Column) -> Column:
    return F.when((F.coalesce(mime, F.lit("")) != "") & ~mime.isin(*MIME_TYPES), F.concat(F.lit("unexpected media type: "), mime))


def content_reason(content: Column, most: int = 20 << 20) -> Column:
    """Not empty, not too long, and a zip by its first bytes."""
    return F.when(F.octet_length(content) == 0, "empty file").when(F.octet_length(content) > most, "file too large").when(F.hex(F.substring(content, 1, 4)) != "504B0304", "not a zip archive")


def container_reasons(parts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and the first container rule that its parts break, or null (SEC3, X5); parts: name, file_size, compress_size, flag_bits."""
    plain = F.replace("name", F.lit("\\"), F.lit("/"))
    unsafe = F.startswith(plain, F.lit("/")) | F.contains(plain, F.lit(":")) | F.array_contains(F.split(plain, "/"), "..") | (F.col("flag_bits").bitwiseAND(1) == 1)
    big, packed = F.col("file_size") > limits.part_mb << 20, F.col("file_size") > F.greatest(F.lit(1), "compress_size") * limits.ratio
    g = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.sum("file_size").alias("size"), F.max(unsafe).alias("unsafe"), F.max(big).alias("big"), F.max(packed).alias("packed"), F.collect_set(F.when(F.col("name").isin(*REQUIRED_PARTS), F.col("name"))).alias("have"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED_PARTS)), F.col("have"))
    reason = F.when(F.col("n") > limits.parts, "too many parts").when(F.col("size") > limits.total_mb << 20, "archive too large").when(F.col("unsafe"), "unsafe or encrypted part").when(F.col("big"), "part too large").when(F.col("packed"), "compressed too much").when(F.col("names") != F.col("n"), "part twice").when(F.size(missing) > 0, F.concat(F.lit("missing parts: "), F.array_join(missing, ", ")))
    return g.select("doc_id", reason.alias("reason"))


def admitted(uploads: DataFrame, parts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """uploads (doc_id, filename, mime) with the first reason against each, by name, media type and container (SEC4), and its code."""
    both = uploads.join(container_reasons(parts, limits), "doc_id", "left")
    own = F.coalesce(name_reason(F.col("filename")), mime_reason(F.col("mime")))
    code = F.when(own.isNotNull(), "unsupported_format").when(F.col("reason").isNotNull(), "corrupted_document")
    return both.select(*uploads.columns, F.coalesce(own, "reason").alias("reason"), code.alias("error_code"))
