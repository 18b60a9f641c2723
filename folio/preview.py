"""Offline check of a folder of documents: no queue and no reviewer; one JSON line for each document.

    python -m folio.preview DOCUMENTS PRESETS PRESET_ID

PRESETS may be `-` for the presets that come with the package.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import rules, scoring
from folio.session import kept_until_exit, local_session
from folio.sources import docx, presets


def checked(spark: SparkSession, documents: str, folder: str, preset_id: str) -> DataFrame:
    """doc_id, filename, error_code and the result of each document; unusable ones have no result.

    Decoded documents, their placed paragraphs and the findings are written to the warehouse, so that a file is
    decoded once whatever reads it, and a lost executor loses nothing."""
    presets_ = presets.by_id(presets.preset_table(spark, presets.load_presets(folder) if folder == "-" else presets.read_presets(spark, folder)), preset_id)
    name = f"folio_{uuid.uuid4().hex}"
    docx.read_docx(spark, documents).write.format("parquet").saveAsTable(f"{name}_decoded")
    kept_until_exit(spark, f"{name}_decoded")
    decoded = spark.table(f"{name}_decoded")
    docs = decoded.where("error_code IS NULL").select("doc_id", F.lit(preset_id).alias("preset_id"), "has_header", "has_footer")
    corpus = rules.Corpus(docs, docx.pages(decoded), docx.paragraphs(decoded), presets_).stored()
    rules.evaluated(corpus).write.format("parquet").saveAsTable(f"{name}_findings")
    kept_until_exit(spark, f"{name}_findings")
    corpus.dropped()
    results = scoring.results(docs, spark.table(f"{name}_findings"), presets_)
    return decoded.select("doc_id", "filename", "error_code").join(results, "doc_id", "left")


def main(documents: str, folder: str, preset_id: str) -> None:
    spark = local_session("*", "preview")
    for row in checked(spark, documents, folder, preset_id).select(F.to_json(F.struct("*"))).toLocalIterator():
        print(row[0])


if __name__ == "__main__":
    main(*sys.argv[1:4])
