"""Error codes that results carry, and which of them a new attempt can mend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed list of codes.
CODES = ("file_too_large", "unsupported_format", "corrupted_document", "text_extraction", "too_many_pages", "preset_not_found", "ai_provider", "ai_quota", "daily_limit", "report_generation", "security", "internal")
#: Codes that say nothing about the document, so the job may run again.
PASSING = ("ai_provider", "report_generation", "internal")


def message_key(code: Column) -> Column:
    """The message of a code; what is unknown is shown as an internal error."""
    return F.concat(F.lit("error."), F.when(code.isin(*CODES), code).otherwise("internal"))


def may_pass(code: Column) -> Column:
    return F.coalesce(code.isin(*PASSING), F.lit(False))
