"""Words as the whole project understands them: unbroken runs of letters and digits, in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """ARRAY<STRING> of the words of a text in order; null for null, empty for a text without any."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))
