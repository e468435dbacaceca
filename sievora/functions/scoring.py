"""The relevance score and its parts as column expressions, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Lengths below EXACT are kept as they are; above, the three bits after the leading one of length - OFFSET. LONGEST is the last of the 256 levels.
EXACT, OFFSET, LONGEST = 40, 24, 2013265944


def _steps(length: Column) -> tuple[Column, Column]:
    """length - OFFSET as BIGINT and the number of its low bits that are dropped."""
    over = length.cast("bigint") - OFFSET
    return over, F.greatest(F.length(F.bin(over)) - 4, F.lit(0))


def quantised_length(length: Column) -> Column:
    """BIGINT: the largest of the 256 levels that is not above the length; null for null."""
    over, dropped = _steps(length)
    step = F.pow(F.lit(2.0), dropped).cast("bigint")
    return F.when(length < EXACT, length.cast("bigint")).otherwise(F.least(OFFSET + over - over % step, F.lit(LONGEST).cast("bigint")))


def fieldnorm(length: Column) -> Column:
    """INT, 0 to 255: the number of that level."""
    over, dropped = _steps(length)
    high = F.floor(over / F.pow(F.lit(2.0), dropped)).cast("bigint") % 8
    return F.when(length < EXACT, length.cast("int")).otherwise(F.least(OFFSET + 8 * (dropped + 1) + high, F.lit(255)).cast("int"))


def fieldnorm_length(level: Column) -> Column:
    """BIGINT: the length that a level stands for."""
    above = level.cast("bigint") - OFFSET
    dropped, high = F.floor(above / 8) - 1, above % 8
    long = OFFSET + ((high + 8) * F.pow(F.lit(2.0), dropped)).cast("bigint")
    return F.when(level < EXACT, level.cast("bigint")).otherwise(long)


def idf(n: Column, df: Column) -> Column:
    return F.log((n.cast("double") + 1.0) / (df.cast("double") + 0.5))


def saturated_tf(tf: Column, length: Column, average: Column, k1: Column, b: Column) -> Column:
    """tf (k1 + 1) / (tf + k1 (1 - b + b length / average)); 0 for tf 0; null where the average is null or 0."""
    part = F.try_divide(length.cast("double"), average)
    weight = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * part))
    return F.when(tf == 0, F.lit(0.0)).otherwise(weight)


#: name: (parameters, result, body); the bodies repeat the expressions above.
SQL_FUNCTIONS = {
    "bm25_idf": ("n DOUBLE, df DOUBLE", "DOUBLE", "ln((n + 1D) / (df + 0.5D))"),
    "bm25_qlen": (
        "len BIGINT",
        "BIGINT",
        f"CASE WHEN len < {EXACT} THEN len ELSE least({OFFSET} + shiftleft(shiftright(len - {OFFSET}, length(bin(len - {OFFSET})) - 4), length(bin(len - {OFFSET})) - 4), {LONGEST}) END",
    ),
    "bm25_fieldnorm": (
        "len BIGINT",
        "INT",
        f"CAST(CASE WHEN len < {EXACT} THEN len ELSE least({OFFSET} + 8 * (length(bin(len - {OFFSET})) - 3) + (shiftright(len - {OFFSET}, length(bin(len - {OFFSET})) - 4) & 7), 255) END AS INT)",
    ),
    "bm25_tf": (
        "tf DOUBLE, qlen DOUBLE, avgdl DOUBLE, k1 DOUBLE, b DOUBLE",
        "DOUBLE",
        "CASE WHEN tf = 0D THEN 0D ELSE tf * (k1 + 1D) / (tf + k1 * (1D - b + b * try_divide(qlen, avgdl))) END",
    ),
}


def register_sql(spark: SparkSession) -> None:
    """Make bm25_idf, bm25_tf, bm25_qlen and bm25_fieldnorm available to spark.sql as temporary functions."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
