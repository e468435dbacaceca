"""Queries of the per-key totals (problem 3) and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievora.operators.index_totals import disagreeing_keys, key_totals
from sievora.sources.tables import table


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return key_totals(*(table(spark, folder, t) for t in ("tokens", "summaries", "jumps")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return disagreeing_keys(_totals(spark, folder))


def p3_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(spark, folder)


_TOTALS = """
WITH e AS (SELECT index_id, max(epoch) AS epoch FROM jumps WHERE index_id IS NOT NULL GROUP BY index_id),
t AS (SELECT DISTINCT tokens.* FROM tokens JOIN e USING (index_id, epoch)),
s AS (SELECT DISTINCT summaries.* FROM summaries JOIN e USING (index_id, epoch)),
u AS (SELECT index_id, token_key, coalesce(number_of_documents, 0) AS t, 0 AS s, 0 AS b FROM t
      UNION ALL SELECT index_id, token_key, 0, coalesce(number_of_documents, 0), 1 FROM s),
totals AS (SELECT index_id, token_key, sum(t)::BIGINT AS token_documents, sum(s)::BIGINT AS block_documents,
           sum(b)::BIGINT AS blocks FROM u GROUP BY index_id, token_key)
"""

QUERIES = {"p3_found": p3_found, "p3_totals": p3_totals}
ORACLES = {
    "p3_found": _TOTALS + "SELECT index_id, token_key FROM totals WHERE token_documents <> block_documents",
    "p3_totals": _TOTALS + "SELECT * FROM totals",
}
