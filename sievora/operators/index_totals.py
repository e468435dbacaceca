"""Totals of number_of_documents per index and key in two tables, and the keys where they disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievora.operators.skew import heavy_keys, salted_aggregate
from sievora.sources.tables import current_epoch


def key_totals(tokens: DataFrame, summaries: DataFrame, jumps: DataFrame, salts: int = 32) -> DataFrame:
    """Per (index_id, token_key) of the current epochs: both totals and the number of blocks.

    Columns: index_id, token_key, token_documents, block_documents, blocks. Rows equal in all
    columns count once (told by two 64-bit hashes of the row). A null count is 0 and so is a key missing on one side. Indexes
    that `jumps` doesn't list have no current epoch and give no row. A null token_key is a key.
    Keys with at least a thousandth of the rows are salted (see salted_aggregate), so no task gets one key whole.
    """
    epochs = current_epoch(jumps)

    def side(df: DataFrame, which: int) -> DataFrame:
        n = F.coalesce(F.col("number_of_documents"), F.lit(0)).cast("bigint")
        now = df.join(epochs, ["index_id", "epoch"], "left_semi")
        row = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in df.columns])
        hashes = [F.xxhash64(F.lit(seed), row).alias(f"row{seed}") for seed in (1, 2)]
        return now.select("index_id", "token_key", F.lit(which).alias("side"), n.alias("n"), *hashes)

    both = side(tokens, 0).unionByName(side(summaries, 1))
    heavy = heavy_keys(both, ["index_id", "token_key"])
    of = lambda which, x: F.sum(F.when(F.col("side") == which, x).otherwise(F.lit(0)))
    return salted_aggregate(
        both.distinct(),
        ["index_id", "token_key"],
        {"__t": of(0, F.col("n")), "__s": of(1, F.col("n")), "__b": of(1, F.lit(1))},
        {
            "token_documents": F.sum("__t"),
            "block_documents": F.sum("__s"),
            "blocks": F.sum("__b").cast("bigint"),
        },
        salts=salts,
        heavy=heavy,
        salt=F.col("row1"),  # the rows are distinct by now, and equal rows had to meet before
    )


def disagreeing_keys(totals: DataFrame) -> DataFrame:
    """(index_id, token_key) of key_totals whose two totals differ."""
    return totals.where("token_documents <> block_documents").select("index_id", "token_key")
