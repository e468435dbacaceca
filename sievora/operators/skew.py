"""Aggregations and joins by keys of which a few hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with at least 1/MAX_HEAVY of all rows are heavy, so there can be no more than MAX_HEAVY of them.
MAX_HEAVY = 1000


def heavy_keys(df: DataFrame, keys: list[str], max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The keys that hold at least 1/max_heavy of the rows of df, hence at most max_heavy of them.

    Lazy: the total is a scalar subquery over the counts by key. The count is combined in each task before the
    shuffle, so a heavy key costs no task more than one row per input task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total = counts.agg(F.sum("__rows")).scalar()
    return counts.where(F.col("__rows") * max_heavy >= total).select(*keys)


def _marked(df: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """df with the column __heavy, true for rows of a heavy key. Null keys are keys like any other."""
    # at most max_heavy rows, see heavy_keys
    marks = F.broadcast(heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__heavy")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    return df.join(marks, same, "left").select(*df.columns, F.coalesce("__heavy", F.lit(False)).alias("__heavy"))


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: dict[str, Column],
    final: dict[str, Column],
    salts: int = 32,
    max_heavy: int = MAX_HEAVY,
    heavy: DataFrame | None = None,
    salt: Column | None = None,
) -> DataFrame:
    """Two-stage aggregation: heavy keys get a salt, partials per salt are merged by key.

    `partial` makes the columns of the first stage from df, `final` merges them by key. `heavy`
    names the heavy keys (at most max_heavy rows), else they are found in df.

    The salt is random, from a fixed seed: a task that runs again over the same rows in the same
    order, as after a scan, draws the same numbers, so a lost executor changes nothing. Where df comes out of
    a shuffle, the order may differ; give as `salt` a column that spreads the rows by their values then
    (rows equal in it share a salt). Null keys are keys like any other; an empty df gives an
    empty result; columns of df beside keys are read only by `partial` and `salt`.
    """
    marked = _marked(df, keys, heavy if heavy is not None else heavy_keys(df, keys, max_heavy))
    drawn = F.floor(F.rand(17) * salts) if salt is None else F.pmod(salt, F.lit(salts))
    salted = marked.withColumn("__salt", F.when(F.col("__heavy"), drawn.cast("int")).otherwise(F.lit(0)))
    parts = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def salted_join(df: DataFrame, by_key: DataFrame, keys: list[str], heavy: DataFrame, salt: Column, salts: int = 32) -> DataFrame:
    """Inner join of df with a table of few rows a key; rows of heavy keys of df spread over `salts` tasks each.

    The rows of by_key for heavy keys are repeated once a salt, which is at most max_heavy * salts
    times the rows of one key. Columns of both besides the keys must differ in name. Null keys don't join.
    """
    spread = F.when(F.col("__heavy"), F.pmod(salt, F.lit(salts)).cast("int")).otherwise(F.lit(0))
    many = _marked(df, keys, heavy).withColumn("__salt", spread).drop("__heavy")
    repeats = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    few = _marked(by_key, keys, heavy).withColumn("__salt", F.explode(repeats)).drop("__heavy")
    return many.join(few, [*keys, "__salt"]).drop("__salt")
