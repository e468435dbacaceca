"""Readers of the engine's tables and the rules that say which of their rows are valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data directory."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: for texts whose analysis costs more than moving them.

    A table of a few small files or row groups is read by as few tasks; it is dealt out once. A table in
    more parts, as any large one is, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def latest_rows(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Of the rows of one key, the one with the largest `at`; a null `at` comes last.

    Rows that tie are taken to be equal, any of them may stay. Rows with a null key are
    one group like any other. Only `columns` (besides the key) are shuffled. A key with very
    many rows is cut down to one row per task before the shuffle (WindowGroupLimit).
    """
    order = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return (
        df.select(key, at, *[c for c in columns if c not in (key, at)])
        .withColumn("__nth", F.row_number().over(order))
        .where("__nth = 1")
        .select(key, *columns)
    )


def valid_passages(passages: DataFrame, *columns: str) -> DataFrame:
    """The valid passage row of each id: the one loaded last."""
    return latest_rows(passages.where("id IS NOT NULL"), "id", "loaded_at", list(columns))


def unpadded(key: Column) -> Column:
    """A 16-byte key without the NUL characters it was padded with."""
    return F.rtrim(key, F.lit("\x00"))


def valid_elements(elements: DataFrame, *columns: str) -> DataFrame:
    """Elements with a non-empty unpadded key and a value of at least 1 (repeats stay)."""
    key = unpadded(F.col("element_key"))
    return elements.where(F.col("element_key").isNotNull() & (F.length(key) > 0) & (F.col("element_value") >= 1)).select(
        key.alias("element_key"), *columns
    )


def current_epoch(jumps: DataFrame) -> DataFrame:
    """(index_id, epoch): the largest epoch of each index."""
    return jumps.where("index_id IS NOT NULL AND epoch IS NOT NULL").groupBy("index_id").agg(F.max("epoch").alias("epoch"))


def current_jumps(jumps: DataFrame) -> DataFrame:
    """The rows of the largest epoch of each index; rows equal in all columns count once."""
    return jumps.join(current_epoch(jumps), ["index_id", "epoch"], "left_semi").distinct()
