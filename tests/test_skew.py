from pyspark.sql import functions as F

from sievora.operators.index_totals import disagreeing_keys, key_totals
from sievora.operators.skew import heavy_keys, salted_aggregate, salted_join


def rows(spark):
    """20,000 equal rows of the heavy key a, 5,000 of a null key, and 5,000 keys with a row each."""
    keys = F.when(F.col("id") < 20000, F.lit("a")).when(F.col("id") < 25000, F.lit(None)).otherwise(F.col("id").cast("string"))
    return spark.range(30000).select(keys.alias("k"), F.lit(1).alias("n"))


def test_heavy_keys_by_share_of_rows(spark):
    assert {r.k for r in heavy_keys(rows(spark), ["k"]).collect()} == {"a", None}
    assert heavy_keys(rows(spark).limit(0), ["k"]).isEmpty()


def test_equal_rows_of_a_heavy_key_use_many_salts(spark):
    parts = salted_aggregate(rows(spark), ["k"], {"p": F.sum("n"), "least": F.min("__salt"), "most": F.max("__salt")}, {"n": F.sum("p"), "salts": F.countDistinct("__salt")})
    found = {r.k: (r.n, r.salts) for r in parts.collect()}
    assert found["a"] == (20000, 32) and found[None] == (5000, 32) and found["25000"] == (1, 1)
    assert len(found) == 5002


def test_salted_join_equals_the_plain_one(spark):
    df = rows(spark).withColumn("i", F.monotonically_increasing_id())
    few = spark.createDataFrame([("a", 1), ("25001", 2), (None, 3)], "k string, v int")
    joined = salted_join(df, few, ["k"], heavy_keys(df, ["k"]), F.xxhash64("i"), 8)
    assert {(r.k, r.v, r["count"]) for r in joined.groupBy("k", "v").count().collect()} == {("a", 1, 20000), ("25001", 2, 1)}


def test_totals_of_repeated_null_missing_and_old_rows(spark):
    tokens = spark.createDataFrame([(1, 2, "a", 3, 0), (1, 2, "a", 3, 0), (1, 2, "b", None, 0), (1, 1, "a", 9, 0), (1, 2, None, 1, 0), (7, 1, "a", 1, 0)], "index_id int, epoch int, token_key string, number_of_documents long, n int")
    summaries = spark.createDataFrame([(1, 2, "a", 0, 2), (1, 2, "a", 1, 1), (1, 2, "a", 1, 1), (1, 2, "c", 0, None), (1, 2, "d", 0, 4)], "index_id int, epoch int, token_key string, block_no int, number_of_documents int")
    jumps = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "index_id int, epoch int")
    totals = key_totals(tokens, summaries, jumps)
    assert {tuple(r) for r in totals.collect()} == {(1, "a", 3, 3, 2), (1, "b", 0, 0, 0), (1, None, 1, 0, 0), (1, "c", 0, 0, 1), (1, "d", 0, 4, 1)}
    assert {tuple(r) for r in disagreeing_keys(totals).collect()} == {(1, None), (1, "d")}
    assert key_totals(tokens.limit(0), summaries.limit(0), jumps.limit(0)).isEmpty()
