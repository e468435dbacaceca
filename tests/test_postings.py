from pyspark.sql import functions as F

from sievora.operators import postings as P
from sievora.session import materialized


def placed(spark, rows, partitions):
    df = spark.createDataFrame(rows, "term string, doc_id long, tf long, qlen long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return P.with_block_numbers(materialized(P.ordered_postings(df), "t")).cache()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_term_in_many_tasks_is_numbered_through(spark):
    rows = [("hot", i * 3, 1 + i % 4, 10) for i in range(1000)] + [(f"t{i}", 5, 1, 10) for i in range(50)]
    found = placed(spark, rows, 7)
    hot = found.where("term = 'hot'").orderBy("doc_id").collect()
    assert [r.place for r in hot] == list(range(1000)) and [r.block_no for r in hot] == [i // 128 for i in range(1000)]
    assert found.where("term <> 'hot' AND place <> 0").isEmpty() and found.count() == 1050
    blocks = {(r.block_no, r.min_doc, r.max_doc, r.n) for r in P.block_stats(found, F.lit(10.0), 1.2, 0.75).where("term = 'hot'").collect()}
    assert (0, 0, 381, 128) in blocks and (7, 2688, 2997, 104) in blocks


def test_bounds_take_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 9, 3, 10), ("a", 4, 3, 10), ("a", 2, 1, 50), ("b", 1, 1, 0)], "term string, doc_id long, tf long, qlen long")
    found = {r.term: (r.df, r.wand_fieldnorm, r.wand_tf) for r in P.term_bounds(df, F.lit(10.0), 1.2, 0.75).collect()}
    assert found == {"a": (3, 10, 3), "b": (1, 0, 1)}


def test_widths_of_full_and_short_blocks(spark):
    rows = [("a", i * 5, 3, 1) for i in range(129)] + [("z", 600, 1, 1)]
    df = spark.createDataFrame([(i,) for i in range(0, 650, 5)], "doc_id long")
    ordinals = P.dense_ordinals(df)
    assert [r.ordinal for r in ordinals.orderBy("doc_id").collect()] == list(range(130))
    found = {(r.term, r.block_no): tuple(r)[2:] for r in P.block_widths(placed(spark, rows, 3), ordinals).collect()}
    assert found == {("a", 0): (128, 1, 2, 1, 2), ("a", 1): (1, 0, 2, 129, 129), ("z", 0): (1, 0, 1, 129, 129)}
