import pytest
from pyspark.sql import functions as F

from sievora.operators.ranking import RankedIndex
from sievora.session import work_folder
from sievora.streaming.ingest import stream_insert


def test_streamed_documents_are_found_and_repeats_dropped(spark):
    root = f"{work_folder(spark)}/stream-test"
    rows = [(1, "alpha beta", "2024-01-01"), (2, "beta gamma", "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    index = RankedIndex.build(df, "id", "text", "s", path=f"{root}/index", limit=10)
    late = spark.createDataFrame([(3, "beta", "2024-01-02"), (3, "beta", "2024-01-02"), (4, "delta", "2024-01-02")], "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    late.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(late.schema).parquet(f"{root}/in")
    stream_insert(index, stream, f"{root}/c1", at="at").awaitTermination()
    assert [r.doc_id for r in index.search(index.query("beta")).collect()] == [3, 1, 2]
    assert index.search(index.query("delta")).isEmpty()  # a new term has no weight yet
    # a batch that is replayed replaces itself
    index.insert(late.limit(1), key="c1-0")
    assert {r.structure: r.rows for r in index.describe().collect()}["growing"] == 1
    stream_insert(index, stream, f"{root}/c2", at="at", maintain_every=1).awaitTermination()
    assert [r.doc_id for r in index.search(index.query("delta")).collect()] == [4]
    with pytest.raises(ValueError, match="needs an index with a path"):
        stream_insert(RankedIndex.build(df, "id", "text", "s"), stream, f"{root}/c3")
