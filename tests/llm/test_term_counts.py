import random
from collections import Counter

import pyarrow as pa
import pytest

from sievora.llm import term_counts as T

SCHEMA = "index_id int, passage_id int, element_key string, element_value int, mark string"


def test_valid_rows_marks_and_ties(spark):
    rows = [(1, p, "all", 1, "x") for p in range(40)] + [(1, p, "some", 2, "x") for p in range(3)]
    rows += [(1, 1, "rare", 3, "x"), (1, 1, "rare", 5, "x"), (2, 1, "rare\0\0", 4, "x"), (1, 2, "rare", 1, "x"), (1, 2, "rare", 1, "x")]
    rows += [(1, 3, None, 1, "x"), (1, 3, "", 1, "x"), (1, 3, "\0\0", 1, "x"), (1, 3, "zero", 0, "x"), (1, 3, "null", None, "x"), (1, None, "none", 1, "x"), (1, 3, "k" * 100_000, 1, "x")]
    found = {r.element_key[:9]: (r.passages, r.occurrences, r.mark) for r in T.marked_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"all": (40, 40, "common"), "some": (3, 6, None), "rare": (2, 6, "rare"), "k" * 9: (1, 1, "rare")}
    assert T.marked_terms(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.mark.parametrize("most,deepest", [(32 << 20, 0), (60_000, 1), (6_000, 2)])
def test_files_are_split_until_they_fit(tmp_path, most, deepest):
    rng, counts, batches = random.Random(1), Counter(), []
    for _ in range(40):
        keys = [f"term{int(rng.paretovariate(0.3)) % 60_000}" for _ in range(5000)]
        counts.update(keys)
        batches.append(pa.record_batch([pa.array(keys), pa.array([1] * 5000, pa.int64()), pa.array([2] * 5000, pa.int64())], schema=T.SCHEMA))
    engine = T.Engine(str(tmp_path), 256)
    found = [row for batch in T.radix_sums(iter(batches), engine, most) for row in batch.to_pylist()]
    assert engine.deepest >= deepest and (most < 1 << 20 or not engine.deepest)
    assert {r["element_key"]: r["passages"] for r in found} == counts and len(found) == len(counts)
    assert all(r["occurrences"] == 2 * r["passages"] for r in found)
    engine.close()
    assert not list(tmp_path.iterdir())


def test_small_files_give_the_same_table(spark):
    rows = [(1, p, f"t{p * k % 997}", 1, "x") for p in range(300) for k in range(1, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, T.marked_terms(df, most_bytes=2000).collect()), key=str) == sorted(map(tuple, T.marked_terms(df).collect()), key=str)


def test_elements_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a", 1, "x")], SCHEMA).write.parquet(f"{tmp_path}/e")
    df = T.marked_terms(spark.read.parquet(f"{tmp_path}/e"))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_folders_of_other_file_systems():
    assert T.file_system("/tmp/x")[1] == "/tmp/x" and T.file_system("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="dbfs"):
        T.file_system("dbfs:/x")
