import itertools

import pytest
from pyspark.sql import functions as F

from sievora.llm import content

SCHEMA = "id int, passage string, loaded_at int"


def pairs(spark, texts, **more):
    rows = [(i, t, 1) for i, t in enumerate(texts, 1)]
    groups, copies = content.contents(spark.createDataFrame(rows, SCHEMA))
    found = {tuple(r) for r in copies.collect()}
    assert sum(r.copies for r in groups.collect()) == len(found)
    return found


def test_letter_case_space_punctuation_and_numbers(spark):
    texts = ["The cat, sat.", "the CAT sat", "sat the cat", "cost 1.5 now", "cost 1,5 now", "cost 15 now", "t -5 x", "t 5 x", "t −5 x", None, "", "  ...  "]
    assert pairs(spark, texts) == {(1, 2), (7, 9)}


def test_field_order_repeats_and_labels_of_several_words(spark):
    a = "page size: 4; page name: x; page kind: y"
    texts = [a, "page kind = Y | page name = x | page size = 4", "p: 1; p: 1; q: 2", "q: 2; p: 1; p: 1", "p: 1; q: 2; q: 2", "a: 1; b: 2", "b: 2; a: 1"]
    assert pairs(spark, texts) == {(1, 2), (3, 4)}
    assert pairs(spark, ["a: 1; b: 2; c: 3;\t", "c: 3; b: 2; a: 1; ."]) == {(1, 2)}


def test_one_sequence_cut_in_two_ways_keeps_every_link(spark):
    a, b = "aa: 11; bb: 2; cc: 3; dd: 4", "cc: 3; bb: 2; aa: 11; dd: 4"
    for order in itertools.permutations([a, b, "aa: 11; bb: 2; cc: 3 dd: 4"]):
        assert pairs(spark, list(order)) == {(1, 2), (1, 3)}
    assert pairs(spark, [a.replace(";", ","), b, a]) == {(1, 2), (1, 3)}


def test_many_fields_are_counted_exactly(spark):
    many = [f"k{i}: {i}" for i in range(300)]
    one, other = many + ["p: 1", "p: 1", "q: 1"], many + ["p: 1", "q: 1", "q: 1"]
    assert pairs(spark, ["; ".join(one), "; ".join(other), "; ".join(one[::-1])]) == {(1, 3)}


@pytest.mark.parametrize("weak", ["sequence_hash", "multiset_hash"])
def test_hashes_that_clash_are_told_apart(spark, monkeypatch, weak):
    constant = lambda x: F.when(x.isNotNull(), F.struct(F.lit(1).alias("a")))
    monkeypatch.setattr(content, weak, constant)
    texts = ["a: 1; b: 2; c: 3", "c: 3; a: 1; b: 2", "one two", "One, two!", "d: 1; e: 2; f: 3", "x y"]
    assert pairs(spark, texts) == {(1, 2), (3, 4)}


def test_only_valid_rows_and_extra_columns(spark):
    rows = [(1, "new text", 2, 0), (1, "old text", 1, 0), (1, "new text", 2, 0), (2, "old text", None, 0), (3, "New text", 1, 0), (None, "new text", 1, 0)]
    groups, copies = content.contents(spark.createDataFrame(rows, SCHEMA + ", first_id int"))
    assert [tuple(r) for r in copies.collect()] == [(1, 3)]
    assert {tuple(r) for r in groups.collect()} == {(1, 1), (2, 0)}
    groups, copies = content.contents(spark.createDataFrame([], SCHEMA))
    assert groups.isEmpty() and copies.isEmpty()


def test_a_third_of_all_rows_alike(spark):
    rows = spark.range(1, 3001).select(F.col("id").cast("int"), F.when(F.col("id") % 3 == 0, "Same text").otherwise(F.concat(F.lit("text "), "id")).alias("passage"), F.lit(1).alias("loaded_at"))
    _, copies = content.contents(rows)
    assert copies.count() == 999 and copies.where("first_id <> 3").isEmpty()
