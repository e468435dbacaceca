"""Pairs of passages that share most of their distinct words, by multi-index hashing without loss.

The fingerprint of a passage has a bit for every possible word hash, set for the words it has; the Hamming
distance of two fingerprints is the number of words only one of them has. Two sets of n and m words
share at least SHARED/OF of all their words exactly if that distance is at most
(OF - SHARED) / (OF + SHARED) * (n + m). The fingerprint is cut into segments by word hash, half as many as
the distance allowed, so that some segment of such a pair differs in one bit at most. Of each
segment the ball of radius one is looked up in a table: the segment itself and the segment
less each of its words, from both sides. Matches are verified by the complete distance, on fingerprints
folded to FOLDED bits (folding never adds to a distance), and then by the words themselves.

The number of segments follows from the size of the sets, so sizes are taken by classes: a
passage stands in the table of its own class and in those of larger ones it may have a partner in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievora.functions.words import distinct_words
from sievora.llm.content import contents, multiset_hash, smallest_linked
from sievora.operators.skew import MAX_HEAVY, salted_join
from sievora.session import materialized
from sievora.sources.tables import valid_passages

LEAST_WORDS = 38
#: At least 7 of 10 words in either are in both.
SHARED, OF = 7, 10
FOLDED = 128
#: Words whose keys are made at a time.
SLICE = 50_000
SIGNATURES = pa.schema([("bucket", pa.int64()), ("id", pa.int32()), ("n", pa.int32()), ("own", pa.bool_()), ("f0", pa.int64()), ("f1", pa.int64())])


def size_classes(least: int, most: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each class from `least` on until `most` is covered; each a fifth wider than the one before."""
    out, low = [], least
    while low <= most:
        out.append((low, low * 6 // 5))
        low = out[-1][1] + 1
    return out


def segments(highest: int, shared: int = SHARED, of: int = OF) -> int:
    """Of two sets of at most `highest` words that share enough, one of so many segments differs in one word at most."""
    allowed = (of - shared) * 2 * highest // (of + shared)
    return (allowed + 2) // 2


def signatures(ids: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, least: int, shared: int, of: int) -> Iterator[pa.RecordBatch]:
    """The keys under which sets of words stand in the tables. Set i has hashes[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(ids)), sizes)
    folded = np.zeros((len(ids), 2), np.uint64)
    bit = hashes >> np.uint64(57)
    np.bitwise_xor.at(folded, (doc, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    for number, (low, high) in enumerate(size_classes(least, int(sizes.max(initial=0)) * of // shared)):
        within = (sizes <= high) & (low * shared <= sizes * of)
        if not within.any():
            continue
        count = segments(high, shared, of)
        taken = within[doc]
        h, of_doc = hashes[taken], (np.cumsum(within) - 1)[doc[taken]]
        docs = np.flatnonzero(within)
        cell = of_doc * count + (h % np.uint64(count)).astype(np.int64)
        whole = np.zeros(len(docs) * count, np.uint64)
        np.bitwise_xor.at(whole, cell, h)
        # the table is told by class and segment, mixed into the key
        table = (np.arange(count, dtype=np.uint64) + np.uint64((number + 1) << 32)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = np.concatenate([whole ^ np.tile(table, len(docs)), whole[cell] ^ h ^ table[cell % count]])
        owner = docs[np.concatenate([np.repeat(np.arange(len(docs)), count), of_doc])]
        columns = [
            pa.array(bucket.view(np.int64)),
            pa.array(ids[owner], pa.int32()),
            pa.array(sizes[owner], pa.int32()),
            pa.array(sizes[owner] >= low),
            pa.array(folded[owner, 0].view(np.int64)),
            pa.array(folded[owner, 1].view(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=SIGNATURES)


def _task(least: int, shared: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy().view(np.uint64)
            start = 0
            while start < len(ids):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
                part = offsets[start : stop + 1]
                yield from signatures(ids[start:stop], part - part[0], values[part[0] : part[-1]], least, shared, of)
                start = stop

    return run


def close_sets(sets: DataFrame, least: int = LEAST_WORDS, shared: int = SHARED, of: int = OF) -> DataFrame:
    """(id_a, id_b): all pairs of sets that have at least shared/of of their words in common.

    sets: id INT and words, distinct, at least `least` of them in each. The smaller set is id_a, of equal ones the
    one with the smaller id. No pair is missed: the ball and the distances only ever drop pairs that
    lie too far apart. A bucket with many sets is split by adaptive execution.
    """
    hashed = sets.select("id", F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"))
    keys = hashed.mapInArrow(_task(least, shared, of), "bucket bigint, id int, n int, own boolean, f0 bigint, f1 bigint")
    keys = materialized(keys, "signatures")
    side = lambda df, x: df.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "f0", "f1")])
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    distance = F.bit_count(F.col("f0_a").bitwiseXOR(F.col("f0_b"))) + F.bit_count(F.col("f1_a").bitwiseXOR(F.col("f1_b")))
    enough = distance * (of + shared) <= (F.col("n_a") + F.col("n_b")) * (of - shared)
    found = side(keys, "a").join(side(keys.where("own"), "b"), "bucket").where(order & enough).select("id_a", "id_b").distinct()
    words = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("words").alias(f"words_{x}"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    verified = both * of >= (F.size("words_a") + F.size("words_b") - both) * shared
    return found.join(words("a"), "id_a").join(words("b"), "id_b").where(verified).select("id_a", "id_b")


def long_passages(passages: DataFrame) -> DataFrame:
    """(id, loaded_at, passage, words): the valid passages of at least LEAST_WORDS distinct words.

    The texts of shorter ones are dropped before the shuffle, but their rows take part: an earlier
    long text of an id is not valid.
    """
    words = distinct_words(F.col("passage"))
    kept = passages.withColumn("words", F.when(F.size(words) >= LEAST_WORDS, words))
    kept = kept.withColumn("passage", F.when(F.col("words").isNotNull(), F.col("passage")))
    return valid_passages(kept, "loaded_at", "passage", "words").where("words IS NOT NULL")


def _expanded(pairs: DataFrame, members: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Pairs of groups (key_a, key_b) as pairs of their members' ids."""
    one = members.select(F.col(key).alias("key_a"), F.col("id").alias("one"))
    other = members.select(F.col(key).alias("key_b"), F.col("id").alias("other"))
    named = lambda x: heavy.select(F.col(key).alias(x))
    half = salted_join(one, pairs, ["key_a"], named("key_a"), F.xxhash64("one"))
    whole = salted_join(other, half.select("key_b", "one"), ["key_b"], named("key_b"), F.xxhash64("other"))
    return whole.select(F.least("one", "other").alias("id_a"), F.greatest("one", "other").alias("id_b"))


def word_sets(passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long, members, pairs): the long passages; (id, rep, n), rep being the smallest of the n ids with the same words; and
    the pairs (id_a, id_b) of reps that share enough words. Passages of the same words are one set, compared with others once."""
    long = materialized(long_passages(passages).withColumn("set", multiset_hash(F.col("words"))), "long")
    groups = long.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    heavy = groups.where(F.col("n") * MAX_HEAVY >= groups.agg(F.sum("n")).scalar()).select("set")
    members = materialized(salted_join(long.select("id", "set"), groups, ["set"], heavy, F.xxhash64("id")).select("id", "rep", "n"), "sets")
    firsts = members.where("id = rep").select("id")
    return long, members, close_sets(long.select("id", "words").join(firsts, "id", "left_semi"))


def near_groups(passages: DataFrame) -> DataFrame:
    """(id, class_id): of each long passage the smallest id that a chain of near copies leads to, its own if it has none."""
    _, members, pairs = word_sets(passages)
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    edges = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    edges = materialized(edges.unionByName(edges.select("a", F.col("a").alias("b")).distinct()), "edges")
    labels = smallest_linked(edges).select(F.col("a").alias("rep"), "first")
    heavy = members.where(F.col("n") * MAX_HEAVY >= members.agg(F.count(F.lit(1))).scalar()).select("rep").distinct()
    every = members.select("rep").distinct().join(labels, "rep", "left").select("rep", F.coalesce("first", "rep").alias("class_id"))
    return salted_join(members.select("id", "rep"), every, ["rep"], heavy, F.xxhash64("id")).select("id", "class_id")


def near_copies(passages: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: valid passages of at least LEAST_WORDS distinct words that share enough of them
    and are not of one content (see contents).

    Pairs of sets are written out as pairs of ids at the end. Null passages, rows without id and shorter passages
    give no pair; no rows give no rows. Runs jobs when called (intermediate tables in the shared folder).
    """
    long, members, pairs = word_sets(passages)
    heavy = members.where(F.col("n") * MAX_HEAVY >= members.agg(F.count(F.lit(1))).scalar()).select("rep").distinct()
    of_sets = _expanded(pairs.select(F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b")), members, "rep", heavy)

    # within a set the pairs of different contents
    alike = members.where("n > 1").select("id", "rep")
    _, copies = contents(long.select("id", "loaded_at", "passage").join(alike.select("id"), "id", "left_semi"))
    known = alike.join(copies.select(F.col("copy_id").alias("id"), "first_id"), "id", "left")
    known = materialized(known.select("id", "rep", F.coalesce("first_id", "id").alias("content")), "alike")
    each = known.groupBy("rep", "content").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: each.select("rep", F.col("content").alias(f"key_{x}"))
    of_contents = side("a").join(side("b"), "rep").where("key_a < key_b").select("key_a", "key_b")
    heavy = each.where(F.col("n") * MAX_HEAVY >= each.agg(F.sum("n")).scalar()).select("content")
    return of_sets.unionByName(_expanded(of_contents, known, "content", heavy))
