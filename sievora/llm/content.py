"""Content of a passage apart from its outward form, and the passages that share one content.

A passage is its sequence of tokens: words in lower case and numbers with their sign and
decimal points; everything else is form. A passage made up of at least three `label: value`
(or `label = value`) fields is the multiset of its fields, whatever their order. Each field is
hashed, the hashes are added up (a commutative multiset hash), and passages are grouped by the sums.
The groups are then verified: passages of one sequence must have equal tokens, passages of one
multiset every field equally often. The fields are counted, never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievora.operators.skew import MAX_HEAVY, salted_join
from sievora.session import materialized
from sievora.sources.tables import latest_rows

#: A minus directly before a digit and a point between digits belong to the number.
TOKEN = r"(?:-(?=\p{Nd}))?[\p{L}\p{N}]++(?:(?<=\p{Nd})\.(?=\p{Nd})[\p{L}\p{N}]++)*+"
BREAKS = r"[;|\n\r\x0b\x0c\x85  ]+"
#: A label is one to four words.
FIELD = r"(?s)^[^\p{L}\p{N}:=]*[\p{L}\p{N}_-]+(?:[\p{Zs}\t]+[\p{L}\p{N}_-]+){0,3}[^\p{L}\p{N}:=]*[:=].*$"
WORDY = r"[\p{L}\p{N}]"
LEAST_FIELDS = 3
MINUS = "−"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(text), MINUS, "-"), F.lit(TOKEN), F.lit(0))


def _normal(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def fields(text: Column) -> Column:
    """The normal form of each field (tokens of name and value); null for a passage that isn't made up of fields.

    Pieces without a letter or digit are form and don't count.
    """
    pieces = F.filter(F.split(text, BREAKS), lambda x: x.rlike(WORDY))
    fielded = text.rlike(BREAKS) & (F.size(pieces) >= LEAST_FIELDS) & F.forall(pieces, lambda x: x.rlike(FIELD))
    return F.when(fielded, F.transform(pieces, _normal))


def _hash40(x: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), x), 24)


def sequence_hash(whole: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(11), whole).alias("a"), F.xxhash64(F.lit(12), whole).alias("b"))


def multiset_hash(items: Column) -> Column:
    """Three sums of 40-bit hashes of the items: equal for equal multisets, whatever their order."""

    def total(seed: int) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + _hash40(x, seed))

    return F.when(items.isNotNull(), F.struct(total(1).alias("a"), total(2).alias("b"), total(3).alias("c")))


def fingerprints(passages: DataFrame) -> DataFrame:
    """(id, loaded_at, sequence, multiset) of the valid passages that have a word.

    Hashed before the valid row of each id is chosen, so no text is shuffled.
    """
    whole = _normal(F.col("passage"))
    hashed = passages.where("id IS NOT NULL").select(
        "id",
        "loaded_at",
        F.when(whole != "", sequence_hash(whole)).alias("sequence"),
        multiset_hash(fields(F.col("passage"))).alias("multiset"),
    )
    return latest_rows(hashed, "id", "loaded_at", ["loaded_at", "sequence", "multiset"]).where("sequence IS NOT NULL")


def smallest_linked(edges: DataFrame) -> DataFrame:
    """(a, first): of each left node of a bipartite graph (a, b) the smallest left node of its component.

    Each round hands the smallest label over and back; only edges and labels in the shared folder take
    part. Rounds end once no label falls.
    """
    labels = edges.select("a", F.col("a").alias("first")).distinct()
    while True:
        over = edges.join(labels, "a").groupBy("b").agg(F.min("first").alias("first"))
        back = edges.join(over, "b").groupBy("a").agg(F.min("first").alias("least"))
        after = materialized(labels.join(back, "a").select("a", F.least("first", "least").alias("first"), (F.col("least") < F.col("first")).alias("fell")), "labels")
        labels = after.select("a", "first")
        if after.where("fell").isEmpty():
            return labels


def _sequence_groups(rows: DataFrame) -> DataFrame:
    """(sequence, first_id, n): of each sequence the smallest id of its content and its number of rows.

    A sequence belongs to the contents into whose fields its rows are cut; sequences with a content
    in common are one content. Where no sequence is cut in two ways these are stars, told by one minimum; else
    the components of the graph are followed to their end.
    """
    sequences = rows.groupBy("sequence").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
    cuts = rows.where("multiset IS NOT NULL").groupBy("sequence", "multiset").agg(F.min("id").alias("m"))
    if cuts.groupBy("sequence").count().where("count > 1").isEmpty():
        linked = cuts.join(sequences.select("sequence", "a"), "sequence")
        of_content = linked.groupBy("multiset").agg(F.min("a").alias("first"))
        labels = cuts.select("sequence", "multiset").join(of_content, "multiset").select("sequence", "first")
        return sequences.join(labels, "sequence", "left").select("sequence", F.coalesce("first", "a").alias("first_id"), "n")
    of_content = cuts.groupBy("multiset").agg(F.min("m").alias("b"))
    edges = cuts.join(sequences.select("sequence", "a"), "sequence").join(of_content, "multiset").select("a", "b")
    labels = smallest_linked(materialized(edges, "links"))
    return sequences.join(labels, "a", "left").select("sequence", F.coalesce("first", "a").alias("first_id"), "n")


def _members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows of the contents of several ids, with first_id. Sequences of many rows are split over tasks."""
    totals = groups.groupBy("first_id").agg(F.sum("n").alias("total")).where("total > 1").select("first_id")
    several = groups.join(totals, "first_id")
    total = groups.agg(F.sum("n")).scalar()
    heavy = groups.where(F.col("n") * MAX_HEAVY >= total).select("sequence")
    return salted_join(rows, several.select("sequence", "first_id"), ["sequence"], heavy, F.xxhash64("id"))


def _unequal(members: DataFrame) -> DataFrame:
    """(first_id) of the groups in which equal hashes hide unequal passages: normally none.

    members: first_id, sequence, multiset, id, whole, fields. Counted with partial sums in each task, so a group of any size is no burden.
    """
    wholes = members.groupBy("first_id", "sequence").agg(F.min("whole").alias("one"), F.max("whole").alias("other"))
    of_fields = members.where("multiset IS NOT NULL").select("first_id", "multiset", "id", F.explode("fields").alias("field"))
    times = of_fields.groupBy("first_id", "multiset", "field", "id").agg(F.count(F.lit(1)).alias("times"))
    each = times.groupBy("first_id", "multiset", "field").agg(
        F.min("times").alias("least"), F.max("times").alias("most"), F.count(F.lit(1)).alias("holders")
    )
    holders = members.where("multiset IS NOT NULL").groupBy("first_id", "multiset").agg(F.count(F.lit(1)).alias("all"))
    odd = each.join(holders, ["first_id", "multiset"]).where("least < most OR holders < all")
    return wholes.where("one <> other").select("first_id").unionByName(odd.select("first_id")).distinct()


def contents(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, copies) of the valid passages with a word.

    groups: first_id (the smallest id of a content), copies (number of its other ids). copies: first_id, copy_id,
    a row for each other id. Null passages, those without a word and rows without id don't count;
    columns beside id, passage and loaded_at are not read; no rows give no rows.

    Runs jobs when called: the fingerprints go to the shared folder, and the groups of several ids
    are verified against the texts. Groups that only share hashes are taken apart by their full tokens and fields.
    """
    rows = materialized(fingerprints(passages), "fingerprints")
    groups = _sequence_groups(rows)
    members = materialized(_members(rows, groups), "members")
    valid = passages.select("id", "loaded_at", "passage").join(
        members.select("id", F.col("loaded_at").alias("at"), "sequence", "multiset", "first_id"), "id"
    )
    valid = valid.where(F.col("loaded_at").eqNullSafe(F.col("at"))).dropDuplicates(["id"])
    texts = valid.select("id", "loaded_at", "first_id", "sequence", "multiset", _normal(F.col("passage")).alias("whole"), fields(F.col("passage")).alias("fields"))
    unequal = materialized(_unequal(texts), "unequal")
    totals = groups.groupBy("first_id").agg((F.sum("n") - 1).alias("copies"))
    copies = members.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
    if unequal.isEmpty():
        return totals, copies
    # the same grouping once more for those groups, with the tokens and the fields themselves in place of hashes
    exact = texts.join(unequal, "first_id", "left_semi").select(
        "id", "loaded_at", F.col("whole").alias("sequence"), F.when(F.col("multiset").isNotNull(), F.array_sort("fields")).alias("multiset")
    )
    exact = materialized(exact, "exact")
    regrouped = _sequence_groups(exact)
    totals = totals.join(unequal, "first_id", "left_anti").unionByName(regrouped.groupBy("first_id").agg((F.sum("n") - 1).alias("copies")))
    again = _members(exact, regrouped).where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
    return totals, copies.join(unequal, "first_id", "left_anti").unionByName(again)
