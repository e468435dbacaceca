"""Term vectors (terms with their frequencies): analysers, text forms and equality.

A vector is ARRAY<STRUCT<term STRING, tf BIGINT>>, each term once, tf at least 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievora.functions.words import words

#: A quoted term ('' is a quote inside it) or an unquoted one, with its positions.
ENTRY = r"'(?:[^']|'')*'[^\s']*|\S+"
POSITIONS = r":([0-9]+[A-D]?(?:,[0-9]+[A-D]?)*)$"

Analyser = Callable[[Column], Column]
_analysers: dict[str, Analyser] = {"simple": words}


def create_analyser(name: str, split: Analyser) -> None:
    """Register an analyser: a column expression from a text to the ARRAY<STRING> of its terms, with repeats."""
    if name in _analysers:
        raise ValueError(f"analyser {name!r} already exists")
    _analysers[name] = split


def drop_analyser(name: str) -> None:
    if name == "simple" or name not in _analysers:
        raise ValueError(f"analyser {name!r} can't be dropped")
    del _analysers[name]


def analyser(name: str) -> Analyser:
    if name not in _analysers:
        raise ValueError(f"no analyser {name!r}; there are {', '.join(sorted(_analysers))}")
    return _analysers[name]


def _summed(entries: Column) -> Column:
    """entries with equal terms merged into one."""
    keys = F.array_distinct(F.transform(entries, lambda x: x["term"]))
    tf = lambda k: F.aggregate(F.filter(entries, lambda x: x["term"] == k), F.lit(0).cast("bigint"), lambda a, x: a + x["tf"])
    merged = F.transform(keys, lambda k: F.struct(k.alias("term"), tf(k).alias("tf")))
    return F.when(F.size(keys) < F.size(entries), merged).otherwise(entries)


def _entries(text: Column) -> Column:
    """The terms of the text form `term:pos[,pos]` with their tf, a term as often as it is written."""

    def entry(x: Column) -> Column:
        positions, term = F.regexp_extract(x, POSITIONS, 1), F.regexp_replace(x, POSITIONS, "")
        inner = F.replace(F.substr(term, F.lit(2), F.length(term) - 2), F.lit("''"), F.lit("'"))
        quoted = F.startswith(term, F.lit("'")) & F.endswith(term, F.lit("'")) & (F.length(term) > 2)
        tf = F.when(positions == "", 0).otherwise(F.size(F.split(positions, ",")))
        return F.struct(F.when(quoted, inner).otherwise(term).alias("term"), tf.cast("bigint").alias("tf"))

    def plain(x: Column) -> Column:
        # term:12,30 without quotes or weights, told by the absence of both in the whole text
        at = F.split(x, ":")
        return F.struct(at[0].alias("term"), F.size(F.split(at[1], ",")).cast("bigint").alias("tf"))

    simple = text.rlike(r"^[^\s':]+:[0-9]+(?:,[0-9]+)*(?: [^\s':]+:[0-9]+(?:,[0-9]+)*)*$")
    return F.when(simple, F.transform(F.split(text, " "), plain)).otherwise(F.transform(F.regexp_extract_all(text, F.lit(ENTRY), F.lit(0)), entry))


def positions_vector(text: Column) -> Column:
    """The vector of the text form `term:pos[,pos]`; tf is the number of positions, 0 for a term without any.

    A position may carry a weight letter, a term may be quoted; both don't matter. Null for null, empty for a blank text.
    """
    return _summed(_entries(text))


def with_positions_vector(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with positions_vector(column) as `name`, in two steps, so that a text is parsed once only."""
    parsed = df.withColumn("__entries", _entries(F.col(column)))
    return parsed.withColumn(name, _summed(F.col("__entries"))).drop("__entries")


def ids_vector(ids: Column) -> Column:
    """The vector of an array of token ids, whose order doesn't matter; null ids don't count."""
    each = F.transform(F.filter(ids, lambda x: x.isNotNull()), lambda x: F.struct(x.cast("string").alias("term"), F.lit(1).cast("bigint").alias("tf")))
    return _summed(each)


def vector_length(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda a, x: a + x["tf"])


def canonical(vector: Column) -> Column:
    """The vector in the order of its terms, so that equal vectors are equal arrays."""
    return F.array_sort(vector)


def same_vector(one: Column, other: Column) -> Column:
    return canonical(one) == canonical(other)


def vector_text(vector: Column) -> Column:
    """`{term:tf, term:tf}` in the order of the terms."""
    return F.concat(F.lit("{"), F.array_join(F.transform(canonical(vector), lambda x: F.concat_ws(":", x["term"], x["tf"].cast("string"))), ", "), F.lit("}"))


def text_vector(text: Column) -> Column:
    """The vector of such a text (the last colon of an entry separates the tf); null where an entry isn't well formed."""
    inner = F.trim(F.regexp_extract(text, r"^\s*\{(.*)\}\s*$", 1))
    entries = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r",\s+"))
    parse = lambda x: F.struct(F.regexp_extract(x, r"^(.+):\d+$", 1).alias("term"), F.regexp_extract(x, r":(\d+)$", 1).try_cast("bigint").alias("tf"))
    well = text.rlike(r"^\s*\{.*\}\s*$") & F.forall(entries, lambda x: x.rlike(r"^.+:[1-9]\d*$"))
    return F.when(well, _summed(F.transform(entries, parse)))
