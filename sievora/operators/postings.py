"""The tables of an index, made from vectors: documents, postings, terms, blocks and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievora.functions.scoring import fieldnorm, quantised_length, saturated_tf
from sievora.session import materialized

BLOCK = 128


def document_rows(vectors: DataFrame) -> DataFrame:
    """(doc_id, len, qlen, fieldnorm) of (doc_id, len); len is the sum of the term frequencies."""
    return vectors.select("doc_id", "len", quantised_length(F.col("len")).alias("qlen"), fieldnorm(F.col("len")).alias("fieldnorm"))


def term_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, qlen, term, tf) of (doc_id, len, terms ARRAY<STRING>); counted in each task before the shuffle."""
    # qlen is made before the rows are multiplied; the outer form, as the inner one would add filters that split each text twice more
    sized = texts.select("doc_id", quantised_length(F.col("len")).alias("qlen"), "terms")
    each = sized.select("doc_id", "qlen", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    return each.groupBy("doc_id", "qlen", "term").agg(F.count(F.lit(1)).alias("tf"))


def vector_rows(vectors: DataFrame) -> DataFrame:
    """(doc_id, qlen, term, tf) of (doc_id, len, vector)."""
    sized = vectors.select("doc_id", quantised_length(F.col("len")).alias("qlen"), "vector")
    return sized.select("doc_id", "qlen", F.inline_outer("vector")).where("term IS NOT NULL").select("doc_id", "qlen", "term", "tf")


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row (n, sum_len, avgdl); avgdl is null for an empty corpus."""
    found = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("sum_len"))
    return found.withColumn("avgdl", F.try_divide(F.col("sum_len").cast("double"), F.col("n").cast("double")))


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _best(keys: list[str], postings: DataFrame, average: Column, k1: float, b: float, *more: Column) -> DataFrame:
    """Of each group the (fieldnorm, tf) whose tf' is largest, of equal ones that of the first document."""
    weight = saturated_tf(F.col("tf"), F.col("qlen"), average, F.lit(k1), F.lit(b))
    top = F.max(F.struct(weight.alias("ub_tf"), (-F.col("doc_id")).alias("first"), fieldnorm(F.col("qlen")).alias("fieldnorm"), F.col("tf").alias("tf")))
    found = postings.groupBy(*keys).agg(top.alias("top"), *more)
    rest = [c for c in found.columns if c not in (*keys, "top")]
    return found.select(*keys, *rest, F.col("top.ub_tf").alias("ub_tf"), F.col("top.fieldnorm").alias("wand_fieldnorm"), F.col("top.tf").alias("wand_tf"))


def term_bounds(postings: DataFrame, average: Column, k1: float, b: float) -> DataFrame:
    """(term, df, ub_tf, wand_fieldnorm, wand_tf): with the upper bound of tf' over the documents of the term."""
    return _best(["term"], postings, average, k1, b, F.count(F.lit(1)).alias("df"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds nth, the place of a posting among those of its term in this task, whose rows are in order."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column(batch.schema.get_field_index("term"))
        runs = pc.run_end_encode(terms)
        nth, start = [], 0
        for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            before = seen if value == last else 0
            nth.append(pa.array(range(before, before + end - start), pa.int64()))
            last, seen, start = value, before + end - start, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(nth)], names=[*batch.schema.names, "nth"])


def ordered_postings(postings: DataFrame) -> DataFrame:
    """postings in ranges of (term, doc_id) with part, the range, and nth, the place in the term within it.

    Ranges are cut within a term too, so a term of any share of the rows is spread over tasks.
    """
    ranges = postings.select("term", "doc_id", "tf", "qlen").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    parted = ranges.withColumn("part", F.spark_partition_id())
    id_type = dict(postings.dtypes)["doc_id"]
    return parted.mapInArrow(_numbered, f"term string, doc_id {id_type}, tf bigint, qlen bigint, part int, nth bigint")


def with_block_numbers(ordered: DataFrame) -> DataFrame:
    """(term, doc_id, tf, qlen, block_no, place): blocks of BLOCK postings a term, from ordered_postings.

    ordered must have been written: it is read twice. Only terms that begin before a range need an offset, at
    most one a range, so the offsets are no more than the ranges.
    """
    sizes = ordered.groupBy("part", "term").agg(F.count(F.lit(1)).alias("n"))
    # the ranges of one term, no more than there are ranges
    before = F.sum("n").over(Window.partitionBy("term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("offset", before).where("offset IS NOT NULL").select("part", "term", "offset")
    placed = ordered.join(F.broadcast(offsets), ["part", "term"], "left").withColumn("place", F.col("nth") + F.coalesce("offset", F.lit(0)))
    return placed.select("term", "doc_id", "tf", "qlen", F.floor(F.col("place") / BLOCK).cast("int").alias("block_no"), "place")


def block_stats(placed: DataFrame, average: Column, k1: float, b: float) -> DataFrame:
    """(term, block_no, min_doc, max_doc, n, ub_tf, wand_fieldnorm, wand_tf) of each block."""
    extra = F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"), F.count(F.lit(1)).cast("int").alias("n")
    return _best(["term", "block_no"], placed, average, k1, b, *extra)


def bit_width(x: Column) -> Column:
    """Bits of the largest value of an OR of values; 0 if all are 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def width_byte(bits: Column, n: Column) -> Column:
    """The byte that says how a block is packed: full ones by bits, others, marked by 128, by bytes (at least one)."""
    return F.when(n == BLOCK, bits).otherwise(128 + F.greatest(F.lit(1), F.ceil(bits / 8).cast("int")))


def block_widths(placed: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(term, block_no, n, doc_bits, tf_bits, doc_width, tf_width) of each block.

    Document numbers are deltas to the one before in the block, the first to itself. ordinals: (doc_id, ordinal), dense from 0.
    """
    each = placed.join(ordinals, "doc_id").select("term", "block_no", "tf", F.col("ordinal").cast("bigint").alias("o"))
    # a window over one block, which is at most BLOCK rows
    before = F.lag("o").over(Window.partitionBy("term", "block_no").orderBy("o"))
    deltas = each.withColumn("delta", F.coalesce(F.col("o") - before, F.lit(0)))
    sums = deltas.groupBy("term", "block_no").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bit_or("delta").alias("d"), F.bit_or("tf").alias("t"))
    widths = sums.select("term", "block_no", "n", bit_width(F.col("d")).cast("int").alias("doc_bits"), bit_width(F.col("t")).cast("int").alias("tf_bits"))
    width = lambda c: width_byte(F.col(c), F.col("n")).cast("int")
    return widths.withColumns({"doc_width": width("doc_bits"), "tf_width": width("tf_bits")})


def dense_ordinals(documents: DataFrame) -> DataFrame:
    """(doc_id, ordinal): the place of each document in the order of ids, from 0, without one task seeing them all."""
    ranges = documents.select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # the id holds the partition in its upper bits and the row in its lower ones; both come from the sorted ranges
    marked = materialized(ranges.withColumn("at", F.monotonically_increasing_id()), "ordinals")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a partition
    sizes = marked.groupBy(part.alias("later")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("later").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("later", F.coalesce(running, F.lit(0)).alias("before"))
    return marked.join(F.broadcast(before), part == F.col("later")).select("doc_id", (F.col("before") + row).alias("ordinal"))
