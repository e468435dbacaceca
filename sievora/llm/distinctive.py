"""How much each term sets a passage apart from the rest of its index.

Two measures of one row: the enrichment score, from the exact hypergeometric tail, and the term's contribution to
the passage's own ranking score. The first asks how surprising it is to draw the term so often in a passage of that
length from all terms of the index; the second is what ranks the term in p1_found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievora.functions.scoring import idf, quantised_length, saturated_tf
from sievora.functions.vectors import vector_length, with_positions_vector
from sievora.sources.tables import current_epoch, current_jumps, valid_passages

#: Below it a factorial is taken from a table, above it from Stirling's series.
TABLED = 64
_LOG_FACTORIAL = np.array([math.lgamma(i + 1.0) for i in range(TABLED)])
DECIMALS = 6
#: Largest vocabulary, in bytes, that is sent to every task.
MOST_BROADCAST = 32 << 20
SCHEMA = "id int, element_key string, p_value double, score double, tf bigint, df bigint, length bigint, n bigint, avgdl double, k1 double, b double"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x + 1)) of whole numbers x, vectorised; exact to about 1e-15 of its size."""
    x = np.asarray(x, np.float64)
    z = np.maximum(x, TABLED - 1) + 1.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z
    return np.where(x < TABLED, _LOG_FACTORIAL[np.clip(x, 0, TABLED - 1).astype(np.int64)], series)


def log_falling(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """ln(a! / (a - k)!) of whole numbers 0 <= k <= a, the difference of two log-gammas.

    For a large the two nearly cancel, so their series are subtracted term by term.
    """
    a, k = np.broadcast_arrays(np.asarray(a, np.float64), np.asarray(k, np.float64))
    z, w = a + 1.0, np.maximum(a - k, TABLED - 1) + 1.0
    stirling = lambda y: (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    # (z - 1/2) ln z - z - (w - 1/2) ln w + w, with z - w = k and ln w = ln z + ln(1 - k / z)
    large = k * np.log(z) - (w - 0.5) * np.log1p(-np.minimum(k, z - w) / z) - k + stirling(z) - stirling(w)
    return np.where(a - k < TABLED, log_gamma(a) - log_gamma(a - k), large)


def log_upper_tail(tf: np.ndarray, length: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """ln P(X >= tf) for X the marked ones among `length` drawn from `total` of which `marked` are marked.

    The first term comes from log-gammas, each next one from the ratio of neighbours; they are summed until
    the rest is below what a double can tell, or all are summed.
    """
    k, n, m, t = (np.asarray(x, np.float64) for x in (tf, length, marked, total))
    low = np.maximum(k, np.maximum(0.0, n + m - t))
    high = np.minimum(n, m)
    possible = low <= high
    i = np.where(possible, low, high)
    # C(m, i) C(t - m, n - i) / C(t, n)
    first = log_falling(m, i) - log_gamma(i) + log_falling(t - m, n - i) - log_gamma(n - i) - log_falling(t, n) + log_gamma(n)
    sums, term, shift = np.ones_like(first), np.ones_like(first), np.zeros_like(first)
    at, running = i.copy(), np.flatnonzero(possible & (i < high))
    while len(running):
        x = at[running]
        ratio = (m[running] - x) * (n[running] - x) / ((x + 1.0) * (t[running] - m[running] - n[running] + x + 1.0))
        term[running] *= ratio
        sums[running] += term[running]
        at[running] += 1.0
        big = running[sums[running] > 1e200]
        if len(big):  # terms that first grow are scaled down
            shift[big] += np.log(sums[big])
            term[big] /= sums[big]
            sums[big] = 1.0
        # behind the mode each term is less than ratio times the one before, so a geometric series bounds the rest
        with np.errstate(over="ignore"):
            rest = np.where(ratio < 1.0, term[running] * ratio / np.maximum(1.0 - ratio, 1e-300), np.inf)
        running = running[(rest > 1e-17 * sums[running]) & (at[running] < high[running])]
    tail = np.minimum(first + np.log(sums) + shift, 0.0)
    # not a count that can occur: there are more than all marked ones
    return np.where(k <= np.maximum(0.0, n + m - t), 0.0, np.where(possible, tail, -np.inf))


def adjusted(log_p: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Benjamini and Hochberg's adjustment within each group, on logarithms; group holds 0, 0, 1, 1, 1, ... in order."""
    if not len(log_p):
        return log_p
    order = np.lexsort((log_p, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    sizes = np.diff(np.r_[starts, len(group)])
    place = np.arange(len(group)) - np.repeat(starts, sizes) + 1
    value = log_p[order] + np.log(np.repeat(sizes, sizes) / place)
    # least value from each place on: from the end, a running minimum that starts anew with each group
    backward, shift = value[::-1], np.repeat(np.arange(len(sizes)), sizes)[::-1]
    ranks = np.argsort(np.argsort(backward, kind="stable"), kind="stable")
    # groups come in falling order from the end; a large step a group keeps earlier groups out of the minimum
    least = np.minimum.accumulate(ranks + shift * len(group))
    kept = np.sort(backward, kind="stable")[least - shift * len(group)][::-1]
    out = np.empty_like(log_p)
    out[order] = np.minimum(kept, 0.0)
    return out


def _enriched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of all listed terms of a passage at once; a batch holds whole passages, one a row."""
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        group = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        of_passage = [column.take(pa.array(group)) for column in (batch.column(0), *batch.columns[2:])]
        of_term = [found.field(name) for name in ("element_key", "tf", "df")]
        tf, df, length, total = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (*of_term[1:], *of_passage[1:3]))
        # every other passage that holds the term has it once at least
        marked = df + np.maximum(tf, 1.0) - 1.0
        log_p = log_upper_tail(tf, length, marked, np.maximum(total, np.maximum(length, marked)))
        score = np.round(-adjusted(log_p, group) / math.log(10), DECIMALS) + 0.0
        columns = [of_passage[0], of_term[0], pa.array(np.exp(log_p)), pa.array(score), *of_term[1:], of_passage[1], *of_passage[3:]]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)


def distinctive_terms(passages: DataFrame, tokens: DataFrame, jumps: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, element_key, p_value, score, contribution) of each term of the valid passages that its index lists.

    p_value: the probability of at least as many occurrences of the term among as many draws as the passage is long,
    from sum_of_document_lengths occurrences of which the term has number_of_documents + tf - 1, what is sure to
    exist. score: its negative decimal logarithm after the false discovery adjustment over the passage's
    terms. contribution: the term's part in the ranking score of the passage, rounded to 6 decimals.

    A term that the current epoch of the index doesn't list, or lists without a count, gives no row; of several counts
    of one key the largest holds. A term written several times in one embedding is one term. Null and empty
    embeddings and passages of an index without a current epoch give no row; neither do empty tables. The size of the
    vocabulary is read when called, to choose the join; the rows are the same either way.
    """
    now = tokens.join(current_epoch(jumps), ["index_id", "epoch"], "left_semi")
    listed = now.groupBy("index_id", F.col("token_key").alias("element_key")).agg(F.max("number_of_documents").alias("df")).where("df IS NOT NULL")
    of_index = current_jumps(jumps).groupBy("index_id").agg(*[F.max(c).alias(c) for c in ("number_of_documents", "sum_of_document_lengths", "k1", "b")])
    n, total = F.col("number_of_documents"), F.col("sum_of_document_lengths")
    options = of_index.select("index_id", n.alias("n"), total.alias("total"), "k1", "b", F.try_divide(total.cast("double"), n.cast("double")).alias("avgdl"))

    valid = valid_passages(passages, "embedding", "index_id").where("embedding IS NOT NULL")
    parsed = with_positions_vector(valid, "embedding", "terms").withColumn("length", vector_length(F.col("terms")))
    # the outer form, since the inner one would add filters that parse each text twice more
    each = parsed.select("id", "index_id", "length", F.inline_outer("terms")).where("term IS NOT NULL").withColumnRenamed("term", "element_key")
    # a broadcast vocabulary leaves the terms of a passage where they are; a large one is joined by shuffles
    small = tokens.select(F.coalesce(F.sum(F.octet_length("token_key") + 64), F.lit(0)).alias("n")).first().n <= most_broadcast
    known = each.join(F.broadcast(listed) if small else listed, ["index_id", "element_key"])
    # a passage has no more rows than its own text has terms; what belongs to the passage is kept once
    records = known.groupBy("id", "index_id", "length").agg(F.collect_list(F.struct("element_key", "tf", "df")).alias("terms"))
    scored = records.join(options, "index_id").select(F.col("id").cast("int"), "terms", "length", "total", "n", "avgdl", "k1", "b").mapInArrow(_enriched, SCHEMA)
    weight = idf(F.col("n"), F.col("df")) * saturated_tf(F.col("tf"), quantised_length(F.col("length")), F.col("avgdl"), F.col("k1"), F.col("b"))
    return scored.select("id", "element_key", "p_value", "score", F.round(weight, DECIMALS).alias("contribution"))


def most_distinctive(found: DataFrame) -> DataFrame:
    """(id, element_key): of each id the term with the largest contribution, of equal ones the smallest key in byte order."""
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("contribution")).alias("c"), "element_key")).alias("best"))
    return best.select("id", "best.element_key")
