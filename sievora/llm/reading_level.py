"""Reading band of documents: how far down frequency-ranked vocabularies one must go to cover their prose.

The prose of the labelled documents gives each band its words, ranked by frequency. Of each stretch of prose
the coverage rank under a band is the size of the smallest top of that band's list that covers
SHARE of its words. The bands of the lowest coverage rank, with the stretch's complexity (its words and the letters of
a word), make a cell; SQL calibrates from the labels how much each cell speaks for each band, and adds up what
the cells of a document say. The lists of all languages are one: a word meets only words of its own language,
so neither the language column nor quotations in another language matter.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievora.session import materialized

BANDS = (1, 2, 3, 4)
LEAST_PROSE = 30
#: Share of the words of a stretch that a list has to cover.
SHARE = 0.75
#: Rank of a word that a band's list lacks, and the most words of a list.
MISSING = LISTED = 50_000
ROUNDS = 3
#: Labels that are learned from; of more, those with the smallest hashes.
MOST_LABELS = 50_000
#: So many words of evidence weigh as much as the coverage rank alone.
PRIOR = 200
#: Text without full stops is taken in stretches of so many words; in a part of LONG words a sign of code is one in prose.
CHUNK, LONG = 25, 60
#: Highest classes of letters a word and of words a stretch (by fours).
LETTERS, LENGTHS = 12, 8
#: Marks of one word in angle brackets, as of markup or of dialogues; they are signs, not code.
_MARK = re.compile(r"</?\w+/?>|<\|\w*\|>")
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[.!?…])\s+|[\n\r\x0b\x0c\x85\u2028\u2029]+")
_CODE = re.compile(r"[{}<>|=]|^\s*(?:SELECT|INSERT|UPDATE|DELETE)\b.*;\s*$|\w\(\w*\)|\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d")
#: Whatever _CODE finds holds one of these.
_SIGNS = frozenset("{}<>|=;(-:")
_SPACE = re.compile(r"\s+")

Ranks = dict[str, tuple[int, ...]]


@functools.cache
def _format_signs() -> frozenset[str]:
    """All characters of the category Cf, which have no width."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf")


def prose(text: str | None) -> list[list[str]]:
    """The words of each stretch (sentence or line) of running prose; code, logs, numbers and signs are left out."""
    if not text:
        return []
    if not text.isascii():
        text = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
        if not _format_signs().isdisjoint(text):
            text = "".join(c for c in text if c not in _format_signs())
    stretches = []
    for part in _BREAK.split(_MARK.sub(" ", text)):
        found = _WORD.findall(part.lower())
        letters = [w for w in found if w.isalpha()]
        if not letters or len(letters) < 0.7 * len(found) or sum(map(len, letters)) < 0.6 * (len(part) - sum(map(len, _SPACE.findall(part)))):
            continue
        if len(found) >= LONG or _SIGNS.isdisjoint(part) or not _CODE.search(part):
            stretches += [letters[i : i + CHUNK] for i in range(0, len(letters), CHUNK)]
    return stretches


def ranked(counts: dict[int, Counter[str]]) -> Ranks:
    """Each word's rank in the list of each band."""
    ranks: dict[str, list[int]] = {}
    for at, band in enumerate(BANDS):
        listed = sorted(counts[band].items(), key=lambda x: (-x[1], x[0]))[:LISTED]
        for n, (word, _) in enumerate(listed, 1):
            ranks.setdefault(word, [MISSING] * len(BANDS))[at] = n
    return {word: tuple(x) for word, x in ranks.items()}


class Vocabularies:
    """The lists of all bands as one matrix, and coverage ranks by it."""

    def __init__(self, ranks: Ranks) -> None:
        self.at = {word: i for i, word in enumerate(ranks, 1)}
        self.ranks = np.array([(MISSING,) * len(BANDS), *ranks.values()], np.int32)

    def coverage(self, stretches: list[list[str]], share: float = SHARE) -> np.ndarray:
        """For each stretch and band the size of the smallest top of the list that covers `share` of the words."""
        sizes = np.array([len(s) for s in stretches])
        ids = np.zeros((len(stretches), max(sizes.max(initial=1), 1)), np.int64)
        within = np.arange(ids.shape[1]) < sizes[:, None]
        at = self.at
        ids[within] = [at.get(w, 0) for s in stretches for w in s]
        found = np.where(within[:, :, None], self.ranks[ids], np.int32(2 * MISSING))
        found.sort(axis=1)
        last = np.maximum(1, np.ceil(share * sizes)).astype(np.int64) - 1
        return np.take_along_axis(found, last[:, None, None], axis=1)[:, 0]

    def nearest(self, stretches: list[list[str]]) -> np.ndarray:
        """The bands of the lowest coverage rank, as bits."""
        if not stretches:
            return np.empty(0, np.int64)
        ranks = self.coverage(stretches)
        return (ranks == ranks.min(axis=1, keepdims=True)) @ (1 << np.arange(len(BANDS)))


def complexity(words: list[str]) -> tuple[int, int]:
    """Classes of the letters of a word and of the words of the stretch."""
    return min(LETTERS, sum(map(len, words)) // len(words)), min(LENGTHS, len(words) // 4)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _prose_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, found = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stretches = prose(text)
            labels += [label] * len(stretches)
            found += [" ".join(s) for s in stretches]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.string())], names=["band", "words"])


def _count_task(ranks: Ranks) -> Task:
    schema = pa.schema([("band", pa.int32()), ("word", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Vocabularies(ranks)
        for batch in batches:
            counts: Counter[tuple[int, str]] = Counter()
            stretches = [x.split(" ") for x in batch.column(1).to_pylist()]
            for label, bits, words in zip(batch.column(0).to_pylist(), lists.nearest(stretches).tolist(), stretches):
                band = bits.bit_length() if bits & (bits - 1) == 0 else label
                counts.update((band, word) for word in words)
            columns = [pa.array([b for b, _ in counts], pa.int32()), pa.array([w for _, w in counts], pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _cell_task(ranks: Ranks, ready: bool) -> Task:
    """From (key, words of a stretch) if ready, else from (key, text) of documents with enough prose, to the words in each cell of a key."""
    names = "key", "nearest", "letters", "length", "words"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Vocabularies(ranks)
        for batch in batches:
            cells: Counter[tuple[int, int, int, int]] = Counter()
            keys, stretches = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [text.split(" ")] if ready else prose(text)
                if ready or sum(map(len, own)) >= LEAST_PROSE:
                    keys += [key] * len(own)
                    stretches += own
            for key, bits, words in zip(keys, lists.nearest(stretches).tolist(), stretches):
                cells[(key, bits, *complexity(words))] += len(words)
            columns = [pa.array([cell[i] for cell in cells], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.values(), pa.int64())], names=names)

    return run


CELLS = "key bigint, nearest bigint, letters bigint, length bigint, words bigint"


def learned(stretches: DataFrame) -> Ranks:
    """Ranks from (band, words). After the first round a stretch counts for the band it is nearest to, so mixed
    documents and mistaken labels lose their weight.

    The words are counted where the texts are; the driver gets LISTED words a band at most.
    """
    ranks: Ranks = {}
    for _ in range(ROUNDS):
        each = stretches.mapInArrow(_count_task(ranks), "band int, word string, times bigint")
        totals = each.groupBy("band", "word").agg(F.sum("times").alias("times"))
        nth = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("times"), "word"))
        counts: dict[int, Counter[str]] = {band: Counter() for band in BANDS}
        for row in totals.withColumn("nth", nth).where(F.col("nth") <= LISTED).toLocalIterator():
            counts[row.band][row.word] = row.times
        ranks = ranked(counts)
    return ranks


def _share(band: int) -> str:
    """What the coverage rank alone gives a band: its part of the nearest ones."""
    return f"(nearest >> {band - 1} & 1) / bit_count(nearest)"


def calibrated(evidence: DataFrame) -> DataFrame:
    """(nearest, letters, length, w1 .. w4): how much a word of each cell speaks for each band, from cells by label (key).

    Little evidence leaves the weight near what the coverage rank says, much evidence overrules it.
    """
    weights = ", ".join(f"({PRIOR} * {_share(b)} + sum(CASE WHEN key = {b} THEN words ELSE 0 END)) / ({PRIOR} + sum(words)) AS w{b}" for b in BANDS)
    return evidence.sparkSession.sql(f"SELECT nearest, letters, length, {weights} FROM {{evidence}} GROUP BY nearest, letters, length", evidence=evidence)


def banded(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, band): the band for which most of the words speak, of equal ones the lower."""
    votes = ", ".join(f"round(sum(words * coalesce(w{b}, {_share(b)})), 6) AS v{b}" for b in BANDS)
    cases = " ".join(f"WHEN v{b} >= greatest({', '.join(f'v{x}' for x in BANDS)}) THEN {b}" for b in BANDS)
    # a row for each cell: at most 15 * (LETTERS + 1) * (LENGTHS + 1)
    return cells.sparkSession.sql(
        f"""WITH votes AS (SELECT /*+ BROADCAST(w) */ key, {votes} FROM {{cells}} LEFT JOIN {{weights}} AS w USING (nearest, letters, length) GROUP BY key)
        SELECT key AS doc_id, CAST(CASE {cases} END AS INT) AS band FROM votes""",
        cells=cells,
        weights=weights,
    )


def reading_bands(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """(doc_id, band) of every document with at least LEAST_PROSE words of prose.

    Every label of a known document counts, null ones and unknown bands don't; two labels of a document both do. Without any
    label every document has band 1. Null, empty and blank texts give no row; rows of one doc_id are one document;
    further columns are not read. Learning runs jobs when called.
    """
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = labels.where(F.col("band").isin(*BANDS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("band").cast("int").alias("band"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "band").limit(most_labels)
    stretches = materialized(known.join(texts, "doc_id").select("band", "text").mapInArrow(_prose_task, "band int, words string"), "prose")
    ranks = learned(stretches)
    weights = calibrated(stretches.mapInArrow(_cell_task(ranks, True), CELLS))
    return banded(texts.mapInArrow(_cell_task(ranks, False), CELLS), weights)
