"""Evaluation items inside documents: Wu-Manber search for all their runs of 12 words at once.

Words take the place of letters. The patterns are all runs of 12 words of all items. SHIFT
tells for a block of two words how far the window may move on; only where it is 0 the
window itself is looked up.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievora.functions.words import words

RUN = 12
#: Words of the items that a task holds at once.
BLOCK_WORDS = 200_000


class WuManber:
    """Runs of `run` words of the items, (item_id, words), and the search for all of them."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN) -> None:
        self.run, self.most = run, run - 1  # a window without any known block moves on by run - 1 words
        self.shift: dict[tuple[str, str], int] = {}
        self.patterns: dict[tuple[str, ...], list[int]] = {}
        for item_id, item in items:
            for start in range(len(item) - run + 1):
                pattern = tuple(item[start : start + run])
                owners = self.patterns.setdefault(pattern, [])
                if item_id not in owners:
                    owners.append(item_id)
                for end in range(1, run):
                    block = (pattern[end - 1], pattern[end])
                    self.shift[block] = min(self.shift.get(block, self.most), run - 1 - end)

    def found(self, text: list[str]) -> set[int]:
        """The ids of the items of which the text holds a run."""
        items: set[int] = set()
        at, n, shift, most, run = self.run - 1, len(text), self.shift, self.most, self.run
        while at < n:
            step = shift.get((text[at - 1], text[at]), most)
            if step:
                at += step
            else:
                items.update(self.patterns.get(tuple(text[at - run + 1 : at + 1]), ()))
                at += 1
        return items


def _task(search: WuManber) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item_id in sorted(search.found(text.split(" "))):
                    docs.append(doc_id)
                    items.append(item_id)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int32())], schema=schema)

    return run


def item_blocks(items: Iterable[tuple[int, list[str]]], run: int = RUN, most: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of at most `most` words; a longer item is cut into parts that overlap by run - 1 words, so no run is lost."""
    block: list[tuple[int, list[str]]] = []
    held = 0
    for item_id, item in items:
        for start in range(0, len(item) - run + 1, most - run + 1):
            part = item[start : start + most]
            if block and held + len(part) > most:
                yield block
                block, held = [], 0
            block.append((item_id, part))
            held += len(part)
    if block:
        yield block


def documents_with_items(documents: DataFrame, items: DataFrame, run: int = RUN, most: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): the documents that contain at least `run` consecutive words of an item.

    The items come to the driver one by one and go to the tasks in blocks of at most `most` words, each searched for
    in a pass over the documents, so what is sent at once is bounded however many items there are. Null texts
    and items of fewer words give no row; repeated rows count once; further columns are not read.
    """
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.array_join(words(F.col("text")), " ").alias("words"))
    of_items = items.where("item_text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("int"), words(F.col("item_text")).alias("words"))
    rows = ((row.item_id, row.words) for row in of_items.where(F.size("words") >= run).toLocalIterator())
    found = [texts.mapInArrow(_task(WuManber(block, run)), "doc_id bigint, item_id int") for block in item_blocks(rows, run, most)]
    if not found:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id int")
    return functools.reduce(DataFrame.unionByName, found).distinct()
