"""Frequency of every term: recursive radix partitions on disk, each aggregated by DuckDB.

Rows of one passage and key are combined first. Each task then takes its rows in chunks of bounded size, combines
a chunk by term and writes the sums to files by bits of the terms' hash. A file that is too large
for memory is split by the next bits; every other one is aggregated on its own. Sums of tasks meet
by key in one exchange and go through the same once more, so a term of any share of
the rows is one row of each task there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievora.session import work_folder
from sievora.sources.tables import valid_elements

FANOUT_BITS = 4
MAX_LEVEL = 15
SCHEMA = pa.schema([("element_key", pa.string()), ("passages", pa.int64()), ("occurrences", pa.int64())])
#: Schemes of Hadoop's file systems as pyarrow names them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a folder as Spark names it."""
    scheme, colon, rest = folder.partition(":")
    if not colon:
        return pafs.LocalFileSystem(), folder
    if scheme not in SCHEMES:
        raise ValueError(f"terms can't be spilled to {folder}: no file system for {scheme}; choose one of {', '.join(SCHEMES)}")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    except (OSError, pa.ArrowInvalid) as why:
        raise ValueError(f"terms can't be spilled to {folder}: {why}") from why


class Engine:
    """One DuckDB connection of a task, with bounded memory, and the task's own folder of radix files."""

    def __init__(self, folder: str, memory_mb: int) -> None:
        self.fs, root = file_system(folder)
        self.root, self.deepest = f"{root.rstrip('/')}/radix-{uuid.uuid4().hex}", 0
        self.fs.create_dir(self.root, recursive=True)
        # DuckDB itself spills to a mounted folder only; elsewhere the size of a file keeps it within memory
        local = isinstance(self.fs, pafs.LocalFileSystem)
        config = {"threads": 1, "memory_limit": f"{memory_mb}MB", "preserve_insertion_order": False, "temp_directory": f"{self.root}/duckdb" if local else ""}
        self.connection = duckdb.connect(config=config)
        if local:
            self.connection.execute("SET max_temp_directory_size = '64GB'")

    def sums(self, held: pa.Table, more: str = "", order: str = "") -> pa.Table:
        """The sums by term of held."""
        self.connection.register("held", held)
        query = f"SELECT element_key, sum(passages)::BIGINT AS passages, sum(occurrences)::BIGINT AS occurrences{more} FROM held GROUP BY element_key{order}"
        found = self.connection.sql(query).to_arrow_table()
        self.connection.unregister("held")
        return found

    def parts(self, held: pa.Table, level: int) -> Iterator[tuple[int, pa.Table]]:
        """The sums by term of held, split by the hash bits of this level."""
        bits = f", ((hash(element_key) >> {FANOUT_BITS * level}) & {(1 << FANOUT_BITS) - 1})::INTEGER AS part"
        found = self.sums(held, bits, " ORDER BY part")
        part = found["part"].to_numpy()
        edges = np.searchsorted(part, np.arange((1 << FANOUT_BITS) + 1))
        for number, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if start < stop:
                yield number, found.slice(start, stop - start).select(SCHEMA.names).cast(SCHEMA)

    def close(self) -> None:
        self.connection.close()
        if self.fs.get_file_info(self.root).type != pafs.FileType.NotFound:
            self.fs.delete_dir(self.root)


def radix_sums(batches: Iterator[pa.RecordBatch], engine: Engine, most_bytes: int, level: int = 0, name: str = "r") -> Iterator[pa.RecordBatch]:
    """The sums of each term over all batches; every term comes out once. All rows go through the files of this level."""
    held: list[pa.Table] = []
    size = 0
    files: dict[int, list] = {}  # path, sink, writer and bytes of each part
    engine.deepest = max(engine.deepest, level)

    def spill() -> None:
        for part, rows in engine.parts(pa.concat_tables(held), level):
            if part not in files:
                path = f"{engine.root}/{name}-{part}.arrow"
                sink = engine.fs.open_output_stream(path)
                files[part] = [path, sink, pa.ipc.new_stream(sink, SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")), 0]
            files[part][2].write_table(rows)
            files[part][3] += rows.nbytes

    for batch in batches:
        held.append(pa.Table.from_batches([batch]).cast(SCHEMA))
        size += held[-1].nbytes
        if size > most_bytes:
            spill()
            held, size = [], 0
    if held:
        spill()
        held = []
    for _, sink, writer, _ in files.values():
        writer.close()
        sink.close()
    for part, (path, _, _, written) in sorted(files.items()):
        with engine.fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
            if written > most_bytes and level < MAX_LEVEL:
                yield from radix_sums(iter(reader), engine, most_bytes, level + 1, f"{name}-{part}")
            else:  # within memory, or all hash bits used: DuckDB goes out of core by itself
                yield from engine.sums(reader.read_all()).cast(SCHEMA).to_batches(max_chunksize=10_000)
        engine.fs.delete_file(path)


def _task(folder: str, most_bytes: int, memory_mb: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(folder, memory_mb)
        try:
            yield from radix_sums(batches, engine, most_bytes)
        finally:
            engine.close()

    return run


def passage_terms(elements: DataFrame) -> DataFrame:
    """(passage_id, element_key, tf): rows of one passage and key count once, with the largest value."""
    valid = valid_elements(elements, "passage_id", "element_value").where("passage_id IS NOT NULL")
    return valid.groupBy("passage_id", "element_key").agg(F.max("element_value").alias("tf"))


def term_counts(pairs: DataFrame, most_bytes: int = 32 << 20, memory_mb: int = 256) -> DataFrame:
    """(element_key, passages, occurrences) of every key of passage_terms.

    passages counts the distinct passage_id that hold the key, occurrences sums their
    element_value. Keys lose their NUL padding; null and empty keys, null or non-positive values and rows
    without passage_id don't count. No rows give no rows; further columns are not read.
    most_bytes bounds what a task holds. Files of terms go to the shared folder.
    """
    spark = pairs.sparkSession
    folder = work_folder(spark)
    file_system(folder)  # an unfit folder fails here, not in a task
    task = _task(folder, most_bytes, memory_mb)
    schema = "element_key string, passages bigint, occurrences bigint"
    ones = pairs.select("element_key", F.lit(1).cast("bigint").alias("passages"), F.col("tf").cast("bigint").alias("occurrences"))
    return ones.mapInArrow(task, schema).repartition("element_key").mapInArrow(task, schema)


def frequency_mark(passages: Column, total: Column, least: int = 3, most_share: int = 10) -> Column:
    """`rare` below `least` passages, `common` above one in `most_share` of all, else null."""
    return F.when(passages < least, "rare").when(passages * most_share > total, "common")


def marked_terms(elements: DataFrame, least: int = 3, most_share: int = 10, most_bytes: int = 32 << 20) -> DataFrame:
    """term_counts with the column mark. A key that is both rare and common (a tiny table) is rare.

    The number of passages is a scalar subquery over the same exchange of passage_terms (its filter, true for all
    rows, keeps the two alike), so elements is read once and nothing runs before the result is asked for.
    """
    pairs = passage_terms(elements)
    total = pairs.where("tf >= 1").agg(F.countDistinct("passage_id")).scalar()
    return term_counts(pairs, most_bytes).withColumn("mark", frequency_mark(F.col("passages"), total, least, most_share))
