"""A ranked full-text index: build, exact search, evaluation, insert, delete and maintain.

Statistics (number of documents, lengths, document frequencies, vocabulary) are those of the documents
sealed at the last build or maintain, deleted ones included; documents inserted since are searched
with these, and their new terms have no weight until maintain. With a path everything is kept in
Parquet under epochs, named by numbered manifests, of which the last one holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievora.functions.scoring import idf, quantised_length, saturated_tf
from sievora.functions.vectors import analyser, ids_vector, positions_vector, vector_length, with_positions_vector
from sievora.functions.words import WORD
from sievora.operators import postings as P
from sievora.operators.skew import MAX_HEAVY, salted_join
from sievora.plans.options import LARGEST_LIMIT, IndexOptions, scan_enabled, search_limit, search_prefilter
from sievora.sources import files

FORMAT = 1
#: Scores are ordered as rounded to so many decimals, then by document id.
DECIMALS = 6
#: Queries of more distinct terms than this are joined, not broadcast.
FEW_TERMS = 10_000
#: Most blocks of a query's terms that are sent to every task, and the slack that rounding of scores asks for.
MOST_BLOCKS, SLACK = 500_000, 2e-6
WORD_SQL = WORD.replace("\\", "\\\\")
VECTOR = "array<struct<term:string,tf:bigint>>"


@dataclass(frozen=True)
class RankedQuery:
    """The distinct terms of a query, None for a null vector, and the name of the index it is meant for."""

    index: str | None
    terms: tuple[str, ...] | None


def to_query(terms: Iterable[str] | None, index: str | None) -> RankedQuery:
    """Terms with repeats and in any order; how often a term occurs in a query doesn't matter."""
    return RankedQuery(index, None if terms is None else tuple(sorted({t for t in terms if t})))


def _vectors(df: DataFrame, id_col: str, column: str, analysis: str) -> DataFrame:
    """(doc_id, len, vector or terms) of the rows whose column isn't null. A null id is an error."""
    doc_id = F.coalesce(F.col(id_col), F.raise_error(F.lit(f"{id_col} is null"))).cast("bigint").alias("doc_id")
    present = df.where(F.col(column).isNotNull())
    if analysis in ("positions", "ids", "vector"):
        if analysis == "positions":
            v = with_positions_vector(present.select(doc_id, F.col(column).alias("__text")), "__text", "vector").drop("__text")
        else:
            v = present.select(doc_id, (ids_vector(F.col(column)) if analysis == "ids" else F.col(column).cast(VECTOR)).alias("vector"))
        return v.select("doc_id", vector_length(F.col("vector")).alias("len"), "vector")
    terms = present.select(doc_id, analyser(analysis)(F.col(column)).alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("bigint").alias("len"), "terms")


def _postings(vectors: DataFrame) -> DataFrame:
    return P.vector_rows(vectors) if "vector" in vectors.columns else P.term_rows(vectors)


class RankedIndex:
    """See the module. Made by `build` or `load`; without a path it is a plan over the source, with nothing written."""

    def __init__(self, spark: SparkSession, name: str, source: dict, options: IndexOptions, path: str | None = None) -> None:
        self.spark, self.name, self.source, self.options, self.path = spark, name, source, options, path
        self.documents: DataFrame
        self.postings: DataFrame
        self.terms: DataFrame
        self.stats: DataFrame
        self.blocks: DataFrame | None = None  # with a path only
        self.growing: DataFrame | None = None  # doc_id, qlen, len, term, tf of inserted documents; a null term for one without any
        self.dead: DataFrame | None = None
        self.epoch, self.version, self.batch = 0, 0, 0
        self._numbers: tuple[int, int] | None = None

    # -- building ---------------------------------------------------------------------------------

    @classmethod
    def build(
        cls, df: DataFrame, id_col: str, column: str, name: str, analysis: str = "simple", where: str | None = None, path: str | None = None, **options: object
    ) -> RankedIndex:
        """Index one column. analysis: an analyser of texts, or positions, ids or vector for ready vectors.

        Null values are left out and don't count; empty ones count with length 0. `where` makes a partial index. Ids must be unique.
        """
        if not isinstance(column, str):
            raise ValueError("an index over several columns is not supported")
        if column not in df.columns:
            raise ValueError(f"no column {column!r} to index")
        index = cls(df.sparkSession, name, {"id": id_col, "column": column, "analysis": analysis, "where": where}, IndexOptions.of(**options), path)
        index._seal_source(df)
        return index

    def _seal_source(self, df: DataFrame) -> None:
        """Analyse the source and seal it. With a path the vectors are written first, so that texts are analysed once."""
        where = self.source["where"]
        vectors = _vectors(df.where(where) if where else df, self.source["id"], self.source["column"], self.source["analysis"])
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        if self.path:
            if not self.version and files.exists(self.spark, f"{self.path}/manifests"):
                raise ValueError(f"{self.path} already holds an index")
            vectors.write.parquet(staged)
            vectors = self.spark.read.schema(vectors.schema).parquet(staged)
        self._seal(P.document_rows(vectors), _postings(vectors))
        if self.path:
            files.remove(self.spark, staged)

    def _seal(self, documents: DataFrame, postings: DataFrame) -> None:
        """Take these as the sealed documents; with a path, write the tables of a new epoch and its manifest."""
        if self.path:
            self.epoch += 1
            # a folder of its own: what a failed build left is never read
            self.folder = f"epoch-{self.epoch}-{uuid.uuid4().hex[:8]}"
            root = f"{self.path}/{self.folder}"
            documents.repartitionByRange("doc_id").write.parquet(f"{root}/documents")
            P.ordered_postings(postings).write.parquet(f"{root}/ordered")
            stats = P.corpus_stats(self.spark.read.parquet(f"{root}/documents")).first()
            self._numbers = (stats.n, stats.sum_len)
            ordered = self.spark.read.parquet(f"{root}/ordered")
            P.with_block_numbers(ordered).write.parquet(f"{root}/postings")
            files.remove(self.spark, f"{root}/ordered")
            placed, average = self.spark.read.parquet(f"{root}/postings"), F.lit(stats.avgdl)
            bounds = P.term_bounds(placed, average, self.options.k1, self.options.b)
            bounds.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
            P.block_stats(placed, average, self.options.k1, self.options.b).write.parquet(f"{root}/blocks")
            self.batch, self.inserted, self.deleted = 0, [], []
            self._commit()
            self._open()
        else:
            self.documents, self.postings, self.terms = documents, postings, P.term_stats(postings)
            self.stats = P.corpus_stats(documents)
            self.growing = self.dead = None
            self.batch = 0

    # -- storage ----------------------------------------------------------------------------------

    def _commit(self) -> None:
        """Write the next manifest; of two writers of the same one the second fails."""
        self.version += 1
        state = {"format": FORMAT, "name": self.name, "source": self.source, "options": asdict(self.options), "epoch": self.epoch, "folder": self.folder}
        state |= {"batch": self.batch, "numbers": self._numbers, "inserted": self.inserted, "deleted": self.deleted}
        target = f"{self.path}/manifests/{self.version:09d}.json"
        if files.exists(self.spark, target):
            raise RuntimeError(f"another writer has changed {self.path}")
        files.write_new(self.spark, target, json.dumps(state))

    def _open(self) -> None:
        read, root = self.spark.read, f"{self.path}/{self.folder}"
        self.documents, self.postings, self.terms, self.blocks = (read.parquet(f"{root}/{t}") for t in ("documents", "postings", "terms", "blocks"))
        n, total = self._numbers
        self.stats = self.spark.sql(f"SELECT {n}L AS n, {total}L AS sum_len, try_divide({total}D, {n}D) AS avgdl")
        self.growing = read.parquet(*[f"{root}/{x}" for x in self.inserted]) if self.inserted else None
        self.dead = read.parquet(*[f"{root}/{x}" for x in self.deleted]) if self.deleted else None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RankedIndex:
        """The index at path as of its last manifest. What later writers add is seen by another load."""
        found = files.names(spark, f"{path}/manifests")
        if not found:
            raise ValueError(f"{path} is not an index")
        state = json.loads(files.read(spark, f"{path}/manifests/{found[-1]}"))
        if state["format"] != FORMAT:
            raise ValueError(f"bad version number {state['format']} of the index; build it again")
        index = cls(spark, state["name"], state["source"], IndexOptions(**state["options"]), path)
        index.epoch, index.folder, index.batch, index.version = state["epoch"], state["folder"], state["batch"], int(found[-1].split(".")[0])
        index._numbers, index.inserted, index.deleted = tuple(state["numbers"]), state["inserted"], state["deleted"]
        index._open()
        return index

    def free_old_epochs(self) -> list[str]:
        """Remove the folders of earlier epochs and what failed builds left; the manifests' history goes with them."""
        gone = [x for x in files.names(self.spark, self.path) if x.startswith(("epoch-", "staged-")) and x != self.folder]
        for x in gone:
            files.remove(self.spark, f"{self.path}/{x}")
        for x in files.names(self.spark, f"{self.path}/manifests"):
            if int(x.split(".")[0]) < self.version:
                files.remove(self.spark, f"{self.path}/manifests/{x}")
        return gone

    def alter(self, **options: object) -> None:
        """Change limit or prefilter (None unsets)."""
        self.options = self.options.altered(**options)
        if self.path:
            self._commit()

    def rebuild(self, df: DataFrame, **options: object) -> None:
        """Build again from the source, perhaps with other options."""
        self.options = IndexOptions.of(**{**asdict(self.options), **options})
        self._seal_source(df)

    def describe(self) -> DataFrame:
        """(structure, rows) of each table of the index."""
        empty = self.spark.range(0)
        growing = self._growing().select("doc_id", "batch").distinct() if self.growing is not None else empty
        dead = self.dead.select("doc_id").distinct() if self.dead is not None else empty
        of_terms = self.terms.select(F.ceil(F.col("df") / P.BLOCK).alias("blocks"))
        parts = {"documents": self.documents, "postings": self.postings, "terms": self.terms, "growing": growing, "tombstones": dead}
        out = of_terms.agg(F.lit("blocks").alias("structure"), F.coalesce(F.sum("blocks"), F.lit(0)).cast("bigint").alias("rows"))
        for name, df in parts.items():
            out = out.unionByName(df.agg(F.lit(name).alias("structure"), F.count(F.lit(1)).alias("rows")))
        return out

    # -- change -----------------------------------------------------------------------------------

    def insert(self, df: DataFrame, key: str | None = None) -> None:
        """Append documents; statistics stay as they are. With the same key again, the rows take the place of the earlier ones."""
        where = self.source["where"]
        vectors = _vectors(df.where(where) if where else df, self.source["id"], self.source["column"], self.source["analysis"])
        documents, terms = vectors.select("doc_id", "len", quantised_length(F.col("len")).alias("qlen")), _postings(vectors)
        rows = terms.select("doc_id", "term", "tf").join(documents, "doc_id", "right") if "terms" in vectors.columns else None
        if rows is None:
            rows = vectors.select("doc_id", "len", quantised_length(F.col("len")).alias("qlen"), F.inline_outer("vector"))
        self.batch += 1
        rows = rows.select("doc_id", "len", "qlen", "term", "tf", F.lit(self.batch).alias("batch"))
        if self.path:
            part = f"growing-{key or uuid.uuid4().hex}"
            rows.write.mode("overwrite").parquet(f"{self.path}/{self.folder}/{part}")
            self.inserted = [*[x for x in self.inserted if x != part], part]
            self._commit()
            self._open()
        else:
            self.growing = rows if self.growing is None else self.growing.unionByName(rows)

    def delete(self, ids: DataFrame) -> None:
        """Mark the documents of the first column's ids as deleted. One inserted again later is alive."""
        self.batch += 1
        rows = ids.select(F.col(ids.columns[0]).cast("bigint").alias("doc_id"), F.lit(self.batch).alias("dead_at"))
        if self.path:
            part = f"deleted-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{self.folder}/{part}")
            self.deleted = [*self.deleted, part]
            self._commit()
            self._open()
        else:
            self.dead = rows if self.dead is None else self.dead.unionByName(rows)

    def _alive(self, df: DataFrame) -> DataFrame:
        """df (doc_id, perhaps batch) without the deleted documents."""
        if self.dead is None:
            return df
        dead = self.dead.groupBy("doc_id").agg(F.max("dead_at").alias("dead_at"))
        if "batch" not in df.columns:
            return df.join(dead, "doc_id", "left_anti")
        dead = dead.withColumnRenamed("doc_id", "dead_id")
        return df.join(dead, (F.col("doc_id") == F.col("dead_id")) & (F.col("batch") < F.col("dead_at")), "left_anti")

    def _growing(self) -> DataFrame:
        return self._alive(self.growing)

    def _all_rows(self) -> tuple[DataFrame, DataFrame]:
        """Documents (doc_id, len) and postings of sealed and inserted documents that are alive."""
        documents, postings = self._alive(self.documents.select("doc_id", "len")), self._alive(self.postings.select("doc_id", "qlen", "term", "tf"))
        if self.growing is not None:
            growing = self._growing()
            documents = documents.unionByName(growing.select("doc_id", "len").distinct())
            postings = postings.unionByName(growing.where("term IS NOT NULL").select("doc_id", "qlen", "term", "tf"))
        return documents, postings

    def maintain(self) -> None:
        """Seal what is alive anew: fresh statistics and vocabulary, nothing growing, no tombstones."""
        documents, postings = self._all_rows()
        self._seal(P.document_rows(documents), postings)

    # -- queries ----------------------------------------------------------------------------------

    def query(self, text: str | None) -> RankedQuery:
        """A query from a text, split as the index splits its texts."""
        if text is None:
            return RankedQuery(self.name, None)
        split = analyser(self.source["analysis"] if self.source["analysis"] not in ("positions", "ids", "vector") else "simple")
        return to_query(self.spark.range(1).select(split(F.lit(text)).alias("t")).first().t, self.name)

    def query_terms(self, terms: Iterable[str]) -> RankedQuery:
        return to_query(terms, self.name)

    def _check(self, query: RankedQuery) -> None:
        if query.index is None:
            raise ValueError("the query contains a null index")
        if query.index != self.name:
            raise ValueError(f"expected index {query.index}, but got index {self.name}")

    def _weights(self, wanted: Column | None = None) -> DataFrame:
        """(term, idf, avgdl) of the vocabulary, or of its terms that are wanted."""
        n, average = self.stats.select("n").scalar(), self.stats.select("avgdl").scalar()
        known = self.terms if wanted is None else self.terms.where(wanted)
        return known.select("term", idf(n, F.col("df")).alias("idf"), average.alias("avgdl"))

    def _weight(self) -> Column:
        k1, b = F.lit(self.options.k1), F.lit(self.options.b)
        return F.col("idf") * saturated_tf(F.col("tf"), F.col("qlen"), F.col("avgdl"), k1, b)

    def _hits(self, terms: tuple[str, ...], best: int | None = None) -> DataFrame:
        """(doc_id, qlen, tf, idf, avgdl): the postings, alive, of the query's terms. term IN (...) reaches the scan.

        With best, postings of blocks that can't hold one of so many best documents are left out.
        """
        wanted = F.col("term").isin(list(terms)) if terms else F.lit(False)
        rows = self.postings.where(wanted)
        if best is not None:
            rows = self._promising(rows, wanted, best)
        rows = self._alive(rows.select("doc_id", "qlen", "term", "tf"))
        if self.growing is not None:
            rows = rows.unionByName(self._alive(self.growing.where(wanted)).select("doc_id", "qlen", "term", "tf"))
        weights = self._weights(wanted)
        # no more rows than the query has terms
        return rows.join(F.broadcast(weights) if len(terms) <= FEW_TERMS else weights, "term")

    def _promising(self, rows: DataFrame, wanted: Column, best: int) -> DataFrame:
        """rows of the blocks whose bound, with the bounds of all other terms, reaches the score that is sure.

        Sure is the `best`-th part score of documents of the blocks with the highest bounds: as many documents have
        that score at least. A document of a block below has less, whatever its other terms, so its rows don't matter.
        """
        weights = F.broadcast(self._weights(wanted))
        bounds = self.blocks.where(wanted).join(weights, "term").select("term", "block_no", (F.col("idf") * F.col("ub_tf")).alias("bound"))
        tops = self.terms.where(wanted).join(weights, "term").select("term", (F.col("idf") * F.col("ub_tf")).alias("top"))
        first = bounds.orderBy(F.desc("bound"), "term", "block_no").limit(2 * -(-best // P.BLOCK) + 2).select("term", "block_no")
        parts = self._alive(rows.join(F.broadcast(first), ["term", "block_no"])).join(weights, "term").groupBy("doc_id").agg(F.max(self._weight()).alias("part"))
        ranked = parts.orderBy(F.desc("part")).limit(best).agg(F.when(F.count(F.lit(1)) == best, F.min("part")).otherwise(F.lit(0.0)))
        others = tops.agg(F.sum("top")).scalar() - F.col("top")
        kept = bounds.join(F.broadcast(tops), "term").where(F.col("bound") + others >= ranked.scalar() - SLACK)
        return rows.join(F.broadcast(kept.select("term", "block_no")), ["term", "block_no"], "left_semi")  # MOST_BLOCKS at most, see search

    def scores(self, query: RankedQuery, best: int | None = None) -> DataFrame:
        """(doc_id, score) of every live document with a term of the query; score is the sum negated, so below 0.

        With best, documents beyond so many best ones may be missing or have a part of their score only.
        """
        self._check(query)
        hits = self._hits(query.terms or (), best)
        sums = hits.groupBy("doc_id").agg(F.round(-F.sum(self._weight()), DECIMALS).alias("score"))
        return sums.where("score < 0")

    def search(
        self, query: RankedQuery, limit: int | None = None, predicate: str | None = None, rows: DataFrame | None = None, prefilter: bool | None = None, prune: bool = False
    ) -> DataFrame:
        """(doc_id, score) of the best documents, in order; only those with a term of the query.

        At most as many as the setting `limit` of the session or the index, and as `limit` here, the LIMIT of the
        query. predicate, a condition on `rows` (which has the index's id column), applies to what was
        found, or with prefilter before the best are taken; null is false. Where the setting enable_scan
        is off, the documents are evaluated one and all, so documents without any term are found too.

        prune skips blocks of postings that can't reach the result, which stays the same. It needs an index with a path and
        no filter before the best, reads the number of blocks first, and is left alone where they are too many to broadcast.
        """
        self._check(query)
        id_col = self.source["id"]
        if query.terms is None:
            return self.spark.createDataFrame([], "doc_id bigint, score double")
        allowed = rows.where(predicate).select(F.col(id_col).cast("bigint").alias("doc_id")).distinct() if predicate else None
        if not scan_enabled(self.spark):
            found = self._alive_scores(query)
            found = found if allowed is None else found.join(allowed, "doc_id", "left_semi")
            return found.orderBy("score", "doc_id").limit(LARGEST_LIMIT if limit is None else limit)
        most = search_limit(self.spark, self.options)
        if most == 0:
            raise ValueError("number of needed rows is set to 0")
        first = search_prefilter(self.spark, self.options) if prefilter is None else prefilter
        inner = allowed is not None and first
        found = self.scores(query, most if prune and not inner and self._prunable(query) else None)
        if inner:
            found = found.join(allowed, "doc_id", "left_semi")
        found = found.orderBy("score", "doc_id").limit(most)
        if allowed is not None and not first:
            found = found.join(allowed, "doc_id", "left_semi")
        found = found.orderBy("score", "doc_id")
        return found if limit is None else found.limit(limit)

    def _prunable(self, query: RankedQuery) -> bool:
        if not self.path or not query.terms:
            return False
        wanted = self.terms.where(F.col("term").isin(list(query.terms)))
        return (wanted.agg(F.sum(F.ceil(F.col("df") / P.BLOCK))).first()[0] or 0) <= MOST_BLOCKS

    def lookup(self, terms: Iterable[str]) -> DataFrame:
        """(term, df, idf) of those of the terms that the vocabulary has."""
        listed = list(terms)
        found = self.terms.where(F.col("term").isin(listed) if listed else F.lit(False))
        return found.select("term", "df", idf(self.stats.select("n").scalar(), F.col("df")).alias("idf"))

    def term_postings(self, term: str) -> DataFrame:
        """(doc_id, tf, qlen) of one term's sealed postings; with a path only the row groups of that term are read."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf", "qlen")

    def fetch(self, found: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
        """found with columns of the source rows of its documents; what isn't in rows any more drops out."""
        source = rows.select(F.col(self.source["id"]).cast("bigint").alias("doc_id"), *columns)
        return found.join(source, "doc_id")

    def register(self, prefix: str | None = None) -> str:
        """Make the index available to spark.sql: the table function <prefix>_search(text, k) -> (doc_id, score, rank).

        It counts a term of the text once, reads the index as it is now, and can be called for each row of a query (LATERAL).
        """
        p = prefix or self.name
        split = self.source["analysis"]
        if split != "simple":
            raise ValueError("only the analyser simple can be called from SQL")
        documents, rows = self._all_rows()
        rows.createOrReplaceTempView(f"{p}_postings")
        self._weights().createOrReplaceTempView(f"{p}_weights")
        k1, b = self.options.k1, self.options.b
        weight = f"idf * tf * ({k1}D + 1D) / (tf + {k1}D * (1D - {b}D + {b}D * qlen / avgdl))"
        self.spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION {p}_search(query STRING, k INT) RETURNS TABLE (doc_id BIGINT, score DOUBLE, rank INT) RETURN
            SELECT doc_id, score, rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM (
                SELECT doc_id, round(-sum({weight}), {DECIMALS}) AS score
                FROM {p}_postings JOIN {p}_weights USING (term)
                WHERE array_contains(regexp_extract_all(lower({p}_search.query), '{WORD_SQL}', 0), term) GROUP BY doc_id)) WHERE rank <= {p}_search.k"""
        )
        return f"{p}_search"

    def _alive_scores(self, query: RankedQuery) -> DataFrame:
        documents, _ = self._all_rows()
        return documents.select("doc_id").join(self.scores(query), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def evaluate(self, df: DataFrame, query: RankedQuery) -> DataFrame:
        """df with the column score: each row of it scored by itself, indexed or not; 0 without a term, null for a null text.

        The rows' terms are joined with the vocabulary and summed by row, so texts don't move.
        """
        self._check(query)
        if query.terms is None:
            raise ValueError("the query contains a null vector")
        column, analysis, wanted = self.source["column"], self.source["analysis"], list(query.terms)
        if analysis in ("positions", "ids", "vector"):
            vector = {"positions": positions_vector, "ids": ids_vector, "vector": lambda x: x.cast(VECTOR)}[analysis](F.col(column))
            length, of = vector_length(F.col("__v")), lambda t: F.aggregate(F.filter("__v", lambda x: x["term"] == t), F.lit(0).cast("bigint"), lambda a, x: a + x["tf"])
        else:
            vector = analyser(analysis)(F.col(column))
            length, of = F.size("__v").cast("bigint"), lambda t: F.size(F.filter("__v", lambda x: x == t)).cast("bigint")
        weights = self._weights(F.col("term").isin(wanted) if wanted else F.lit(False))
        # one row with the weights of the query's terms
        known = weights.agg(F.collect_list(F.struct("term", "idf", "avgdl")).alias("w")).scalar()
        made = df.withColumn("__v", vector).withColumn("__q", quantised_length(length)).withColumn("__w", known)
        k1, b = F.lit(self.options.k1), F.lit(self.options.b)
        each = lambda w: w["idf"] * saturated_tf(of(w["term"]), F.col("__q"), w["avgdl"], k1, b)
        score = F.aggregate("__w", F.lit(0.0), lambda a, w: a + F.coalesce(each(w), F.lit(0.0)))
        return made.withColumn("score", F.when(F.col("__v").isNotNull(), F.round(-score, DECIMALS) + 0.0)).drop("__v", "__q", "__w")

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query of (query_id, text).

        Null texts give no row. Terms with a thousandth of the postings or more are split over tasks.
        """
        split = analyser(self.source["analysis"] if self.source["analysis"] not in ("positions", "ids", "vector") else "simple")
        each = queries.where("text IS NOT NULL").select("query_id", F.explode(F.array_distinct(split(F.col("text")))).alias("term"))
        weights = self._weights()
        asked = each.join(weights, "term").select("query_id", "term", "idf", "avgdl")
        rows = self._alive(self.postings.select("doc_id", "qlen", "term", "tf"))
        if self.growing is not None:
            rows = rows.unionByName(self._growing().where("term IS NOT NULL").select("doc_id", "qlen", "term", "tf"))
        heavy = self.terms.where(F.col("df") * MAX_HEAVY >= self.terms.agg(F.sum("df")).scalar()).select("term")
        hits = salted_join(rows, asked, ["term"], heavy, F.xxhash64("doc_id"))
        sums = hits.groupBy("query_id", "doc_id").agg(F.round(-F.sum(self._weight()), DECIMALS).alias("score")).where("score < 0")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "doc_id"))
        return sums.withColumn("rank", nth).where(F.col("rank") <= k)

    def new_terms(self) -> DataFrame:
        """(term, df): the terms that only inserted documents have; maintain would add them to the vocabulary."""
        if self.growing is None:
            return self.spark.createDataFrame([], "term string, df bigint")
        return P.term_stats(self._growing().where("term IS NOT NULL")).join(self.terms, "term", "left_anti")
