"""Queries of the ranked index over the test tables, each with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievora.functions import scoring, vectors
from sievora.operators import postings as P
from sievora.operators.ranking import RankedIndex
from sievora.session import materialized, work_folder
from sievora.sources.tables import spread, table, valid_passages
from sievora.streaming.ingest import stream_insert

TERMS = ("index", "posting", "statistics")
REPEATED = "posting Index posting qqqunknown statistics INDEX"
TOP = 50
#: The limit of the test indexes, above every LIMIT used below.
LIMIT = 1000
SEALED = "coalesce(source, '') <> 'manual'"
GROWING = "source = 'manual'"
DEAD = "lang = 'fr'"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def _index(df: DataFrame, name: str = "documents", **more: object) -> RankedIndex:
    return RankedIndex.build(df, "doc_id", "text", name, **{"limit": LIMIT, **more})


def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    return _index(_documents(spark, folder)).postings.select("doc_id", "term", "tf")


def doc_length_norm(spark: SparkSession, folder: str) -> DataFrame:
    return _index(_documents(spark, folder)).documents


def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The SQL functions against the lengths of the documents."""
    scoring.register_sql(spark)
    made = _index(_documents(spark, folder)).documents
    return made.selectExpr("doc_id", "bm25_fieldnorm(len) AS fieldnorm", "bm25_qlen(len) AS qlen", "round(bm25_idf(len + 1, 1), 6) AS idf", "round(bm25_tf(2, bm25_qlen(len), 100, 1.2, 0.75), 6) AS tf")


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(_documents(spark, folder)).stats.select("n", "sum_len", F.round("avgdl", 6).alias("avgdl"))


def term_df_idf(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    return index.terms.select("term", "df", F.round(scoring.idf(index.stats.select("n").scalar(), F.col("df")), 6).alias("idf"))


def term_wand(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    bounds = P.term_bounds(index.postings, index.stats.select("avgdl").scalar(), index.options.k1, index.options.b)
    return bounds.select("term", "df", F.round("ub_tf", 6).alias("ub_tf"))


def evaluate_all(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    index = _index(documents)
    return index.evaluate(documents, index.query_terms(TERMS)).select("doc_id", "score")


def search_topk(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    return index.search(index.query_terms(TERMS), TOP)


def _filtered(spark: SparkSession, folder: str, first: bool) -> DataFrame:
    documents = _documents(spark, folder)
    index = _index(documents, limit=TOP, prefilter=first)
    return index.search(index.query_terms(TERMS), predicate="lang = 'en' AND n_chars > 500", rows=documents)


def search_postfilter(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, False)


def search_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, True)


def search_partial_index(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder), "german", where="lang = 'de'")
    return index.search(index.query("und wort liste"), TOP)


def search_dup_query_terms(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    return index.search(index.query(REPEATED), TOP)


def search_k1_b(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder), k1=2.0, b=0.0)
    return index.search(index.query_terms(TERMS), TOP)


def _grown(spark: SparkSession, folder: str) -> RankedIndex:
    documents = _documents(spark, folder)
    index = _index(documents.where(SEALED))
    index.insert(documents.where(GROWING))
    return index


def search_growing(spark: SparkSession, folder: str) -> DataFrame:
    index = _grown(spark, folder)
    return index.search(index.query_terms((*TERMS, "qqqunknown")), TOP)


def _changed(spark: SparkSession, folder: str) -> RankedIndex:
    index = _grown(spark, folder)
    index.delete(table(spark, folder, "documents").where(DEAD).select("doc_id"))
    return index


def search_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    index = _changed(spark, folder)
    return index.search(index.query_terms(TERMS), TOP)


def search_after_maintain(spark: SparkSession, folder: str) -> DataFrame:
    index = _changed(spark, folder)
    index.maintain()
    return index.search(index.query_terms(TERMS), TOP)


def search_setting_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """The option, the session's value above it, both after the option changed, and the option again."""
    index = _index(_documents(spark, folder), limit=2)
    query = index.query_terms(TERMS)
    out = index.search(query, 10).withColumn("step", F.lit(1))
    before = spark.conf.get("bm25.limit", None)
    try:
        spark.conf.set("bm25.limit", "3")
        out = out.unionByName(index.search(query, 10).withColumn("step", F.lit(2)))
        index.alter(limit=1)
        out = out.unionByName(index.search(query, 10).withColumn("step", F.lit(3)))
        spark.conf.unset("bm25.limit")
        out = out.unionByName(index.search(query, 10).withColumn("step", F.lit(4)))
    finally:
        spark.conf.unset("bm25.limit") if before is None else spark.conf.set("bm25.limit", before)
    return out


def search_batch(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("text"))
    return _index(_documents(spark, folder)).search_batch(items, 5)


def _placed(index: RankedIndex) -> DataFrame:
    return P.with_block_numbers(materialized(P.ordered_postings(index.postings), "ordered"))


def posting_blocks(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    blocks = P.block_stats(_placed(index), index.stats.select("avgdl").scalar(), index.options.k1, index.options.b)
    return blocks.select("term", "block_no", "min_doc", "max_doc", "n", F.round("ub_tf", 6).alias("ub_tf"))


def block_widths(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    return P.block_widths(_placed(index), P.dense_ordinals(index.documents))


def index_describe(spark: SparkSession, folder: str) -> DataFrame:
    return _changed(spark, folder).describe()


def ids_to_vector(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    return parts.select("l_orderkey", F.inline(vectors.ids_vector(F.col("ids")))).select("l_orderkey", "term", "tf")


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    valid = valid_passages(table(spark, folder, "passages"), "embedding").where("embedding IS NOT NULL")
    return vectors.with_positions_vector(valid, "embedding", "vector").select("id", "vector")


def vector_text(spark: SparkSession, folder: str) -> DataFrame:
    text = vectors.vector_text(F.col("vector"))
    again = vectors.vector_text(vectors.text_vector(text))  # the text form is read back and written once more
    return _embeddings(spark, folder).where(F.forall("vector", lambda x: x["tf"] > 0)).select("id", again.alias("vector"))


def vector_equality(spark: SparkSession, folder: str) -> DataFrame:
    """(first_id, id): the passages with the vector of an earlier one."""
    each = _embeddings(spark, folder).select("id", F.sha2(vectors.vector_text(F.col("vector")), 256).alias("key"))
    firsts = each.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(firsts.select("key", "first_id"), "key").where("id <> first_id").select("first_id", "id")


def vocabulary_growth(spark: SparkSession, folder: str) -> DataFrame:
    return _grown(spark, folder).new_terms()


def search_join_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "level_labels").where("band IS NOT NULL").select("doc_id", "band").distinct()
    index = _index(_documents(spark, folder))
    return index.search(index.query_terms(TERMS), LIMIT).join(labels, "doc_id").select("doc_id", "score", "band")


def search_cte_count(spark: SparkSession, folder: str) -> DataFrame:
    _filtered(spark, folder, False).createOrReplaceTempView("bm25_found")
    return spark.sql("WITH found AS (SELECT * FROM bm25_found) SELECT count(*) AS n FROM found")


def score_f32(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(_documents(spark, folder))
    return index.search(index.query_terms(TERMS), TOP).select("doc_id", F.round(F.col("score").cast("float").cast("double"), 4).alias("score"))


def search_passages(spark: SparkSession, folder: str) -> DataFrame:
    valid = valid_passages(table(spark, folder, "passages"), "passage")
    index = RankedIndex.build(valid, "id", "passage", "passages", limit=LIMIT)
    return index.search(index.query("the posting of a query document"), TOP)


def search_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    valid = valid_passages(table(spark, folder, "passages"), "embedding", "index_id")
    index = RankedIndex.build(valid, "id", "embedding", "vectors", analysis="positions", limit=LIMIT)
    return index.search(index.query_terms(["document", "search", "block"]), TOP)


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The index written to the shared folder, a tenth of the documents streamed in, a delete, then a search after loading it."""
    documents, path = _documents(spark, folder), f"{work_folder(spark)}/index-{uuid.uuid4().hex}"
    index = _index(documents.where(SEALED), path=path)
    stream = spark.readStream.schema(table(spark, folder, "documents").schema).parquet(f"{folder}/documents.parque[t]")  # a pattern, since a stream of one file is refused
    stream_insert(index, stream.where(GROWING), f"{path}-stream").awaitTermination()
    index.delete(documents.where(DEAD).select("doc_id"))
    again = RankedIndex.load(spark, path)
    return again.search(again.query_terms(TERMS), TOP)


_WORDS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"
_QLEN = "CASE WHEN len < 40 THEN len ELSE least(24 + (((len - 24) >> (length(bin(len - 24)) - 4)) << (length(bin(len - 24)) - 4)), 2013265944) END"
_NORM = "CASE WHEN len < 40 THEN len ELSE least(24 + 8 * (length(bin(len - 24)) - 3) + (((len - 24) >> (length(bin(len - 24)) - 4)) & 7), 255) END"


def _base(sealed: str = "TRUE", growing: str = "FALSE", dead: str = "FALSE", source: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    flag = lambda x, name: f"coalesce({x}, FALSE) AS {name}"
    return f"""
WITH d AS (SELECT {key} AS doc_id, {_WORDS % text} AS w, {flag(sealed, "sealed")}, {flag(growing, "growing")}, {flag(dead, "dead")} FROM {source} WHERE {text} IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
l AS (SELECT *, {_QLEN} AS qlen FROM (SELECT doc_id, sealed, growing, dead, len(w)::BIGINT AS len FROM d)),
s AS (SELECT count(*) AS n, sum(len)::BIGINT AS sum_len, sum(len)::DOUBLE / count(*) AS avgdl FROM l WHERE sealed),
t AS (SELECT term, count(*) AS df FROM p JOIN l USING (doc_id) WHERE sealed GROUP BY term)"""


def _tf(k1: float = 1.2, b: float = 0.75) -> str:
    return f"tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * qlen / avgdl))"


def _scored(base: str, terms: tuple[str, ...] = TERMS, k1: float = 1.2, b: float = 0.75) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{base},
h AS (SELECT doc_id, round(-sum(ln((n + 1)::DOUBLE / (df + 0.5::DOUBLE)) * {_tf(k1, b)}), 6) AS score
      FROM p JOIN t USING (term) JOIN l USING (doc_id), s WHERE term IN ({listed}) AND (sealed OR growing) AND NOT dead GROUP BY doc_id)
"""


def _top(with_scores: str, k: int = TOP) -> str:
    return f"{with_scores} SELECT doc_id, score FROM h ORDER BY score, doc_id LIMIT {k}"


_VALID = "(SELECT * FROM passages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_VECTORS = f"""
WITH x AS (SELECT id, unnest(regexp_extract_all(embedding, '''(?:[^'']|'''')*''[^\\s'']*|\\S+')) AS entry FROM {_VALID} WHERE embedding IS NOT NULL),
y AS (SELECT id, regexp_replace(entry, ':[0-9A-D,]+$', '') AS term, len(string_split(regexp_extract(entry, ':([0-9A-D,]+)$', 1), ',')) AS tf FROM x),
z AS (SELECT id, CASE WHEN term LIKE '''%''' THEN replace(term[2:-2], '''''', '''') ELSE term END AS term, sum(tf)::BIGINT AS tf FROM y GROUP BY ALL),
e AS (SELECT id FROM {_VALID} WHERE embedding IS NOT NULL),
v AS (SELECT e.id, '{{' || coalesce(string_agg(z.term || ':' || z.tf, ', ' ORDER BY z.term), '') || '}}' AS vector FROM e LEFT JOIN z USING (id) GROUP BY e.id)"""
_FILTER = "JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 500"
_CHANGED = _base(SEALED, GROWING, DEAD)
_PLACED = f"{_base()}, q AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128)::INTEGER AS block_no FROM p)"

QUERIES = {
    f.__name__: f
    for f in (
        term_freq, doc_length_norm, sql_functions, corpus_stats, term_df_idf, term_wand, evaluate_all, search_topk, search_postfilter, search_prefilter,
        search_partial_index, search_dup_query_terms, search_k1_b, search_growing, search_tombstones, search_after_maintain, search_setting_precedence,
        search_batch, posting_blocks, block_widths, index_describe, ids_to_vector, vector_text, vector_equality, vocabulary_growth, search_join_labels,
        search_cte_count, score_f32, search_passages, search_embeddings, stream_ingest,
    )
}
ORACLES = {
    "term_freq": f"{_base()} SELECT * FROM p",
    "doc_length_norm": f"{_base()} SELECT doc_id, len, qlen, ({_NORM})::INTEGER AS fieldnorm FROM l",
    "sql_functions": f"""{_base()}, f AS (SELECT doc_id, len, qlen, 2 AS tf, 100::DOUBLE AS avgdl FROM l)
SELECT doc_id, ({_NORM})::INTEGER AS fieldnorm, qlen, round(ln((len + 2)::DOUBLE / 1.5::DOUBLE), 6) AS idf, round({_tf()}, 6) AS tf FROM f""",
    "corpus_stats": f"{_base()} SELECT n, sum_len, round(avgdl, 6) AS avgdl FROM s",
    "term_df_idf": f"{_base()} SELECT term, df, round(ln((n + 1)::DOUBLE / (df + 0.5::DOUBLE)), 6) AS idf FROM t, s",
    "term_wand": f"{_base()} SELECT term, count(*) AS df, round(max({_tf()}), 6) AS ub_tf FROM p JOIN l USING (doc_id), s GROUP BY term",
    "evaluate_all": f"{_scored(_base())} SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(score, 0) END AS score FROM documents LEFT JOIN h USING (doc_id)",
    "search_topk": _top(_scored(_base())),
    "search_postfilter": f"{_scored(_base())} SELECT doc_id, score FROM (SELECT * FROM h ORDER BY score, doc_id LIMIT {TOP}) {_FILTER}",
    "search_prefilter": f"{_scored(_base())} SELECT doc_id, score FROM h {_FILTER} ORDER BY score, doc_id LIMIT {TOP}",
    "search_partial_index": _top(_scored(_base("lang = 'de'"), ("und", "wort", "liste"))),
    "search_dup_query_terms": _top(_scored(_base())),
    "search_k1_b": _top(_scored(_base(), k1=2.0, b=0.0)),
    "search_growing": _top(_scored(_base(SEALED, GROWING))),
    "search_tombstones": _top(_scored(_CHANGED)),
    "search_after_maintain": _top(_scored(_base(f"NOT coalesce({DEAD}, FALSE)"))),
    "search_setting_precedence": f"""{_scored(_base())}, r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS nth FROM h)
SELECT doc_id, score, step FROM r JOIN (VALUES (1, 2), (2, 3), (3, 3), (4, 1)) AS w(step, most) ON nth <= most""",
    "search_batch": f"""{_base()},
i AS (SELECT item_id, list_distinct({_WORDS % "item_text"}) AS w FROM eval_items WHERE item_text IS NOT NULL),
it AS (SELECT item_id AS query_id, unnest(w) AS term FROM i),
h AS (SELECT query_id, doc_id, round(-sum(ln((n + 1)::DOUBLE / (df + 0.5::DOUBLE)) * {_tf()}), 6) AS score
      FROM it JOIN t USING (term) JOIN p USING (term) JOIN l USING (doc_id), s GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INTEGER AS rank FROM h QUALIFY rank <= 5""",
    "posting_blocks": f"""{_PLACED} SELECT term, block_no, min(doc_id) AS min_doc, max(doc_id) AS max_doc, count(*)::INTEGER AS n, round(max({_tf()}), 6) AS ub_tf
FROM q JOIN l USING (doc_id), s GROUP BY term, block_no""",
    "block_widths": f"""{_PLACED}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM l),
x AS (SELECT term, block_no, tf, o - coalesce(lag(o) OVER (PARTITION BY term, block_no ORDER BY o), o) AS delta FROM q JOIN o USING (doc_id)),
y AS (SELECT term, block_no, count(*)::INTEGER AS n, bit_or(delta) AS d, bit_or(tf) AS t FROM x GROUP BY term, block_no),
b AS (SELECT term, block_no, n, (CASE WHEN d = 0 THEN 0 ELSE length(bin(d)) END)::INTEGER AS doc_bits, (CASE WHEN t = 0 THEN 0 ELSE length(bin(t)) END)::INTEGER AS tf_bits FROM y)
SELECT *, (CASE WHEN n = 128 THEN doc_bits ELSE 128 + greatest(1, (doc_bits + 7) // 8) END)::INTEGER AS doc_width,
       (CASE WHEN n = 128 THEN tf_bits ELSE 128 + greatest(1, (tf_bits + 7) // 8) END)::INTEGER AS tf_width FROM b""",
    "index_describe": f"""{_CHANGED}, k AS (SELECT term, count(*) AS n FROM p JOIN l USING (doc_id) WHERE sealed GROUP BY term)
SELECT 'documents' AS structure, count(*) AS rows FROM l WHERE sealed UNION ALL SELECT 'postings', sum(n)::BIGINT FROM k UNION ALL SELECT 'terms', count(*) FROM k
UNION ALL SELECT 'blocks', sum((n + 127) // 128)::BIGINT FROM k UNION ALL SELECT 'growing', count(*) FROM l WHERE growing AND NOT dead
UNION ALL SELECT 'tombstones', count(*) FROM documents WHERE {DEAD}""",
    "ids_to_vector": "SELECT l_orderkey, l_partkey::VARCHAR AS term, count(*) AS tf FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY ALL",
    "vector_text": f"{_VECTORS} SELECT * FROM v",
    "vector_equality": f"{_VECTORS}, f AS (SELECT vector, min(id) AS first_id FROM v GROUP BY vector) SELECT first_id, id FROM v JOIN f USING (vector) WHERE id <> first_id",
    "vocabulary_growth": f"{_base(SEALED, GROWING)} SELECT term, count(*) AS df FROM p JOIN l USING (doc_id) WHERE growing AND term NOT IN (SELECT term FROM t) GROUP BY term",
    "search_join_labels": f"""{_scored(_base())}, r AS (SELECT * FROM h ORDER BY score, doc_id LIMIT {LIMIT})
SELECT doc_id, score, band FROM r JOIN (SELECT DISTINCT doc_id, band FROM level_labels WHERE band IS NOT NULL) USING (doc_id)""",
    "search_cte_count": f"{_scored(_base())} SELECT count(*) AS n FROM (SELECT * FROM h ORDER BY score, doc_id LIMIT {TOP}) {_FILTER}",
    "score_f32": f"{_scored(_base())} SELECT doc_id, round(score::FLOAT::DOUBLE, 4) AS score FROM h ORDER BY h.score, doc_id LIMIT {TOP}",
    "search_passages": _top(_scored(_base(source=_VALID, text="passage", key="id::BIGINT"), ("the", "posting", "of", "a", "query", "document"))),
    "search_embeddings": f"""{_VECTORS}, l AS (SELECT id, len, {_QLEN} AS qlen FROM (SELECT e.id, coalesce(sum(tf), 0)::BIGINT AS len FROM e LEFT JOIN z USING (id) GROUP BY e.id)),
s AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*) AS avgdl FROM l), t AS (SELECT term, count(*) AS df FROM z GROUP BY term)
SELECT id::BIGINT AS doc_id, round(-sum(ln((n + 1)::DOUBLE / (df + 0.5::DOUBLE)) * {_tf()}), 6) AS score
FROM z JOIN t USING (term) JOIN l USING (id), s WHERE term IN ('document', 'search', 'block') GROUP BY id ORDER BY score, doc_id LIMIT {TOP}""",
    "stream_ingest": _top(_scored(_CHANGED)),
}
