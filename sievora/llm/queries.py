"""Queries of the training-data operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievora.llm.bpe import token_ids
from sievora.llm.content import contents
from sievora.llm.distinctive import distinctive_terms, most_distinctive
from sievora.llm.item_search import documents_with_items
from sievora.llm.near_copies import near_copies, near_groups
from sievora.llm.reading_level import reading_bands
from sievora.llm.term_counts import marked_terms
from sievora.sources.tables import spread, table


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive_terms(spread(table(spark, folder, "passages")), table(spark, folder, "tokens"), table(spark, folder, "jumps"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_distinctive(p1_scores(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(spread(table(spark, folder, "passages")))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(spread(table(spark, folder, "passages")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return contents(spread(table(spark, folder, "passages")))[1]


def p4_contents(spark: SparkSession, folder: str) -> DataFrame:
    return contents(spread(table(spark, folder, "passages")))[0]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_counts(spark, folder).where("mark IS NOT NULL").select("element_key", "mark")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "elements"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(spread(table(spark, folder, "documents")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return documents_with_items(spread(table(spark, folder, "documents")), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading_bands(spread(table(spark, folder, "documents")), table(spark, folder, "level_labels"))


# A number keeps its sign and decimal points; RE2 has no lookaround, hence the long form.
_TOKEN = r"(?:-?\p{Nd}(?:\.\p{Nd})+|-\p{Nd}|[\p{L}\p{N}])(?:\p{Nd}(?:\.\p{Nd})+|[\p{L}\p{N}])*"
_NORMAL = f"array_to_string(regexp_extract_all(replace(lower(%s), chr(8722), '-'), '{_TOKEN}'), ' ')"
_VALID = """
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS nth
      FROM passages WHERE id IS NOT NULL) WHERE nth = 1)"""
_CONTENTS = (
    f"WITH RECURSIVE {_VALID},"
    + r"""
f AS (SELECT id, passage, list_filter(regexp_split_to_array(passage, '[;|\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS pieces
      FROM v WHERE passage IS NOT NULL),
k AS (SELECT id, """
    + _NORMAL % "passage"
    + r""" AS whole, len(pieces) >= 3 AND len(list_filter(pieces, lambda x:
        NOT regexp_matches(x, '(?s)^[^\p{L}\p{N}:=]*[\p{L}\p{N}_-]+([\p{Zs}\t]+[\p{L}\p{N}_-]+){0,3}[^\p{L}\p{N}:=]*[:=].*$'))) = 0 AS fielded,
      array_to_string(list_sort(list_transform(pieces, lambda x: """
    + _NORMAL % "x"
    + """)), ' ; ') AS parts FROM f),
l AS (SELECT DISTINCT whole, parts FROM k WHERE fielded),
several AS (SELECT whole, parts FROM l WHERE whole IN (SELECT whole FROM l GROUP BY whole HAVING count(*) > 1)),
links AS (SELECT DISTINCT a.parts AS one, b.parts AS other FROM several a JOIN several b USING (whole)),
reach AS (SELECT one, other FROM links UNION SELECT reach.one, links.other FROM reach JOIN links ON reach.other = links.one),
least AS (SELECT one AS parts, min(other) AS label FROM reach GROUP BY one),
m AS (SELECT whole, min(coalesce(label, parts)) AS parts FROM l LEFT JOIN least USING (parts) GROUP BY whole),
c AS (SELECT id, coalesce(m.parts, k.whole) AS content FROM k LEFT JOIN m USING (whole) WHERE whole <> ''),
g AS (SELECT content, min(id) AS first_id, count(*) - 1 AS copies FROM c GROUP BY content)
"""
)
_COUNTS = """
WITH v AS (SELECT passage_id, rtrim(element_key, chr(0)) AS element_key, max(element_value) AS tf FROM elements
           WHERE rtrim(element_key, chr(0)) <> '' AND element_value >= 1 AND passage_id IS NOT NULL GROUP BY ALL),
n AS (SELECT count(DISTINCT passage_id) AS n FROM v),
c AS (SELECT element_key, count(*) AS passages, sum(tf)::BIGINT AS occurrences FROM v GROUP BY element_key),
counts AS (SELECT element_key, passages, occurrences,
           CASE WHEN passages < 3 THEN 'rare' WHEN passages * 10 > n THEN 'common' END AS mark FROM c, n)
"""
_WORDS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"
_BEST = (
    f"WITH {_VALID},"
    + r"""
e AS (SELECT * FROM jumps WHERE index_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY epoch DESC) = 1),
t AS (SELECT index_id, token_key, max(tokens.number_of_documents) AS df FROM tokens JOIN e USING (index_id, epoch) GROUP BY ALL),
x AS (SELECT id, index_id, unnest(regexp_extract_all(embedding, '''(?:[^'']|'''')*''[^\s'']*|\S+')) AS entry FROM v WHERE embedding IS NOT NULL),
y AS (SELECT id, index_id, regexp_replace(entry, ':[0-9A-D,]+$', '') AS term,
      len(string_split(regexp_extract(entry, ':([0-9A-D,]+)$', 1), ',')) AS tf FROM x),
z AS (SELECT id, index_id, CASE WHEN term LIKE '''%''' THEN replace(term[2:-2], '''''', '''') ELSE term END AS element_key, tf FROM y),
l AS (SELECT id, sum(tf)::BIGINT AS length FROM z GROUP BY id),
m AS (SELECT id, CASE WHEN length < 40 THEN length ELSE least(24 + (length - 24) // (1 << (len(bin(length - 24)) - 4)) * (1 << (len(bin(length - 24)) - 4)), 2013265944) END AS qlen FROM l),
c AS (SELECT id, element_key, round(ln((e.number_of_documents::DOUBLE + 1) / (t.df::DOUBLE + 0.5::DOUBLE)) * (tf * (k1 + 1)
      / (tf + k1 * (1 - b + b * qlen / (e.sum_of_document_lengths::DOUBLE / e.number_of_documents)))), 6) AS c
      FROM z JOIN m USING (id) JOIN e USING (index_id) JOIN t ON t.index_id = z.index_id AND t.token_key = z.element_key WHERE t.df IS NOT NULL)
SELECT id, element_key FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, element_key) = 1"""
)
_RUNS = f"""
WITH i AS (SELECT item_id, {_WORDS % "item_text"} AS w FROM eval_items WHERE item_text IS NOT NULL),
d AS (SELECT doc_id, {_WORDS % "text"} AS w FROM documents WHERE text IS NOT NULL),
ir AS (SELECT item_id, unnest([array_to_string(w[n : n + 11], ' ') FOR n IN range(1, len(w) - 10)]) AS r FROM i WHERE len(w) >= 12),
dr AS (SELECT doc_id, unnest([array_to_string(w[n : n + 11], ' ') FOR n IN range(1, len(w) - 10)]) AS r FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p4_found": p4_found,
    "p4_contents": p4_contents,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}
ORACLES = {
    "p1_found": _BEST,
    "p2_found": _CONTENTS
    + f""", w AS (SELECT id, list_distinct({_WORDS % "passage"}) AS w, content FROM f JOIN c USING (id)),
n AS (SELECT * FROM w WHERE len(w) >= 38)
SELECT a.id AS id_a, b.id AS id_b FROM n a JOIN n b ON a.id < b.id AND a.content <> b.content
WHERE len(list_intersect(a.w, b.w)) * 10 >= 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
    "p2_groups": f"""WITH RECURSIVE {_VALID},
n AS (SELECT * FROM (SELECT id, list_distinct({_WORDS % "passage"}) AS w FROM v WHERE passage IS NOT NULL) WHERE len(w) >= 38),
links AS (SELECT a.id AS one, b.id AS other FROM n a JOIN n b ON len(list_intersect(a.w, b.w)) * 10 >= 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
reach AS (SELECT one, other FROM links UNION SELECT reach.one, links.other FROM reach JOIN links ON reach.other = links.one)
SELECT one AS id, min(other) AS class_id FROM reach GROUP BY one""",
    "p4_found": _CONTENTS + "SELECT first_id, id AS copy_id FROM c JOIN g USING (content) WHERE id <> first_id",
    "p4_contents": _CONTENTS + "SELECT first_id, copies FROM g",
    "p5_found": _COUNTS + "SELECT element_key, mark FROM counts WHERE mark IS NOT NULL",
    "p5_counts": _COUNTS + "SELECT * FROM counts",
    "p7_found": _RUNS,
}
