"""The ranked index against golden results, brute force and itself."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievora.functions import scoring, vectors
from sievora.operators.ranking import RankedIndex, RankedQuery
from sievora.plans.options import IndexOptions
from sievora.session import work_folder

PASSAGES = {
    1: "postgresql power open-sourc open sourc object-rel object relat databas system 15 year activ develop",
    2: "full-text full text search techniqu search plain-text plain text document textual databas field postgresql support tsvector",
    3: "bm25 rank function use search engin estim relev document given search queri",
    4: "postgresql provid mani advanc featur like full-text full text search window function",
    5: "search rank databas import build effect inform retriev system",
    6: "bm25 rank algorithm deriv probabilist retriev framework",
    7: "full-text full text search index document allow fast text queri postgresql support gin gist index",
    8: "postgresql communiti activ regular improv databas system",
    9: "postgresql support non-rel non relat relat data type",
    10: "effect search rank algorithm bm25 improv search result understand relev",
}
GOLDEN = [(8, -0.618032), (9, -0.592161), (4, -0.507229), (1, -0.473288), (7, -0.457966), (2, -0.443605)]
LEVELS = {0: 0, 39: 39, 40: 40, 41: 40, 42: 42, 63: 60, 64: 64, 2013265944: 2013265944, 4000000000: 2013265944}


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame([(i, t.split(), i % 2 == 0) for i, t in PASSAGES.items()], "id int, lexemes array<string>, flag boolean").withColumn("vector", vectors.ids_vector(F.col("lexemes"))).cache()


def build(df, name="full", **more):
    return RankedIndex.build(df, "id", "vector", name, analysis="vector", **{"limit": 100, **more})


def ids(df):
    return [r.doc_id for r in df.collect()]


@pytest.fixture
def settings(spark):
    yield spark.conf
    for name in ("bm25.limit", "bm25.prefilter", "bm25.enable_scan", "bm25.other"):
        spark.conf.unset(name)


def test_golden_order_and_scores(passages):
    index = build(passages)
    found = [tuple(r) for r in index.search(index.query_terms(["postgresql", "postgresql", "unknown"]), 10).collect()]
    assert found == GOLDEN
    every = {r.id: r.score for r in index.evaluate(passages, index.query_terms(["postgresql"])).collect()}
    assert {i: s for i, s in every.items() if s} == dict(GOLDEN) and len(every) == 10


def test_partial_indexes_and_the_wrong_index(passages):
    even, odd = build(passages, "even", where="id % 2 = 0"), build(passages, "odd", where="id % 2 = 1")
    assert ids(even.search(even.query_terms(["postgresql"]), 10)) == [8, 4, 2]
    assert ids(odd.search(odd.query_terms(["postgresql"]), 10)) == [9, 1, 7]
    with pytest.raises(ValueError, match="expected index even"):
        odd.search(even.query_terms(["postgresql"]))


def test_limit_of_session_and_index(passages, settings):
    index = build(passages, limit=2)
    query = index.query_terms(["postgresql"])
    assert ids(index.search(query)) == [8, 9]
    settings.set("bm25.limit", "3")
    assert ids(index.search(query)) == [8, 9, 4]
    index.alter(limit=1)
    assert ids(index.search(query)) == [8, 9, 4]
    settings.unset("bm25.limit")
    assert ids(index.search(query)) == [8]
    index.alter(prefilter=True)
    assert ids(index.search(query, predicate="id <> 8", rows=passages)) == [9]
    index.alter(limit=None)
    with pytest.raises(ValueError, match="number of needed rows is set to 0"):
        index.search(query)


def test_filter_after_and_before(passages, settings):
    index = build(passages, limit=3)
    query = index.query_terms(["postgresql"])
    assert index.search(query, predicate="flag", rows=passages).count() == 2
    settings.set("bm25.prefilter", "on")
    assert ids(index.search(query, predicate="flag", rows=passages)) == [8, 4, 2]
    assert index.search(query, predicate="CAST(NULL AS BOOLEAN)", rows=passages).isEmpty()


def test_without_the_index_all_documents_come_out(passages, settings):
    index = build(passages)
    settings.set("bm25.enable_scan", "off")
    found = index.search(index.query_terms(["postgresql"])).collect()
    assert [r.doc_id for r in found] == [8, 9, 4, 1, 7, 2, 3, 5, 6, 10] and found[-1].score == 0


def test_null_queries_and_bad_options(passages, settings):
    index = build(passages, limit=0)
    assert index.search(RankedQuery("full", None)).isEmpty()
    with pytest.raises(ValueError, match="null vector"):
        index.evaluate(passages, RankedQuery("full", None))
    with pytest.raises(ValueError, match="null index"):
        index.search(RankedQuery(None, ("a",)))
    for bad in ({"k1": 1.0}, {"b": 1.5}, {"limit": 70000}, {"limit": -1}, {"speed": 1}):
        with pytest.raises(ValueError):
            IndexOptions.of(**bad)
    with pytest.raises(ValueError, match="several columns"):
        RankedIndex.build(passages, "id", ["vector", "flag"], "x")
    settings.set("bm25.other", "1")
    with pytest.raises(ValueError, match="unrecognized"):
        build(passages).search(index.query_terms(["a"]))


def test_null_empty_and_long_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a a b", 0), (4, "Ä b " + "c " * 5000, 0), (5, "a a b", 0)]
    index = RankedIndex.build(spark.createDataFrame(rows, "id int, text string, score int"), "id", "text", "t", limit=10)
    stats = index.stats.first()
    assert (stats.n, stats.sum_len) == (4, 5008)
    assert ids(index.search(index.query("A"))) == [3, 5]  # a tie goes by id
    assert {r.doc_id: r.len for r in index.documents.collect()} == {2: 0, 3: 3, 4: 5002, 5: 3}
    empty = RankedIndex.build(spark.createDataFrame([], "id int, text string"), "id", "text", "t", limit=10)
    assert empty.search(empty.query("a b")).isEmpty() and empty.stats.first().n == 0
    evaluated = empty.evaluate(spark.createDataFrame(rows, "id int, text string, score int").drop("score"), empty.query("a"))
    assert {r.id: r.score for r in evaluated.collect()} == {1: None, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_levels_of_length(spark):
    df = spark.createDataFrame([(n,) for n in [*LEVELS, *range(0, 3000, 7)]], "n long")
    scoring.register_sql(spark)
    found = df.select("n", scoring.quantised_length(F.col("n")).alias("q"), scoring.fieldnorm_length(scoring.fieldnorm(F.col("n"))).alias("back"), F.expr("bm25_qlen(n)").alias("sql"), F.expr("bm25_fieldnorm(n)").alias("f"), scoring.fieldnorm(F.col("n")).alias("g"))
    rows = found.collect()
    assert all(r.q == r.back == r.sql and r.f == r.g for r in rows)
    assert {r.n: r.q for r in rows if r.n in LEVELS} == LEVELS
    levels = spark.range(256).select(scoring.fieldnorm(scoring.fieldnorm_length(F.col("id"))).alias("f"), "id")
    assert levels.where("f <> id").isEmpty()


class Model:
    """Brute force: a dictionary of documents with the statistics of those sealed."""

    def __init__(self, documents):
        self.sealed, self.live = dict(documents), dict(documents)

    def search(self, terms, k):
        n, total = len(self.sealed), sum(map(len, self.sealed.values()))
        out = []
        for i, words in self.live.items():
            score, length = 0.0, self.quantised(len(words))
            for t in set(terms):
                df, tf = sum(t in w for w in self.sealed.values()), words.count(t)
                if df and tf:
                    score += math.log((n + 1) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / n)))
            if score > 0:
                out.append((round(-score, 6), i))
        return [i for _, i in sorted(out)[:k]]

    @staticmethod
    def quantised(n):
        if n < 40:
            return n
        shift = (n - 24).bit_length() - 4
        return 24 + ((n - 24) >> shift << shift)


@pytest.mark.parametrize("stored", [False, True])
def test_changes_equal_brute_force(spark, stored):
    rng, vocabulary = random.Random(3), [f"t{i}" for i in range(60)]
    make = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(1, 70))]
    frame = lambda docs: spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id long, text string")
    documents = {i: make() for i in range(150)}
    path = f"{work_folder(spark)}/fuzz" if stored else None
    index, model = RankedIndex.build(frame(documents), "id", "text", "fuzz", limit=200, path=path), Model(documents)

    def compare():
        terms = rng.sample([*vocabulary, "new"], 4)
        assert ids(index.search(index.query_terms(terms), 20)) == model.search(terms, 20)

    compare()
    more = {i: [*make(), "new"] for i in range(200, 230)}
    index.insert(frame(more))
    model.live |= more
    compare()
    assert [r.term for r in index.new_terms().collect()] == ["new"]
    gone = rng.sample(sorted(model.live), 40)
    index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    for i in gone:
        del model.live[i]
    compare()
    back = {gone[0]: make(), gone[1]: make()}  # deleted and inserted again
    index.insert(frame(back))
    model.live |= back
    compare()
    if stored:
        index = RankedIndex.load(spark, path)
        compare()
    index.maintain()
    model.sealed = dict(model.live)
    compare()
    before = {tuple(r) for r in index.describe().collect()}
    index.maintain()
    assert {tuple(r) for r in index.describe().collect()} == before
    if stored:
        assert len(index.free_old_epochs()) == 2
        index = RankedIndex.load(spark, path)
        index.rebuild(frame(documents), k1=2.0)
        assert index.documents.count() == 150 and RankedIndex.load(spark, path).options.k1 == 2.0
        with pytest.raises(ValueError, match="already holds"):
            RankedIndex.build(frame(documents), "id", "text", "fuzz", path=path)


def test_two_writers(spark, passages):
    path = f"{work_folder(spark)}/writers"
    one = build(passages, path=path)
    other = RankedIndex.load(spark, path)
    one.alter(limit=5)
    with pytest.raises(RuntimeError, match="another writer"):
        other.alter(limit=6)
    with pytest.raises(ValueError, match="not an index"):
        RankedIndex.load(spark, path + "-none")


def test_batch_equals_single_searches(spark, passages):
    index = RankedIndex.build(passages.withColumn("text", F.array_join("lexemes", " ")), "id", "text", "full", limit=100)
    texts = {1: "search rank", 2: "postgresql postgresql", 3: "nothing", 4: None, 5: ""}
    found = index.search_batch(spark.createDataFrame(list(texts.items()), "query_id int, text string"), 4).collect()
    for q, text in texts.items():
        single = [tuple(r) for r in index.search(index.query(text), 4).collect()]
        assert [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == single


def test_vectors_in_all_forms(spark):
    text = "b:3C,7 'a b':1 'it''s':2A,3 1.5:4 b:9 bare"
    df = spark.createDataFrame([(text,), ("a:1 b:2,3",), ("",), (None,)], "e string").select(vectors.positions_vector(F.col("e")).alias("v"))
    found = [None if r.v is None else {(x.term, x.tf) for x in r.v} for r in df.collect()]
    assert found == [{("b", 3), ("a b", 1), ("it's", 2), ("1.5", 1), ("bare", 0)}, {("a", 1), ("b", 2)}, set(), None]
    v = spark.createDataFrame([([3, 1, 3, None],), ([],)], "i array<int>").select(vectors.ids_vector(F.col("i")).alias("v"))
    texts = v.select(vectors.vector_text(F.col("v")).alias("t"))
    assert [r.t for r in texts.collect()] == ["{1:1, 3:2}", "{}"]
    back = spark.createDataFrame([("{3:2, 1:1}", "{1:1, 3:2}"), ("{a:0}", "{}"), ("x", "{}")], "a string, b string")
    same = back.select(vectors.same_vector(vectors.text_vector(F.col("a")), vectors.text_vector(F.col("b"))).alias("s"))
    assert [r.s for r in same.collect()] == [True, None, None]


def test_analysers(spark):
    vectors.create_analyser("comma", lambda c: F.split(c, ","))
    try:
        with pytest.raises(ValueError):
            vectors.create_analyser("comma", lambda c: c)
        index = RankedIndex.build(spark.createDataFrame([(1, "a b,c")], "id int, text string"), "id", "text", "c", analysis="comma", limit=5)
        assert ids(index.search(index.query("a b"))) == [1]
    finally:
        vectors.drop_analyser("comma")
    with pytest.raises(ValueError, match="no analyser"):
        vectors.analyser("comma")


def test_pruned_search_finds_the_same(spark):
    rng, vocabulary = random.Random(9), [f"t{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary[: 1 + rng.randrange(12)]) for _ in range(rng.randrange(1, 60)))) for i in range(3000)]
    docs += [(5000, "t11 t11 t11 t11"), (5001, "t10 t10 t10")]
    docs += [(10_000 + i, "hot " + "t1 " * (i // 50)) for i in range(2000)]  # the best ones lie together
    df = spark.createDataFrame(docs, "id long, text string")
    index = RankedIndex.build(df, "id", "text", "p", limit=15, path=f"{work_folder(spark)}/pruned")
    index.insert(spark.createDataFrame([(9000, "t11 t11 t3"), (9001, "t1")], "id long, text string"))
    index.delete(spark.createDataFrame([(5000,), (docs[7][0],)], "id long"))
    for terms in (["t11"], ["hot"], ["hot", "t11"], ["t0", "t11"], ["t3", "t7", "t10", "none"], ["none"], []):
        query = index.query_terms(terms)
        assert index.search(query, prune=True).collect() == index.search(query).collect()
    assert index._hits(("hot",)).count() == 2000 and index._hits(("hot",), 15).count() == 128


def test_lookups_and_sql(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "b b c", "y"), (3, None, "z")], "id long, text string, doc_name string")
    index = RankedIndex.build(df, "id", "text", "look", limit=5, path=f"{work_folder(spark)}/look")
    assert [(r.term, r.df) for r in index.lookup(["b", "zz", "b"]).collect()] == [("b", 2)]
    assert sorted(tuple(r) for r in index.term_postings("b").collect()) == [(1, 1, 2), (2, 2, 3)]
    found = index.search(index.query("b"))
    assert {(r.doc_id, r.doc_name) for r in index.fetch(found, df.where("id <> 1"), "doc_name").collect()} == {(2, "y")}
    name = index.register("look")
    assert [(r.doc_id, r.score) for r in spark.sql(f"SELECT * FROM {name}('B b', 5) ORDER BY rank").collect()] == [tuple(r) for r in found.collect()]
    lateral = spark.sql(f"SELECT q, doc_id FROM VALUES ('a'), ('c') AS t(q), LATERAL {name}(q, 1)").collect()
    assert {tuple(r) for r in lateral} == {("a", 1), ("c", 2)}
