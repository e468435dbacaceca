import random

from sievora.llm.item_search import WuManber, documents_with_items, item_blocks


def test_every_run_and_every_item_is_found():
    item = [f"w{i}" for i in range(15)]
    search = WuManber([(1, item), (2, item[:12]), (3, item[3:])])
    for before in range(30):
        for start in range(4):
            text = ["x"] * before + item[start : start + 12] + ["y"]
            assert search.found(text) == {1} | ({2} if start == 0 else set()) | ({3} if start == 3 else set())
    assert search.found(item[:11] + ["x"] + item[11:]) == set()


def test_signs_and_breaks_between_words_do_not_matter(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    documents = spark.createDataFrame([(1, "So: " + words.upper().replace(" ", ",\n-- ")), (2, words[4:]), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, words + "!"), (8, "one two"), (9, None)], "item_id int, item_text string")
    assert [tuple(r) for r in documents_with_items(documents, items).collect()] == [(1, 7)]


def test_many_blocks_equal_brute_force(spark):
    rng, vocabulary = random.Random(2), [f"v{i}" for i in range(30)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for i in range(40)}
    items[40] = items[3] + items[4]  # some items share runs
    documents = {}
    for d in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        for i in rng.sample(sorted(items), 3):
            start = rng.randrange(len(items[i]))
            text += items[i][start : start + rng.randrange(8, 16)]
        documents[d] = text
    blocks = list(item_blocks(items.items(), 12, 50))
    assert len(blocks) > 10 and all(sum(len(w) for _, w in b) <= 50 for b in blocks)
    runs = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    true = {(d, i) for d, text in documents.items() for i, item in items.items() if runs(text) & runs(item)}
    frame = lambda x, schema: spark.createDataFrame([(k, " ".join(v), 0) for k, v in x.items()], schema)
    found = documents_with_items(frame(documents, "doc_id long, text string, item_id int"), frame(items, "item_id int, item_text string, doc_id int"), most=50)
    assert {tuple(r) for r in found.collect()} == true and len(true) > 50


def test_empty_tables_repeats_and_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    documents = spark.createDataFrame([(1, "x " * 100_000 + item), (1, item), (2, ""), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (1, item), (2, item.upper()), (3, "")], "item_id int, item_text string")
    assert sorted(tuple(r) for r in documents_with_items(documents, items).collect()) == [(1, 1), (1, 2)]
    assert documents_with_items(documents, items.limit(0)).isEmpty() and documents_with_items(documents.limit(0), items).isEmpty()
