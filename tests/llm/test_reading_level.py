import os
import random

import numpy as np
import pytest

from sievora.llm.reading_level import BANDS, MISSING, Vocabularies, prose, reading_bands

EASY = "The cat sees the red ball at home. "
HARD = "Notwithstanding stochastic indeterminacy, axiomatic characterisation problematises inference. "


def test_code_logs_and_signs_are_no_prose():
    assert prose('fn x(y: u16) -> Z { y << 3 }\n{"a": [1, 2]}\n2024-01-01 10:00:00 INFO started the search\n12 13 14\n#-=~ ~~') == []
    assert prose(None) == prose("") == prose(" \n ") == []
    assert len(prose("one " * 60)) == 3
    assert prose("Der H\u00adund") == prose("Der Hund")
    assert prose("<|end|> We see <b>it</b>.") == [["we", "see", "it"]]


def test_coverage_is_the_smallest_top_of_the_list():
    rng, words = random.Random(1), [f"w{i}" for i in range(50)]
    ranks = {w: tuple(rng.choice([MISSING, rng.randrange(1, 40)]) for _ in BANDS) for w in words[:40]}
    stretches = [[rng.choice(words) for _ in range(rng.randrange(1, 26))] for _ in range(200)]
    found = Vocabularies(ranks).coverage(stretches)
    for stretch, row in zip(stretches, found.tolist()):
        for band, size in enumerate(row):
            covered = lambda top: sum(ranks.get(w, (MISSING,) * 4)[band] <= top for w in stretch) >= 0.75 * len(stretch)
            assert covered(size) and (size == 0 or not covered(size - 1))
    assert list(Vocabularies({}).nearest([["a"]])) == [15] and len(Vocabularies({}).nearest([])) == 0


def test_the_band_of_most_of_the_prose(spark):
    code = "\nkey = 1\n{ x }\n"
    rows = [(1, EASY * 6), (2, HARD * 6), (3, EASY * 5 + code * 20 + HARD), (4, HARD * 5 + EASY * 2), (5, EASY), (6, code * 30), (7, None), (8, (HARD * 6).upper().replace(" ", "  \n")), (9, ""), (10, EASY * 20_000)]
    documents = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, band int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 4, "x"), (2, None, "x"), (99, 2, "x"), (1, 9, "x")], "doc_id long, band int, text string")
    assert {r.doc_id: r.band for r in reading_bands(documents, labels).collect()} == {1: 1, 2: 4, 3: 1, 4: 4, 8: 4, 10: 1}
    assert {r.band for r in reading_bands(documents, labels.limit(0)).collect()} == {1}
    assert reading_bands(documents.limit(0), labels).isEmpty()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_labels(spark):
    """Learned from four fifths of the labels, the rest agree as far as they agree among themselves."""
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "level_labels"))
    train = labels.where("doc_id % 5 <> 0")
    bands = {r.doc_id: r.band for r in reading_bands(documents, train).collect()}
    held = [(r.doc_id, r.band) for r in labels.where("doc_id % 5 = 0 AND band IS NOT NULL").collect() if r.doc_id in bands]
    agree = np.mean([bands[d] == b for d, b in held])
    print("held-out agreement", agree, "of", len(held))
    assert agree > 0.92
