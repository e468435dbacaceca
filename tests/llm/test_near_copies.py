import random

import pytest

from sievora.llm.near_copies import close_sets, near_copies, near_groups, segments, size_classes

SCHEMA = "id int, passage string, loaded_at int"


def test_pairs_at_the_bound_and_copies(spark):
    shared = [f"w{i}" for i in range(35)]
    near = " ".join(shared + [f"a{i}" for i in range(8)])
    other = " ".join(shared + [f"b{i}" for i in range(7)])  # 35 of 50 words: exactly 0.7
    less = " ".join(shared + [f"c{i}" for i in range(8)])  # 35 of 51 with the first
    rows = [(1, near, 1), (2, other, 1), (3, less, 1), (4, near.upper().replace(" ", ", "), 1), (5, near, 1), (5, "short", 2), (6, None, 1), (7, " ".join(shared), 1)]
    rows += [(8, " ".join(near.split()[::-1]), 1), (None, near, 1)]
    found = sorted(tuple(r) for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(1, 2), (1, 8), (2, 3), (2, 4), (2, 8), (4, 8)]
    # 3 is near 2, which is near 1; 4 and 8 have the words of 1
    groups = near_groups(spark.createDataFrame(rows + [(20, " ".join(f"z{i}" for i in range(40)), 1)], SCHEMA))
    assert {r.id: r.class_id for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 1, 20: 20}
    assert near_copies(spark.createDataFrame([], SCHEMA)).isEmpty() and near_groups(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.mark.parametrize("shared,of,least", [(7, 10, 38), (8, 10, 5), (1, 2, 2)])
def test_no_pair_is_lost(spark, shared, of, least):
    rng, sets = random.Random(shared), []
    while len(sets) < 240:
        base = set(rng.sample(range(400), rng.randrange(least, least * 3)))
        for _ in range(6):  # edits up to and beyond the bound
            new = set(base)
            for _ in range(rng.randrange(0, max(2, len(base) * (of - shared) // of + 3))):
                new.discard(rng.choice(sorted(new))) if rng.random() < 0.5 and len(new) > least else new.add(rng.randrange(400))
            sets.append(new)
    rows = [(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)]
    found = {tuple(sorted(r)) for r in close_sets(spark.createDataFrame(rows, "id int, words array<string>"), least, shared, of).collect()}
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) * of >= len(sets[a] | sets[b]) * shared}
    assert found == true and len(true) > 100


def test_classes_cover_all_sizes_and_segments_suffice():
    classes = size_classes(38, 5000)
    assert classes[0][0] == 38 and classes[-1][1] >= 5000
    assert all(a[1] + 1 == b[0] for a, b in zip(classes, classes[1:]))
    for _, high in classes:
        assert 2 * segments(high) > 3 * 2 * high // 17


def test_very_long_texts_and_a_large_group_of_copies(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, long, 1), (2, long + " more", 1)] + [(i, " ".join(f"c{k}" for k in range(40)), 1) for i in range(3, 103)]
    assert [tuple(r) for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2)]
