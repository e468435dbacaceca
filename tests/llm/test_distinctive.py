import math

import numpy as np
import pytest

from sievora.llm.distinctive import adjusted, distinctive_terms, log_falling, log_gamma, log_upper_tail, most_distinctive

PASSAGES, TOKENS = "id int, embedding string, index_id int, loaded_at int", "index_id int, epoch int, token_key string, number_of_documents long"
JUMPS = "index_id int, epoch int, number_of_documents long, sum_of_document_lengths long, k1 double, b double"


def tail(k, n, m, t):
    """In whole numbers."""
    return sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(max(k, 0), min(n, m) + 1)), math.comb(t, n)


def test_log_gamma_and_its_differences():
    x = np.array([0, 1, 5, 63, 64, 65, 1000, 10**6])
    assert np.allclose(log_gamma(x), [math.lgamma(i + 1) for i in x], rtol=1e-14)
    for a, k in ((10, 3), (100, 60), (10**12, 50), (10**12, 0), (200, 200), (10**6, 10**5)):
        exact = math.fsum(math.log(a - i) for i in range(k))
        assert log_falling(np.array([a]), np.array([k]))[0] == pytest.approx(exact, rel=1e-12, abs=1e-9)


def test_tail_equals_whole_numbers():
    rng = np.random.default_rng(1)
    cases = [(0, 5, 3, 10), (3, 5, 3, 10), (4, 5, 3, 10), (1, 1, 1, 1), (5, 10, 10, 10), (40, 60, 100, 200), (2, 30, 5, 10**9), (1, 500, 300, 100_000)]
    for _ in range(300):
        t = int(rng.integers(1, 400))
        cases.append((int(rng.integers(0, 20)), int(rng.integers(0, t + 1)), int(rng.integers(0, t + 1)), t))
    found = log_upper_tail(*(np.array(x) for x in zip(*cases)))
    for case, p in zip(cases, found):
        over, all_ = tail(*case)
        if over == 0:
            assert p == -np.inf
        else:
            assert p == pytest.approx(math.log(over) - math.log(all_), rel=1e-9, abs=1e-9)


def test_adjustment_within_groups():
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.02, 0.9, 1e-300, 0.2]
    groups = [0, 0, 0, 0, 1, 1, 1, 2, 2]
    expected = []
    for g in range(3):
        own = [x for x, y in zip(p, groups) if y == g]
        m = len(own)
        ranked = sorted(own)
        for x in own:
            expected.append(min(1.0, *(ranked[j] * m / (j + 1) for j in range(ranked.index(x), m))))
    assert np.allclose(np.exp(adjusted(np.log(p), np.array(groups))), expected)
    assert len(adjusted(np.array([]), np.array([]))) == 0


def test_epoch_ties_and_unlisted_terms(spark):
    rows = [(1, "b:1 a:2 new:3", 1, 1), (2, "new:1", 1, 1), (3, None, 1, 1), (4, "", 1, 1), (5, "a:1", 9, 1), (6, "a:1", 1, 1), (6, "c:1 b:2", 1, 2), (7, "a:1 bare", 1, 1)]
    passages = spark.createDataFrame(rows, PASSAGES)
    tokens = spark.createDataFrame([(1, 2, "a", 3), (1, 2, "b", 3), (1, 2, "b", 3), (1, 2, "c", 1), (1, 2, "bare", None), (1, 1, "new", 1)], TOKENS)
    jumps = spark.createDataFrame([(1, 1, 5, 9, 1.2, 0.75), (1, 2, 10, 30, 1.2, 0.75), (1, 2, 10, 30, 1.2, 0.75)], JUMPS)
    found = distinctive_terms(passages, tokens, jumps)
    assert {tuple(r) for r in most_distinctive(found).collect()} == {(1, "a"), (6, "c"), (7, "a")}
    rows = {(r.id, r.element_key): r for r in found.collect()}
    a = rows[1, "a"]
    assert a.contribution == pytest.approx(1.145132, abs=1e-6)  # ln(11 / 3.5), tf 1, length 3 = avgdl
    over, all_ = tail(1, 3, 3, 30)
    assert a.p_value == pytest.approx(over / all_) and a.score == pytest.approx(-math.log10(over / all_), abs=1e-6)
    # c is rarer, and adjusted over two terms
    p = [tail(1, 2, m, 30) for m in (1, 3)]
    assert rows[6, "c"].score == pytest.approx(-math.log10(min(p[0][0] / p[0][1] * 2, p[1][0] / p[1][1])), abs=1e-6)
    assert len(rows) == 5
    shuffled = distinctive_terms(passages, tokens, jumps, most_broadcast=0)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, found.collect()))
    assert most_distinctive(distinctive_terms(passages.limit(0), tokens.limit(0), jumps.limit(0))).isEmpty()


def test_common_terms_count_little(spark):
    passages = spark.createDataFrame([(1, "the:1,2,3 rare:4,5 one:6", 1, 1)], PASSAGES)
    tokens = spark.createDataFrame([(1, 1, "the", 90_000), (1, 1, "rare", 10), (1, 1, "one", 1000)], TOKENS)
    jumps = spark.createDataFrame([(1, 1, 100_000, 1_000_000, 1.2, 0.75)], JUMPS)
    found = {r.element_key: r.score for r in distinctive_terms(passages, tokens, jumps).collect()}
    assert found["rare"] > found["one"] > 0 and found["rare"] > found["the"]
