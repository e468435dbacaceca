import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from sievora.llm.bpe import Bpe, read_ranks, token_ids, tokenizer


def reference():
    import tiktoken

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_known_ids_null_and_empty(spark):
    rows = [(1, "Hello world", 0), (2, None, 0), (3, "", 0), (4, "a" * 300_000, 0), (4, "Hello world", 0)]
    found = sorted((r.doc_id, len(r.ids), list(r.ids[:2])) for r in token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect())
    assert found[:3] == [(1, 2, [15496, 995]), (2, 0, []), (3, 0, [])] and found[3][:2] == (4, 2)
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = token_ids(spark.createDataFrame([(1, "Bücherei")], "doc_id long, text string"), path).first().ids
    assert other == tokenizer(path).encode("Bücherei")


def test_speculation_that_fails_is_put_right():
    # the longest first token is "abc", but the merges make "ab" + "cd"
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"cd": 4, b"ab": 5, b"abc": 6}
    bpe = Bpe(ranks, ".+")
    assert bpe.encode("abcd") == [5, 4] and (bpe.tried, bpe.failed) == (1, 1)


def test_equal_to_the_public_encoder_on_random_text():
    encoder, bpe, rng = reference(), tokenizer(), random.Random(1)
    for alphabet in ("abcdefghij étß語-'  \n12ABC", "the and ing tion er\t ", "🙂‍👍 ー漢字かな한글  　"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
        found = bpe.encode_batch(texts).to_pylist()
        assert found == [encoder.encode_ordinary(t) for t in texts]
    assert 0 < bpe.failed < bpe.tried


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert tokenizer().encode(text) == reference_cached().encode_ordinary(text)


_cache = []


def reference_cached():
    if not _cache:
        _cache.append(reference())
    return _cache[0]
