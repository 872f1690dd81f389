import random

import pytest

from promptloom.llm import bpecount

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["", "   ", "aaaa aaaaaaaaaa", "I'll don't 's 'LL", "<|startoftext|>hi<|endoftext|><|endoftext|> x", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ é é", "\x00\x1c\x85 a​b", "数字１２３ ⅷ²", "<|STARTOFTEXT|>", "👩‍👩‍👧", "z" * 5000, "word " * 3000]


def expected(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("abcé 'ßA1!\n") for _ in range(rnd.randint(0, 90))) for _ in range(500)]
    assert bpecount.Counter(bpecount.load(PATH)).count(texts) == expected(texts)


def test_query_over_nulls_and_repeats(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1), (2, TEXTS[2], 1)]
    got = bpecount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, limit=100).collect()
    want = expected([r[1] or "" for r in rows])
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()), n, n > 100) for r, n in zip(rows, want, strict=True))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9, 1, "x")], "doc_id long, text string, n_bytes long, n_tokens long, limit long, over_limit int, rows string")
    assert bpecount.token_counts(df.limit(0), PATH).count() == 0
    got = bpecount.token_counts(df, PATH).first()
    assert (got.doc_id, got.n_bytes, got.over_limit) == (1, 3, False) and got.n_tokens == expected(["a b"])[0]
    long = spark.createDataFrame([(1, "word " * 50_000), (1, "word " * 50_000)], "doc_id long, text string")
    assert {r.n_tokens for r in bpecount.token_counts(long, PATH).collect()} == {expected(["word " * 50_000])[0]}


def test_merges_in_rank_order():
    # a b c with ranks: bc before ab, so "abc" ends as a + bc
    model = {"size": 8, "keys": None, "inner": None, "last": None}
    import numpy as np

    keys = np.array([1 * 8 + 2, 2 * 8 + 3], np.int64)
    model |= {"keys": keys, "ranks": np.array([1, 0], np.int64), "made": np.array([4, 5], np.int64)}
    table = np.zeros(256, np.int64)
    table[[97, 98, 99]] = [1, 2, 3]
    model |= {"inner": table, "last": table}
    assert bpecount.merge_counts([b"abc", b"ab", b"aab", b"c"], model).tolist() == [2, 1, 2, 1]
