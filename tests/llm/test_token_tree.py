import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pothi.llm.token_tree import decode_tree, encode_corpus, encode_tree, encoding, token_counts

TEXTS = [
    "It's 12ab, isn't it?\n\n  two  blanks", "ক্ষুদ্র কপিকল 'll 're", "日本語テキスト" * 30, "x" * 3000, " " * 999 + "a", "\n" * 500 + " b",
    "<|endoftext|> is text", "'s" * 400, "á" * 300, "😀👍🏽" * 80, "1234567890" * 50, "\t\r\n 　  x",
]


@pytest.mark.parametrize("leaf", [1, 7, 64, 4096])
def test_equal_to_plain_encoding(leaf):
    enc = encoding()
    for text in TEXTS:
        assert encode_tree(text, enc, leaf) == enc.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 's't'11 \n\tকষ্ি।,.-é😀", max_size=60), st.integers(1, 12))
def test_any_cut(text, leaf):
    enc = encoding()
    ids = encode_tree(text, enc, leaf)
    assert ids == enc.encode_ordinary(text)
    assert decode_tree(ids, enc) == text


def test_long_round_trip():
    rng = random.Random(3)
    text = "".join(rng.choice([" word", "ড়", "\n", "'s", " 42", "।", "  "]) for _ in range(60_000))
    enc = encoding()
    ids = encode_tree(text, enc)
    assert ids == enc.encode_ordinary(text) and decode_tree(ids, enc) == text


def test_corpus(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, " ", "k"), (4, "ab " * 5000, "k"), (5, "ab", "k"), (5, "ab", "k"), (None, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()]
    enc = encoding()
    assert len(got) == 7 and dict(got)[1] == [] and dict(got)[2] == [] and dict(got)[4] == enc.encode_ordinary("ab " * 5000)
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df).collect()}[3] == 1
    assert encode_corpus(df.limit(0)).count() == 0
