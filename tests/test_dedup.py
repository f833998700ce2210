import math
from collections import Counter

import pytest

from pothi.operators.dedup import greedy_dedup, greedy_kept, similar_pairs, word_vectors


def test_greedy_is_not_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert sorted(r["id"] for r in greedy_kept(nodes, edges).collect()) == [1, 3, 4]


def cosine(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    dot = sum(a[w] * b[w] for w in a)
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_against_brute_force(spark, threshold):
    import random

    rng = random.Random(4)
    texts = []
    for _ in range(60):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            words[rng.randrange(len(words))] = rng.choice("abcdefghij")
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice("abcdefghij") for _ in range(8)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(i, j) for j in range(60) for i in range(j) if cosine(texts[i], texts[j]) >= threshold - 1e-12}
    assert {(r["a"], r["b"]) for r in similar_pairs(word_vectors(df, "id", "text"), threshold).collect()} == want
    kept = []
    for j in range(60):
        if not any((i, j) in want for i in kept):
            kept.append(j)
    assert sorted(r["id"] for r in greedy_dedup(df, "id", "text", threshold).where("kept").collect()) == kept


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "b a"), (4, "b a"), (None, "a")]
    got = greedy_dedup(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {r["id"]: r["kept"] for r in got} == {1: True, 2: True, 3: True, 4: False}
    assert greedy_dedup(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0
