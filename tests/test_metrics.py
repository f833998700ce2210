from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pothi.functions import metrics, vectors
from pothi.functions.metrics import _lcs

CASES = [
    ("RAM stores temporary data", "ram stores temporary data quickly", 0, 0.888889, 0.888889),
    ("data temporary stores ram", "ram stores temporary data", 0, 1.0, 0.25),
    ("a a b", "a b b", 0, 0.666667, 0.666667),
    ("x", "y", 0, 0, 0),
    ("The answer is: শাপলা।", "শাপলা", 1, 1.0, 1.0),
    ("২০", "20", 1, 1.0, 1.0),
    ("Based on the passage X is Y", "x is y", 0, 0, 0),
    ("...", "!!!", 1, 0, 0),
    ("", "anything", 0, 0, 0),
    (None, "anything", 0, 0, 0),
]


def test_answer_metrics(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, *_) in enumerate(CASES)], "i int, p string, g string")
    p, g = F.col("p"), F.col("g")
    got = df.select("i", metrics.exact_match(p, g), metrics.token_f1(p, g), metrics.rouge_l(p, g)).orderBy("i").collect()
    for row, case in zip(got, CASES, strict=True):
        assert [round(x, 6) for x in row[1:]] == [round(float(x), 6) for x in case[2:]], case


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_lcs_against_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert _lcs(a, b) == table[-1][-1] <= sum((Counter(a) & Counter(b)).values())


@pytest.mark.parametrize(("ids", "gold", "at1", "at3"), [([7, 3, 9], 9, 0, 1), ([], 9, 0, 0), ([9, 9], 9, 1, 1), ([7], None, 0, 0)])
def test_recall(spark, ids, gold, at1, at3):
    df = spark.createDataFrame([(ids, gold)], "ids array<long>, gold long")
    row = df.select(metrics.recall_at(F.col("ids"), F.col("gold"), 1), metrics.recall_at(F.col("ids"), F.col("gold"), 3)).first()
    assert tuple(row) == (at1, at3)


def test_recall_of_named_ids(spark):
    df = spark.createDataFrame([(["chunk_000009"], 9), (["9"], 9), (["8"], 9)], "ids array<string>, gold long")
    assert [r[0] for r in df.select(metrics.recall_at_named(F.col("ids"), F.col("gold"), 1)).collect()] == [1, 1, 0]


def test_grounding_flag(spark):
    df = spark.createDataFrame([(0.39, 0.5, "x"), (0.45, 0.5, "x"), (0.0, 0.5, "")], "o double, f double, a string")
    flags = [metrics.grounding_flag(F.col("o"), F.col("f"), F.col("a"), g) for g in (True, False)]
    assert [tuple(r) for r in df.select(*flags).collect()] == [(1, 1), (0, 0), (0, 1)]


def test_spread(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 0.25)], "x double")
    row = df.agg(metrics.standard_deviation(F.col("x")), metrics.ci95(F.col("x"))).first()
    assert [round(v, 6) for v in row] == [0.426956, 0.418417]
    assert tuple(df.limit(1).agg(metrics.standard_deviation(F.col("x")), metrics.ci95(F.col("x"))).first()) == (0, 0)
    assert df.limit(0).agg(metrics.mean(F.col("x"))).first()[0] == 0


def test_coverage(spark):
    df = spark.createDataFrame([("a b c c", ["A x", "c"]), ("", ["a"]), ("a", None)], "p string, s array<string>")
    assert [round(r[0], 4) for r in df.select(metrics.coverage(F.col("p"), F.col("s"))).collect()] == [0.6667, 0, 0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    row = df.select(vectors.dot(a, b), vectors.cosine(a, b), vectors.similarity_of_distance(F.lit(1.7))).first()
    assert row[0] == 24 and abs(row[1] - 0.96) < 1e-9 and row[2] == 0
