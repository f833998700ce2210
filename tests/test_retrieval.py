import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pothi.operators import dense, fusion, lexical, topk
from pothi.plugins import HashingEmbedder, OverlapScorer


def ranking(spark, docs, queries, k):
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "id long, text string")
    index = lexical.build_index(d, "id", form=None)
    rows = lexical.bm25_top(index, q, "id", "text", k, expand=False, form=None).orderBy("query_id", "rank").collect()
    return [[(r["chunk_id"], r["score"]) for r in rows if r["query_id"] == i] for i in range(len(queries))]


def test_bm25_fixtures(spark):
    docs = ["cell wall plant", "cell nucleus cell", "plant food light light", "sun"]
    got = ranking(spark, docs, ["light light", "plant light", "cell", "zzz"], 2)
    assert [[i for i, _ in r] for r in got] == [[2, 0], [2, 0], [0, 1], [0, 1]]
    assert round(got[0][0][1], 6) == 2.112244 and round(got[1][0][1], 6) == 1.056122


def test_bm25_floor_of_negative_idf(spark):
    got = ranking(spark, ["a b", "a c", "a d", "b e"], ["a"], 4)[0]
    assert [round(s, 6) for _, s in got] == [0.08473, 0.08473, 0.08473, 0]


def test_bm25_against_formula(spark):
    rng = np.random.default_rng(1)
    docs = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 12))) for _ in range(40)]
    queries = [" ".join(rng.choice(list("abcdefghz"), 4)) for _ in range(6)]
    bags, mean = [Counter(d.split()) for d in docs], np.mean([len(d.split()) for d in docs])
    df = Counter(w for b in bags for w in b)
    raw = {w: math.log(40 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(raw.values())) for w, x in raw.items()}
    for q, got in zip(queries, ranking(spark, docs, queries, 5), strict=True):
        score = [sum(idf.get(w, 0) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in q.split()) for b in bags]
        order = sorted(range(40), key=lambda i: (-round(score[i], 6), i))[:5]
        assert [i for i, _ in got] == order


@pytest.mark.parametrize("block", [1, 10, 500_000])
def test_blocks_of_queries_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", max(block, 30))
    monkeypatch.setattr(topk, "SCORES", block)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    chance = 1 / np.arange(1, 301)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=chance / chance.sum()))
    docs, queries = [draw(rng.integers(3, 25)) for _ in range(120)], [draw(5) for _ in range(25)]
    bags, mean = [Counter(d.split()) for d in docs], np.mean([len(d.split()) for d in docs])
    df = Counter(w for b in bags for w in b)
    raw = {w: math.log(120 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * np.mean(list(raw.values()))
    assert floor > 0
    for q, got in zip(queries, ranking(spark, docs, queries, 6), strict=True):
        score = [
            sum((raw[w] if raw.get(w, 0) >= 0 else floor) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in q.split() if w in raw)
            for b in bags
        ]
        order = sorted(range(120), key=lambda i: (-round(score[i], 6), i))[:6]
        assert [i for i, _ in got] == order
        assert all(abs(s - score[i]) < 1e-9 for i, s in got)


def test_dense_and_inverted_file(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 800)] + 0.3 * rng.normal(size=(800, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    asked = rows.where("id % 20 = 0")
    exact = dense.dense_top(asked, rows, 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in exact.where("rank = 2").collect():
        s = np.round(unit[r["query_id"]].astype(float) @ unit.T.astype(float), 6)
        assert r["chunk_id"] == sorted(range(800), key=lambda i: (-s[i], i))[1]
    assert exact.count() == 40 * 5
    assert dense.retrieval_recall(dense.inverted_file_top(asked, rows, 5, cells=16, probes=5), exact) >= 0.9


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 200)
    monkeypatch.setattr(topk, "SCORES", 40)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 4)))], "id long, vector array<float>")
    got = dense.dense_top(rows.where("id < 10"), rows, 3)
    assert got.count() == 30 and got.where("rank = 1 and query_id = chunk_id").count() == 10
    every = dense.inverted_file_top(rows.where("id < 10"), rows, 3, cells=4, probes=4)
    assert sorted(map(tuple, every.select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, got.select("query_id", "chunk_id", "rank").collect()))


def test_running_best_against_sorting():
    rng = np.random.default_rng(4)
    scores, ids = np.round(rng.random((7, 60)), 1), rng.permutation(60)
    best = topk.Best(np.arange(7), 5)
    for at in range(0, 60, 9):
        best.offer(0, ids[at : at + 9], scores[:, at : at + 9])
    for q in range(7):
        assert best.ids[q].tolist() == [i for _, i in sorted(zip(-scores[q], ids, strict=True))[:5]]


def test_probes_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 8)))], "id long, vector array<float>")
    asked = rows.where("id % 20 = 0")
    assert dense.cells_of(2000) == 44 and dense.cells_of(10**12) == dense.MOST_CELLS
    assert dense.retrieval_recall(dense.inverted_file_top(asked, rows, 10), dense.dense_top(asked, rows, 10)) >= 0.9


def test_dense_without_rows(spark):
    empty = spark.createDataFrame([], "id long, vector array<float>")
    assert dense.dense_top(empty, empty).count() == 0
    assert dense.inverted_file_top(empty, empty).count() == 0


def test_weighted_fusion(spark):
    d = spark.createDataFrame([(1, c, r) for r, c in enumerate((10, 20, 30), 1)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, c, r) for r, c in enumerate((30, 40), 1)], "query_id long, chunk_id long, rank int")
    got = fusion.reciprocal_rank_fusion(d, b).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 8)) for r in got] == [(30, 0.01602914), (10, 0.01147541), (20, 0.01129032), (40, 0.00483871)]


def test_fused_scores(spark):
    rr = spark.createDataFrame([(1, 1, 2.0), (1, 2, -5.0)], "query_id long, chunk_id long, rerank_score double")
    one = spark.createDataFrame([(1, 1, 0.8)], "query_id long, chunk_id long, score double")
    got = fusion.fuse_scores(rr, one, one.withColumn("score", F.lit(0.5))).orderBy("chunk_id").collect()
    assert [round(r["score"], 6) for r in got] == [0.639344, 0.134471]


def test_mmr_fixture(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.88, [0.96, 0.28]), (1, 3, 0.5, [0.0, 1.0]), (1, 4, 0.7, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, vector array<float>")
    assert [r["chunk_id"] for r in fusion.maximal_marginal_relevance(df).orderBy("rank").collect()] == [1, 3, 2, 4]


def test_roll_up(spark):
    r = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcd", 1)], "query_id long, chunk_id string, rank int")
    p = spark.createDataFrame([("a", "p2"), ("b", "p1"), ("c", "p2"), ("d", "p3")], "chunk_id string, parent_id string")
    assert [x["parent_id"] for x in fusion.roll_up(r, p).orderBy("rank").collect()] == ["p2", "p1", "p3"]


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1, "red cell", "blue sky"), (1, 2, "red cell", "a red cell"), (1, 3, "red cell", None)], "query_id long, chunk_id long, question string, text string")
    assert [r["chunk_id"] for r in fusion.rerank(df, OverlapScorer(), 2).orderBy("rank").collect()] == [2, 1]


def test_embedding_and_upsert(spark):
    embed = dense.embed_column(HashingEmbedder(32), "passage: ")
    stored = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string").withColumn("v", embed("text"))
    again = spark.createDataFrame([(2, "c"), (3, "d")], "id long, text string").withColumn("v", embed("text"))
    got = {r["id"]: r["text"] for r in dense.upsert(stored, again, "id").collect()}
    assert got == {1: "a b", 2: "c", 3: "d"}
    assert abs(sum(x * x for x in stored.first()["v"]) - 1) < 1e-6
