"""Fusing, reranking and diversifying rankings, and rolling children up to parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pothi.functions.metrics import squashed
from pothi.plugins import PairScorer

#: Weights of the fusions.
RRF_K, DENSE_SHARE, LEXICAL_SHARE = 60, 0.7, 0.3
RERANK_SHARE, DENSE_PART, LEXICAL_PART = 0.5, 0.3, 0.2


def rerank_rows(df: DataFrame, by: str = "score", k: int | None = None) -> DataFrame:
    """``df`` ranked by score within its query, equal scores (at six decimals) by id."""
    order = Window.partitionBy("query_id").orderBy(F.round(by, 6).desc(), "chunk_id")
    out = df.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = 10, pool: int = 50) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank): weighted reciprocal ranks of both rankings, missing ones add nothing."""
    d = dense.where(F.col("rank") <= pool).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("dense_rank"))
    b = lexical.where(F.col("rank") <= pool).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("lexical_rank"))
    score = F.coalesce(DENSE_SHARE / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(LEXICAL_SHARE / (RRF_K + F.col("lexical_rank")), F.lit(0.0))
    fused = d.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse_scores(reranked: DataFrame, dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Reranked rows with the fused score of reranker, clamped dense and normalised lexical scores; missing ones count 0."""
    keys = ["query_id", "chunk_id"]
    d = dense.groupBy(*keys).agg(F.max("score").alias("dense_score"))
    b = lexical.groupBy(*keys).agg(F.max("score").alias("lexical_score"))
    score = (
        RERANK_SHARE * squashed(F.col("rerank_score"))
        + DENSE_PART * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("dense_score", F.lit(0.0))))
        + LEXICAL_PART * F.coalesce(F.col("lexical_score"), F.lit(0.0))
    )
    return reranked.join(d, keys, "left").join(b, keys, "left").select(*keys, score.alias("score"))


def rerank(candidates: DataFrame, scorer: PairScorer, top: int = 15, characters: int = 512) -> DataFrame:
    """The ``top`` candidates (query_id, chunk_id, question, text) by a pair scorer, with ``rerank_score`` and rank.

    The scorer sees the first ``characters`` of a passage, which is its input
    size; passages themselves stay whole.
    """

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield pd.Series(scorer.score(questions.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    scored = candidates.withColumn("rerank_score", score(F.col("question"), F.substring("text", 1, characters)))
    return rerank_rows(scored, "rerank_score", top)


def _mmr(ids: np.ndarray, relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Positions in the order of choice; values equal at nine decimals go to the earlier candidate."""
    length = np.linalg.norm(vectors, axis=1)
    cosine = vectors @ vectors.T / (np.outer(length, length) + 1e-9)
    left, chosen = list(range(len(ids))), []
    while left and len(chosen) < k:
        value = relevance if not chosen else weight * relevance - (1 - weight) * cosine[:, chosen].max(axis=1)
        best = max(left, key=lambda i: (round(float(value[i]), 9), -i))
        chosen.append(best)
        left.remove(best)
    return chosen


def maximal_marginal_relevance(candidates: DataFrame, k: int = 10, weight: float = 0.6, pool: int = 15) -> DataFrame:
    """Rows (query_id, chunk_id, relevance, rank) chosen from (query_id, chunk_id, score, vector).

    The ``pool`` best candidates of a query are diversified, so a group never
    has more rows than that.
    """
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "chunk_id")
    best = candidates.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= pool)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", kind="stable").reset_index(drop=True)
        vectors = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
        chosen = _mmr(pdf["chunk_id"].to_numpy(), pdf["score"].to_numpy(float), vectors, k, weight)
        picked = pdf.iloc[chosen]
        return pd.DataFrame({"query_id": picked["query_id"], "chunk_id": picked["chunk_id"], "relevance": picked["score"], "rank": np.arange(1, len(picked) + 1, dtype="int32")})

    return (
        best.select("query_id", "chunk_id", "score", "vector", "_place")
        .groupBy("query_id")
        .applyInPandas(choose, "query_id long, chunk_id long, relevance double, rank int")
    )


def roll_up(ranking: DataFrame, parents: DataFrame, k: int | None = None) -> DataFrame:
    """Rows (query_id, parent_id, rank): each parent at the place of its first child; ``parents`` has (chunk_id, parent_id)."""
    first = ranking.join(parents, "chunk_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("first"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "parent_id")))
    return (out if k is None else out.where(F.col("rank") <= k)).select("query_id", "parent_id", "rank")


def two_stage(reranked: DataFrame, dense: DataFrame, lexical: DataFrame, vectors: DataFrame | None = None, k: int = 10, weight: float = 0.6) -> DataFrame:
    """Final ranking of a reranking retriever: fused scores, diversified when vectors (chunk_id, vector) are given."""
    fused = fuse_scores(reranked, dense, lexical)
    if vectors is None:
        return rerank_rows(fused, k=k).select("query_id", "chunk_id", "score", "rank")
    return maximal_marginal_relevance(fused.join(vectors, "chunk_id"), k, weight).withColumnRenamed("relevance", "score")
