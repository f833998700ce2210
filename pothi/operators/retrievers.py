"""Composed retrievers over stated questions: reranked in two stages, and from children to parents.

A retriever is a function of (questions, k) that gives rows (query_id, chunk_id,
score, rank); questions have (query_id, question).  The pieces compose, so a run
over configurations makes each ranking once, however many configurations read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pothi.functions.text import PASSAGE_PREFIX, QUERY_PREFIX
from pothi.operators import dense, fusion, lexical
from pothi.plans.store import materialise
from pothi.plugins import Embedder, PairScorer

Retriever = Callable[[DataFrame, int], DataFrame]
#: Candidates of the first stage, what the reranker keeps.
POOL, RERANKED = 50, 15


def lexical_retriever(index: lexical.LexicalIndex) -> Retriever:
    """BM25 over an index."""
    return lambda questions, k: lexical.bm25_top(index, questions, "query_id", "question", k)


def embedded_chunks(chunks: DataFrame, embedder: Embedder, kind: str = "float") -> DataFrame:
    """Rows (id, vector) of chunks (chunk_id, text), written once."""
    embed = dense.embed_column(embedder, PASSAGE_PREFIX, kind)
    return materialise(chunks.select(F.col("chunk_id").alias("id"), embed(F.col("text")).alias("vector")), "vectors")


def dense_retriever(vectors: DataFrame, embedder: Embedder, kind: str = "float") -> Retriever:
    """Exact dense search over (id, vector)."""
    embed = dense.embed_column(embedder, QUERY_PREFIX, kind)
    return lambda questions, k: dense.dense_top(questions.select(F.col("query_id").alias("id"), embed(F.col("question")).alias("vector")), vectors, k)


def hybrid_retriever(of_meaning: Retriever, of_words: Retriever) -> Retriever:
    """Weighted reciprocal rank fusion of a dense and a lexical retriever."""
    return lambda questions, k: fusion.reciprocal_rank_fusion(of_meaning(questions, POOL), of_words(questions, POOL), k, POOL)


@dataclass
class TwoStage:
    """Candidates of a first stage, the best fifteen by a reranker, fused with dense and lexical scores, diversified.

    Without candidates beyond k, or without vectors, the fused order is cut.
    """

    base: Retriever
    scorer: PairScorer
    chunks: DataFrame
    of_meaning: Retriever | None = None
    of_words: Retriever | None = None
    vectors: DataFrame | None = None
    weight: float = 0.6

    def __call__(self, questions: DataFrame, k: int = 10) -> DataFrame:
        first = materialise(self.base(questions, POOL), "candidates")
        found = first.select("query_id", "chunk_id")
        shown = found.join(questions.select("query_id", "question"), "query_id").join(self.chunks.select("chunk_id", "text"), "chunk_id")
        reranked = materialise(fusion.rerank(shown, self.scorer, RERANKED).select("query_id", "chunk_id", "rerank_score"), "reranked")
        none = reranked.select("query_id", "chunk_id", F.lit(0.0).alias("score")).limit(0)

        def scores(of: Retriever) -> DataFrame:
            # The first stage is not asked again where it is one of the two.
            return first if of is self.base else of(questions, POOL)

        d = scores(self.of_meaning).select("query_id", "chunk_id", "score") if self.of_meaning else none
        b = lexical.normalised(scores(self.of_words)).select("query_id", "chunk_id", "score") if self.of_words else none
        vectors = None if self.vectors is None or k >= RERANKED else self.vectors.withColumnRenamed("id", "chunk_id")
        return fusion.two_stage(reranked, d, b, vectors, k, self.weight)


def hierarchical(
    children: DataFrame, parents: DataFrame, questions: DataFrame, k: int = 10, scorer: PairScorer | None = None
) -> DataFrame:
    """Rows (query_id, parent_id, rank) of the parents of ranked children (query_id, chunk_id, rank).

    ``parents`` has (chunk_id, parent_id, text of the parent).  Parents come in
    the order of their first child; only where a query has more than k of them
    does a scorer, if given, put them in its own order.
    """
    order = materialise(fusion.roll_up(children.where(F.col("rank") <= POOL), parents.select("chunk_id", "parent_id")), "parents")
    if scorer is None:
        return order.where(F.col("rank") <= k)
    many = order.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    texts = parents.groupBy("parent_id").agg(F.min("text").alias("text"))
    shown = many.where(F.col("n") > k).join(questions.select("query_id", "question"), "query_id").join(texts, "parent_id")
    best = fusion.rerank(shown.withColumnRenamed("parent_id", "chunk_id").drop("rank"), scorer, k)
    return many.where(F.col("n") <= k).select("query_id", "parent_id", "rank").union(best.select("query_id", F.col("chunk_id").alias("parent_id"), "rank"))


def previewed(ranking: DataFrame, records: DataFrame, k: int = 3) -> DataFrame:
    """The first k rows of each ranking with the metadata of their records (chunk_id, ...)."""
    return ranking.where(F.col("rank") <= k).join(records, "chunk_id")
