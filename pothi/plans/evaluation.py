"""Evaluation of retrieval and generation: metric columns, summaries, breakdowns, merges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pothi.functions.metrics import answer_tokens, ci95, exact_match, grounding_flag, mean, mean_where, recall_at, rouge_l, standard_deviation, token_f1
from pothi.functions.text import QUERY_PREFIX, normal_form
from pothi.plans.configuration import each_of
from pothi.plugins import Embedder, Generator, PairScorer

DEPTHS = (1, 3, 5, 10)


def sentence_similarity(predicted: Column, gold: Column, embedder: Embedder) -> Column:
    """Cosine of the embedded normal forms of two texts."""

    @F.pandas_udf(T.DoubleType())
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            x, y = (embedder.embed([QUERY_PREFIX + t for t in s.fillna("")]) for s in (a, b))
            yield pd.Series(np.einsum("ij,ij->i", x.astype(float), y.astype(float)))

    return similar(normal_form(F.coalesce(predicted, F.lit(""))), normal_form(F.coalesce(gold, F.lit(""))))


def _entailment(scorer: PairScorer, premise: Column, answer: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for premises, answers in batches:
            yield pd.Series(scorer.score(premises.fillna("").tolist(), answers.fillna("").tolist()), dtype="float64")

    return score(premise, answer)


def faithfulness(answers: DataFrame, scorer: PairScorer, passages: int = 5, characters: int = 512) -> DataFrame:
    """Rows (query_id, score, rank): the best entailment of an answer by its first passages, earliest on ties.

    ``answers`` has (query_id, answer, passages: array of texts); without
    passages the score is 0 and the rank -1.
    """
    each = answers.select("query_id", "answer", F.posexplode(F.slice("passages", 1, passages)).alias("at", "text"))
    scored = each.withColumn("score", _entailment(scorer, F.substring("text", 1, characters), F.col("answer")))
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("at")).alias("back"))).alias("b"))
    found = best.select("query_id", "b.score", (1 - F.col("b.back")).alias("rank"))
    return answers.select("query_id").join(found, "query_id", "left").fillna({"score": 0.0, "rank": -1})


def faithfulness_of_ids(answers: DataFrame, chunks: DataFrame, scorer: PairScorer, passages: int = 5, characters: int = 512) -> DataFrame:
    """Rows (config_id, pair_id, score, rank) of distinct ``answers``: the same for passages named by id; ids that no chunk has do not count.

    ``answers`` has (config_id, pair_id, answer, ids), ``chunks`` (chunk_id,
    text).  Ids travel alone until the first ones that exist are known, then
    answers travel to the texts, so that a text is moved once and not with
    every answer that names it.
    """
    key = ["config_id", "pair_id"]
    given = answers.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("answer", "ids"))).alias("given"))
    each = given.dropna(subset=key).select(*key, F.posexplode("given").alias("which", "g")).select(*key, "which", F.posexplode("g.ids").alias("place", "chunk_id"))
    known = each.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    at = F.row_number().over(Window.partitionBy(*key).orderBy("place", "which"))
    first = known.withColumn("rank", at).where(F.col("rank") <= passages)
    # The planner takes a text for twenty bytes; no side of these joins may go through the driver on that estimate.
    asked = first.join(given.hint("merge"), key).select(*key, "rank", "chunk_id", F.get("given", F.col("which"))["answer"].alias("answer"))
    shown = asked.join(chunks.select("chunk_id", F.substring("text", 1, characters).alias("text")).hint("merge"), "chunk_id")
    scored = shown.select(*key, "rank", _entailment(scorer, F.col("text"), F.col("answer")).alias("score"))
    best = scored.groupBy(*key).agg(F.max(F.struct("score", (-F.col("rank")).alias("back"))).alias("b"))
    found = best.select(*key, "b.score", (-F.col("b.back")).alias("rank"))
    return given.select(*key, F.explode("given")).select(*key).join(found, key, "left").fillna({"score": 0.0, "rank": -1})


def tokens_seen(answers: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (config_id, pair_id, seen): the tokens of an answer that stand in a chunk that it names; no row where it names none.

    ``answers`` has (config_id, pair_id, predicted, ids), ``words``
    (chunk_id, words: array of tokens).  Answers travel to the words, as
    tokens between blanks, and only what both hold travels on.
    """
    key = ["config_id", "pair_id"]
    asked = F.array_join(F.array_distinct(F.flatten(F.transform(F.collect_set("predicted"), answer_tokens))), " ").alias("asked")
    ids = F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids")
    each = answers.dropna(subset=key).groupBy(*key).agg(asked, ids).where("asked <> ''").select(*key, "asked", F.explode("ids").alias("chunk_id"))
    # The planner takes an array for one element; no side may go through the driver on that estimate.
    met = words.hint("merge").join(each, "chunk_id").select(*key, F.array_join(F.array_intersect("words", F.split("asked", " ")), " ").alias("met"))
    seen = F.array_remove(F.array_distinct(F.split(F.array_join(F.collect_set("met"), " "), " ")), "")
    return met.groupBy(*key).agg(seen.alias("seen")).hint("merge")


def scored(predictions: DataFrame, guard_empty: bool = True) -> DataFrame:
    """``predictions`` with their metrics computed anew (em, token_f1, rouge_l, recall, hallucination)."""
    p, g = F.col("predicted"), F.col("gold_answer")
    out = predictions.withColumns(
        {
            "em": exact_match(p, g),
            "token_f1": token_f1(p, g),
            "rouge_l": rouge_l(p, g),
            "open_f1": token_f1(F.col("open_answer"), g),
            **{f"recall_at_{k}": recall_at(F.col("retrieved_ids"), F.col("gold_chunk_id"), k) for k in DEPTHS},
        }
    )
    return out.withColumn("hallucination", grounding_flag(F.col("open_f1"), F.col("token_f1"), F.col("open_answer"), guard_empty)).drop("open_f1")


def summary(results: DataFrame, configs: DataFrame) -> DataFrame:
    """One row for each configuration: means, and means by language and grade; a configuration without rows is left out."""
    bn, en = F.col("language") == "bn", F.col("language") == "en"
    junior, ssc = F.col("grade_band") == "junior_sec", F.col("grade_band") == "ssc"
    f1, em = F.col("token_f1"), F.col("em")
    aggregated = results.groupBy("config_id").agg(
        F.count("*").alias("n"),
        *(mean(F.col(f"recall_at_{k}")).alias(f"recall_at_{k}") for k in DEPTHS),
        mean(em).alias("em"),
        mean(f1).alias("token_f1"),
        mean(F.col("hallucination")).alias("hallucination_rate"),
        mean_where(f1, bn).alias("bn_f1"),
        mean_where(em, bn).alias("bn_em"),
        mean_where(f1, en).alias("en_f1"),
        mean_where(em, en).alias("en_em"),
        mean_where(f1, junior).alias("junior_sec_f1"),
        mean_where(f1, ssc).alias("ssc_f1"),
    )
    return configs.select("config_id", "retriever", "generator", "prompt_type").join(aggregated, "config_id")


def enhanced_summary(results: DataFrame, configs: DataFrame) -> DataFrame:
    """The wider summary with spread, intervals, similarity, subjects and latencies; ``results`` may lack bert_score."""
    results = results if "bert_score" in results.columns else results.withColumn("bert_score", F.lit(None).cast("double"))
    masks = {
        "bn": F.col("language") == "bn", "en": F.col("language") == "en", "junior_sec": F.col("grade_band") == "junior_sec",
        "ssc": F.col("grade_band") == "ssc", "ict": F.col("subject_code") == "ict", "science": F.col("subject_code") == "science",
    }
    parts = {"f1": masks, "rouge_l": masks, "bert_score": {k: m for k, m in masks.items() if k in ("bn", "en", "ict", "science")}}
    columns = {"f1": "token_f1", "rouge_l": "rouge_l", "bert_score": "bert_score"}
    aggregated = results.groupBy("config_id").agg(
        F.count("*").alias("n"),
        *(mean(F.col(f"recall_at_{k}")).alias(f"recall_at_{k}") for k in DEPTHS),
        *(mean(F.col(c)).alias(c) for c in ("em", "token_f1", "rouge_l", "bert_score")),
        mean(F.col("hallucination")).alias("hallucination_rate"),
        standard_deviation(F.col("token_f1")).alias("token_f1_std"),
        ci95(F.col("token_f1")).alias("token_f1_ci95"),
        standard_deviation(F.col("rouge_l")).alias("rouge_l_std"),
        standard_deviation(F.col("bert_score")).alias("bert_score_std"),
        *(mean_where(F.col(columns[m]), mask).alias(f"{name}_{m}") for m, named in parts.items() for name, mask in named.items()),
        # A latency that was not logged counts as 0.
        mean(F.coalesce("retrieval_ms", F.lit(0))).alias("avg_retrieval_ms"),
        mean(F.coalesce("generation_ms", F.lit(0))).alias("avg_generation_ms"),
    )
    described = configs.withColumn("desc", F.concat_ws(" + ", "retriever", "generator", "prompt_type"))
    return described.select("config_id", "desc", "retriever", "generator", "prompt_type").join(aggregated, "config_id")


def long_breakdown(wide: DataFrame) -> DataFrame:
    """A summary as rows (config columns, language, token_f1, em)."""
    keys = ["config_id", "retriever", "generator", "prompt_type"]
    return wide.select(*keys, F.expr("stack(2, 'bn', bn_f1, bn_em, 'en', en_f1, en_em) AS (language, token_f1, em)"))


def long_grades(wide: DataFrame) -> DataFrame:
    """A summary as rows (config columns, grade_band, token_f1)."""
    keys = ["config_id", "retriever", "generator", "prompt_type"]
    return wide.select(*keys, F.expr("stack(2, 'junior_sec', junior_sec_f1, 'ssc', ssc_f1) AS (grade_band, token_f1)"))


def merge_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows of other configurations and the new rows, by configuration; columns of either side are kept."""
    return stored.join(new.select("config_id"), "config_id", "left_anti").unionByName(new, allowMissingColumns=True).orderBy("config_id")


def best_configuration(wide: DataFrame, by: str = "token_f1") -> DataFrame:
    """The row with the greatest value, nulls last, the least configuration on ties."""
    return wide.orderBy(F.col(by).desc_nulls_last(), "config_id").limit(1)


def present_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*(c for c in wanted if c in df.columns))


def configuration_runs(configs: DataFrame, tests: DataFrame) -> DataFrame:
    """Every configuration with every test item."""
    return each_of(tests, configs)


def missing_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Runs that have no result yet, by configuration and pair."""
    keys = ["config_id", "pair_id"]
    return runs.join(done.select(*keys).distinct(), keys, "left_anti")


def passages_of(ranking: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, retrieved_ids, passages) of the first k chunks, in order; ids without a chunk are dropped."""
    texts = ranking.where(F.col("rank") <= k).join(chunks.select("chunk_id", "text"), "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    return texts.groupBy("query_id").agg(listed.alias("l")).select("query_id", F.col("l.chunk_id").alias("retrieved_ids"), F.col("l.text").alias("passages"))


def answer(tests: DataFrame, contexts: DataFrame, generator: Generator) -> DataFrame:
    """``tests`` (pair_id, question, ...) with retrieved ids, a grounded and an open answer, each asked once."""
    from pothi.operators.generation import generate, grounded_prompt, open_prompt

    joined = tests.join(contexts.withColumnRenamed("query_id", "pair_id"), "pair_id", "left")
    grounded = generate(joined, grounded_prompt(F.col("question"), F.coalesce("passages", F.array().cast("array<string>"))), generator, "predicted")
    asked = generate(grounded, open_prompt(F.col("question")), generator, "open_answer")
    return asked.withColumns({c: F.coalesce(c, F.lit("")) for c in ("predicted", "open_answer")}).drop("passages")


def grouping_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column on its own, as rows (dimension, value, n), in one pass."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(columns)) - 1
    kind = reduce(lambda x, ic: x.when(F.col("g") == full - (1 << (len(columns) - 1 - ic[0])), ic[1]), enumerate(columns), F)
    value = F.coalesce(*(F.col(c).cast("string") for c in columns))
    return sets.select(kind.alias("dimension"), value.alias("value"), "n")
