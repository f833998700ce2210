"""A run over configurations: each ranking once, each answer once, metrics, resume and rescoring."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.functions.metrics import ci95, mean, mean_where, standard_deviation
from pothi.operators.generation import grounded_prompt, open_prompt
from pothi.operators.retrievers import Retriever
from pothi.plans.evaluation import missing_runs, passages_of, scored
from pothi.plans.store import materialise
from pothi.plugins import Generator

#: Chunks retrieved for scores; the prompt takes the first five of them.
DEPTH = 10


def timed_answers(df: DataFrame, generator: Generator) -> DataFrame:
    """Rows (key columns, answer, generation_ms) of rows with ``prompt``; null answers become empty."""
    keep = [f for f in df.schema if f.name != "prompt"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "answer string", "generation_ms double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            began = time.perf_counter()
            answers = generator.generate(pdf["prompt"].tolist())
            # A generator takes a batch at once; each answer counts its share of the time.
            each = 1000.0 * (time.perf_counter() - began) / max(1, len(pdf))
            yield pdf.drop(columns="prompt").assign(answer=[a or "" for a in answers], generation_ms=each)

    return df.mapInPandas(run, schema)


def run_matrix(
    configs: DataFrame, tests: DataFrame, chunks: DataFrame, retrievers: dict[str, Retriever], generators: dict[str, Generator], done: DataFrame | None = None
) -> DataFrame:
    """Results (config_id, pair_id, predicted, open_answer, retrieved_ids, latencies, metrics) of the runs that have none yet.

    ``tests`` has (pair_id, question, gold_answer, gold_chunk_id, ...), ``configs``
    (config_id, retriever, generator, prompt_type).  A retriever ranks all tests
    once for all configurations that name it, and a generator answers each test
    without passages once.  A configuration that asks without passages has no
    open answer to compare with, and its flag is 0.  The retrieval time of a test
    is its share of the time of the whole ranking.
    """
    questions = tests.select(F.col("pair_id").alias("query_id"), "question")
    named = [r.asDict() for r in configs.select("config_id", "retriever", "generator", "prompt_type").collect()]
    contexts, opened = {}, {}
    n = max(1, tests.count())
    for name in {c["retriever"] for c in named} & retrievers.keys():
        began = time.perf_counter()
        found = passages_of(retrievers[name](questions, DEPTH), chunks, DEPTH).withColumnRenamed("query_id", "pair_id")
        found = materialise(found, "contexts")
        contexts[name] = found.withColumn("retrieval_ms", F.lit(1000.0 * (time.perf_counter() - began) / n))
    for name in {c["generator"] for c in named} & generators.keys():
        prompts = tests.select("pair_id", open_prompt(F.col("question")).alias("prompt"))
        opened[name] = materialise(timed_answers(prompts, generators[name]), "opened")
    parts = []
    for c in named:
        if c["retriever"] not in contexts or c["generator"] not in opened:
            continue
        runs = tests.withColumn("config_id", F.lit(c["config_id"]))
        if done is not None:
            runs = missing_runs(runs, done)
        shown = runs.join(contexts[c["retriever"]], "pair_id", "left")
        free = opened[c["generator"]].withColumnsRenamed({"answer": "open_answer", "generation_ms": "open_ms"})
        if c["prompt_type"] == "grounded":
            prompts = shown.select("pair_id", grounded_prompt(F.col("question"), F.coalesce("passages", F.array().cast("array<string>"))).alias("prompt"))
            answered = timed_answers(prompts, generators[c["generator"]]).withColumnRenamed("answer", "predicted")
            out = shown.join(answered, "pair_id").join(free.drop("open_ms"), "pair_id")
        else:
            out = shown.join(free.withColumnsRenamed({"open_answer": "predicted", "open_ms": "generation_ms"}), "pair_id").withColumn("open_answer", F.lit(""))
        parts.append(out.drop("passages"))
    if not parts:
        raise ValueError("no configuration names a retriever and a generator that are given")
    return scored(reduce(DataFrame.unionByName, parts))


def rescored(results: DataFrame, base: DataFrame) -> DataFrame:
    """Base rows of a summary with metrics computed anew from stored results: means, spread, and by language, grade and subject.

    Every configuration with results comes out; one without a base row has nulls
    there, and a column of both counts as computed anew.
    """
    new = scored(results).groupBy("config_id").agg(
        mean(F.col("rouge_l")).alias("rouge_l"),
        standard_deviation(F.col("token_f1")).alias("token_f1_std"),
        ci95(F.col("token_f1")).alias("token_f1_ci95"),
        standard_deviation(F.col("rouge_l")).alias("rouge_l_std"),
        *(mean_where(F.col("rouge_l"), F.col("language") == k).alias(f"{k}_rouge_l") for k in ("bn", "en")),
        *(mean_where(F.col("rouge_l"), F.col("grade_band") == k).alias(f"{k}_rouge_l") for k in ("junior_sec", "ssc")),
        *(mean_where(F.col(c), F.col("subject_code") == k).alias(f"{k}_{n}") for k in ("ict", "science") for c, n in (("token_f1", "f1"), ("rouge_l", "rouge_l"))),
    )
    kept = base.select(*(c for c in base.columns if c == "config_id" or c not in new.columns))
    return new.join(kept, "config_id", "left")


def gaps(summary: DataFrame) -> DataFrame:
    """Rows (config_id, rouge_gap, language_gap): ROUGE-L above token F1, English above Bengali."""
    return summary.select("config_id", (F.col("rouge_l") - F.col("token_f1")).alias("rouge_gap"), (F.col("en_f1") - F.col("bn_f1")).alias("language_gap"))
