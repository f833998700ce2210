"""Signals of question-answer pairs, the validation funnel and its report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pothi.functions.metrics import bound
from pothi.functions.text import _nfc, strip, tokens
from pothi.operators.dedup import greedy_dedup
from pothi.plans.store import materialise
from pothi.plugins import Detector, Generator

#: Thresholds of the signals.
LEAST_OVERLAP, RETRIEVAL_DEPTH, CMAR_TARGET, DEDUP_COSINE = 0.25, 3, 0.80, 0.97
# Question words.
QUESTION_WORDS = ("what", "which", "who", "when", "where", "why", "how", *map(_nfc, ("কী", "কি", "কোন", "কেন", "কোথায়", "কখন", "কীভাবে")))
# Fixed value: how a verifier is asked; the source is cut to what the verifier takes.
VERIFY_PROMPT = "Question: %s\nAnswer: %s\nSource: %s\nReply PASS if the source supports the answer, else FAIL."


def overlap(answer: Column, source: Column) -> Column:
    """Share of the words of an answer, with repetition, that stand in the source; 0 when either is empty."""

    def share(a: Column, s: Column) -> Column:
        inside = F.size(F.filter(a, lambda x: F.array_contains(s, x)))
        return F.when((F.size(a) > 0) & (F.size(s) > 0), inside / F.size(a)).otherwise(F.lit(0.0))

    return bound(share, tokens(F.coalesce(answer, F.lit(""))), tokens(F.coalesce(source, F.lit(""))))


def structure_reason(question: Column, answer: Column, evidence: Column) -> Column:
    """First rule that a pair breaks, or ok; nulls count as empty."""
    q, a, e = (strip(F.coalesce(c, F.lit(""))) for c in (question, answer, evidence))
    asks = q.endswith("?") | q.endswith("।") | F.arrays_overlap(tokens(q), F.array(*map(F.lit, QUESTION_WORDS)))
    return (
        F.when(F.char_length(q) < 10, "question_too_short")
        .when(F.char_length(a) < 5, "answer_too_short")
        .when(e == "", "missing_evidence")
        .when(F.lower(q) == F.lower(a), "question_equals_answer")
        .when(~asks, "not_a_question")
        .otherwise("ok")
    )


def script_language(text: Column) -> Column:
    """Default detector: the script with more letters, null without letters."""
    bengali, latin = F.regexp_count(text, F.lit("[ঀ-৿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((bengali + latin) == 0, F.lit(None).cast("string")).when(bengali > latin, "bn").otherwise("en")


def detect_language(text: Column, detector: Detector) -> Column:
    """Language by an injected detector."""

    @F.pandas_udf(T.StringType())
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(detector.detect, na_action="ignore").astype(object)

    return detect(text)


def signals(pairs: DataFrame, detected: Column | None = None) -> DataFrame:
    """``pairs`` with overlap, detected_lang, structure_reason and the flags s3, s4, s5."""
    both = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))
    out = pairs.withColumns(
        {
            "overlap": overlap(F.col("answer"), F.col("source_text")),
            "detected_lang": detected if detected is not None else script_language(both),
            "structure_reason": structure_reason(F.col("question"), F.col("answer"), F.col("evidence")),
        }
    )
    return out.withColumns(
        {
            "s3": F.col("overlap") >= LEAST_OVERLAP,
            "s4": F.coalesce(F.col("detected_lang") == F.coalesce("language", F.lit("en")), F.lit(False)),
            "s5": F.col("structure_reason") == "ok",
        }
    )


def verify(pairs: DataFrame, name: str, verifier: Generator) -> DataFrame:
    """``pairs`` with a verifier's verdict (``api_failed`` when it gives none) and the flag that it begins with PASS."""

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(verifier.generate(prompts.tolist()), index=prompts.index, dtype=object)

    prompt = F.format_string(VERIFY_PROMPT, *(F.coalesce(c, F.lit("")) for c in (F.col("question"), F.col("answer"), F.substring("source_text", 1, 600))))
    return pairs.withColumn(f"{name}_verdict", F.coalesce(ask.asNondeterministic()(prompt), F.lit("api_failed"))).withColumn(
        name, F.upper(F.trim(f"{name}_verdict")).startswith("PASS")
    )


def round_trip(pairs: DataFrame, ranking: DataFrame, depth: int = RETRIEVAL_DEPTH) -> DataFrame:
    """``pairs`` with the flag s1: the pair's own chunk is among the first ``depth`` retrieved for its question."""
    hits = ranking.where(F.col("rank") <= depth).select(F.col("query_id").alias("pair_id"), "chunk_id").distinct().withColumn("s1", F.lit(True))
    return pairs.join(hits, ["pair_id", "chunk_id"], "left").withColumn("s1", F.coalesce("s1", F.lit(False)))


def deduplicated(flagged: DataFrame, threshold: float = DEDUP_COSINE) -> tuple[DataFrame, Column]:
    """``flagged`` and the column that tells which rows greedy elimination keeps, run on what all signals let pass."""
    flagged = materialise(flagged, "flagged")
    passed = flagged.where(F.col("s3") & F.col("s4") & F.col("s5") & F.col("s2") & F.col("s1") & F.col("s6"))
    kept = greedy_dedup(passed, "pair_id", "question", threshold)
    return flagged.join(kept, "pair_id", "left"), F.coalesce("kept", F.lit(False))


def funnel(flagged: DataFrame, kept: Column | None = None, gold_size: int = 200) -> DataFrame:
    """Report of one row; ``flagged`` has s1 to s6, ``kept`` tells which rows deduplication keeps.

    ``cmar`` sets the pairs after deduplication against all, ``cmar_of_verified``
    against those that the last signal let pass.
    """
    first = F.col("s3") & F.col("s4") & F.col("s5")
    steps = {"after_s3_s4_s5": first}
    for name, flag in (("after_s2", "s2"), ("after_s1", "s1"), ("after_s6", "s6")):
        steps[name] = list(steps.values())[-1] & F.col(flag)
    steps["after_dedup"] = steps["after_s6"] & (kept if kept is not None else F.lit(True))
    counted = flagged.agg(F.count("*").alias("total_raw"), *(F.count_if(c).alias(n) for n, c in steps.items()))
    share = F.coalesce(F.try_divide(F.col("after_dedup"), F.col("total_raw")), F.lit(0.0))
    return counted.withColumns(
        {
            "gold_test_set_size": F.least(F.lit(gold_size), F.col("after_dedup")).cast("bigint"),
            "cmar": share,
            "cmar_of_verified": F.coalesce(F.try_divide(F.col("after_dedup"), F.col("after_s6")), F.lit(0.0)),
            "cmar_target": F.lit(CMAR_TARGET),
            "cmar_met": share >= CMAR_TARGET,
            "rejection_rate": 1.0 - share,
        }
    )
