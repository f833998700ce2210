"""Metrics of answers and rankings as column expressions.

Nothing is rounded here; round when showing.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pothi.functions.text import normal_form, tokens


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def exact_match(predicted: Column, gold: Column) -> Column:
    """1 when both are non-empty and have one normal form."""
    same = (_text(predicted) != "") & (_text(gold) != "") & (normal_form(predicted) == normal_form(gold))
    return F.when(same, 1.0).otherwise(0.0)


def bound(f: Callable[..., Column], *arguments: Column) -> Column:
    """``f`` of columns that are evaluated once, however often ``f`` uses them inside lambdas."""
    packed = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(arguments)))
    return F.transform(F.array(packed), lambda s: f(*(s[f"_{i}"] for i in range(len(arguments)))))[0]


def _shared(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))),
    )


def shared_tokens(a: Column, b: Column) -> Column:
    """Common elements of two arrays counted with repetition."""
    return bound(_shared, a, b)


def f1(common: Column, n_predicted: Column, n_gold: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without common tokens."""
    return F.when(common > 0, 2.0 * common / (n_predicted + n_gold)).otherwise(F.lit(0.0))


def answer_tokens(c: Column) -> Column:
    return tokens(normal_form(_text(c)))


def token_f1(predicted: Column, gold: Column) -> Column:
    return bound(lambda p, g: f1(_shared(p, g), F.size(p), F.size(g)), answer_tokens(predicted), answer_tokens(gold))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit row at a time."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in b:
        x = row & where.get(t, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(predicted: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of tokens."""
    p, g = answer_tokens(predicted), answer_tokens(gold)
    return f1(lcs_length(p, g), F.size(p), F.size(g))


def coverage(predicted: Column, passages: Column) -> Column:
    """Share of the distinct tokens of an answer that stand in any passage (array of texts)."""
    texts = F.coalesce(passages, F.array().cast("array<string>"))
    return coverage_by(predicted, F.flatten(F.transform(texts, answer_tokens)))


def coverage_by(predicted: Column, seen: Column) -> Column:
    """The same for passages that are tokens already; null counts as none."""

    def share(p: Column, s: Column) -> Column:
        return F.when(F.size(p) > 0, F.size(F.array_intersect(p, s)) / F.size(p)).otherwise(F.lit(0.0))

    return bound(share, F.array_distinct(answer_tokens(predicted)), F.coalesce(seen, F.array().cast("array<string>")))


def recall_at(ids: Column, gold: Column, k: int) -> Column:
    """1 when the gold id is among the first k; empty lists and null ids give 0."""
    hit = F.array_contains(F.slice(ids, 1, k), gold)
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def recall_at_named(ids: Column, gold: Column, k: int) -> Column:
    """The same for ids kept as text, where a chunk may also stand under its formatted name."""
    first = F.slice(ids, 1, k)
    hit = F.array_contains(first, gold.cast("string")) | F.array_contains(first, F.format_string("chunk_%06d", gold))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def grounding_flag(open_f1: Column, grounded_f1: Column, open_answer: Column, guard_empty: bool) -> Column:
    """1 when the answer without passages scores more than 0.10 below the grounded one.

    With ``guard_empty`` an empty open answer raises no flag.
    """
    below = open_f1 < grounded_f1 - 0.10
    if guard_empty:
        below = below & (_text(open_answer) != "")
    return F.when(below, 1).otherwise(0)


def squashed(score: Column, scale: float = 5.0) -> Column:
    """Logistic of a reranker's score."""
    return 1.0 / (1.0 + F.exp(-score / scale))


def standard_deviation(c: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def ci95(c: Column) -> Column:
    """Half width of the 95 % interval of the mean; 0 for fewer than two values."""
    return F.coalesce(1.96 * F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))


def mean(c: Column) -> Column:
    """Mean; 0 over nothing."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def mean_where(c: Column, condition: Column) -> Column:
    """Mean over the rows that satisfy a condition; 0 over nothing."""
    return F.coalesce(F.avg(F.when(condition, c)), F.lit(0.0))
