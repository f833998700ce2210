"""Word bags of records and how alike two of them are.

Both near-duplicate operators compare the same thing: the words of a record in
the consistent form, without case and punctuation, counted with repetition.  A
bag becomes a set by numbering the repetitions of a word, so that the Jaccard
similarity J of two sets is that of the bags, and the share of common words
(twice the common words by the words of both) is D = 2J / (1 + J).  D >= 0.8
is therefore exactly J >= 2/3.

A record is kept as a sorted array of 64-bit hashes of its numbered words.
Records with equal bags are one class, identified by a 128-bit digest; only one
representative of a class is compared with others.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pothi.llm.unicode_form import canonical

PUNCTUATION = dict.fromkeys(
    c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith("P")
)
BAG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("bag", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("n", T.IntegerType()),
    ]
)


def words_of(question: str | None, answer: str | None) -> list[str]:
    """Words of a question and its answer as they are compared; null counts as no words."""
    text = f"{canonical(question) or ''} {canonical(answer) or ''}".lower()
    return text.translate(PUNCTUATION).split()


def numbered_hashes(words: list[str]) -> list[int]:
    """64-bit hash of each word with the number of its repetition."""
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen.get(w, 0)
        seen[w] = k + 1
        h = _hash(w)
        # A seed would not do: on short words it only shifts the input, and the second "2" may be the first "3".
        out.append(h if not k else xxhash.xxh3_64_intdigest(f"{w} {k}"))
    return out


class _Memo(dict):
    """Hashes of words; emptied when it would grow beyond a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_hash = _Memo().__getitem__


def _bag_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bags, arrays, sizes = [], [], []
        for q, a in zip(pdf["question"], pdf["answer"], strict=True):
            found = np.array(numbered_hashes(words_of(q, a)), dtype=np.uint64)
            found.sort()
            bags.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            arrays.append(found.view(np.int64))
            sizes.append(len(found))
        yield pd.DataFrame({"id": pdf["id"], "bag": bags, "words": arrays, "n": sizes}).assign(
            **{c: pdf[c] for c in pdf.columns if c not in ("id", "question", "answer")}
        )


def bags(df: DataFrame, key: str, question: str, answer: str, keep: dict[str, T.DataType] | None = None) -> DataFrame:
    """One row (id, bag, words, n, kept columns) for each row with a key; rows with a null key have no identity and are left out."""
    keep = keep or {}
    schema = T.StructType([*BAG_SCHEMA.fields, *(T.StructField(c, t) for c, t in keep.items())])
    return (
        df.where(F.col(f"`{key}`").isNotNull())
        .select(
            F.col(f"`{key}`").cast("bigint").alias("id"),
            F.col(f"`{question}`").alias("question"),
            F.col(f"`{answer}`").alias("answer"),
            *(F.col(f"`{c}`") for c in keep),
        )
        .mapInPandas(_bag_rows, schema)
    )


def dice(a: str = "a_words", b: str = "b_words") -> F.Column:
    """Twice the common words by the words of both; two empty records share nothing."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))
