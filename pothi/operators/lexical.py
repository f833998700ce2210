"""BM25: an index of document vectors, statistics of terms, and exact top-k.

The index keeps each document as its terms with their counts, in place.  A
stated set of queries is cut into blocks of a bounded number of terms; a block
travels to the documents as a broadcast of proven size, every partition adds up
the scores of its documents term by term in arrays, and only the k best of each
query and partition leave it.  No pair of query and document is ever shuffled,
and a document without a query term simply scores 0, so that negative weights
and short rankings need no case of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pothi.functions.text import expand_query, stem, tokens
from pothi.operators.topk import Best, ranked
from pothi.plans.store import materialise

#: Parameters of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms of one block, which bounds what is broadcast.
BLOCK_TERMS = 500_000
_FOUND = "query_id long, chunk_id long, score double"


@dataclass
class LexicalIndex:
    """Documents (doc_id, length, terms: array of (term, tf)) and terms (term, df, idf)."""

    documents: DataFrame
    terms: DataFrame
    n: int
    mean_length: float
    floor: float


def _counted(df: DataFrame, ids: list[str], words: Column, form: Callable[[Column], Column] | None, n: str) -> DataFrame:
    """Rows (ids, term, n): how often each term occurs; words are counted first, so the form is taken once for each distinct word."""
    counted = df.select(*ids, F.explode_outer(words).alias("word")).groupBy(*ids, "word").agg(F.count("word").alias("n"))
    if form is None:
        return counted.select(*ids, F.col("word").alias("term"), F.col("n").alias(n))
    return counted.select(*ids, form(F.col("word")).alias("term"), "n").groupBy(*ids, "term").agg(F.sum("n").alias(n))


def build_index(docs: DataFrame, key: str, text: str = "text", form: Callable[[Column], Column] | None = stem) -> LexicalIndex:
    """Index of distinct keys; a key that comes twice counts with its first text, a null text has no words.

    The documents are partitioned by key once; counting and forming the vectors keep that partitioning.
    """
    texts = docs.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("doc_id")).agg(F.min(F.col(f"`{text}`")).alias("text"))
    term = F.when(F.col("term").isNotNull(), F.struct("term", F.col("tf").cast("int").alias("tf")))
    vectors = _counted(texts, ["doc_id"], tokens(F.col("text")), form, "tf").groupBy("doc_id").agg(F.sum("tf").alias("length"), F.collect_list(term).alias("terms"))
    documents = materialise(vectors, "documents")
    totals = documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n = totals["n"]
    df = documents.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = materialise(df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    floor = EPSILON * (raw.agg(F.avg("raw")).first()[0] or 0.0)
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(documents, terms, n, float(totals["mean"] or 0.0), float(floor))


def score_of(tf, length, mean_length: float):
    """What an occurrence count adds to a score, for columns and for arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean_length or 1.0)))


def bm25_top(
    index: LexicalIndex,
    queries: DataFrame,
    key: str,
    text: str,
    k: int = 10,
    expand: bool = True,
    form: Callable[[Column], Column] | None = stem,
) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank) of the k best documents of each query, exactly.

    Scores are compared at six decimals, so the order of summation does not
    decide between equal documents; then the least id comes first.
    """
    q = F.col(f"`{text}`")
    asked = queries.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("bigint").alias("query_id")).agg(F.min(q).alias("text"))
    words = tokens(expand_query(F.col("text")) if expand else F.col("text"))
    weighted = _counted(asked, ["query_id"], words, form, "times").join(index.terms, "term", "left").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    weighted = materialise(weighted, "asked")
    blocks = max(1, -(-weighted.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        part = weighted if blocks == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        scored = _block_scores(index, part, k)
        found = scored if found is None else found.union(scored)
    return ranked(found, k)


def _block_scores(index: LexicalIndex, part: DataFrame, k: int) -> DataFrame:
    """The k best documents of each partition for a block of queries (query_id, term, weight)."""
    rows = part.toPandas()
    ids = np.unique(rows["query_id"].to_numpy(np.int64))
    rows = rows[rows["weight"].notna()]
    names = pd.Index(rows["term"].unique())
    at_query, at_term = np.searchsorted(ids, rows["query_id"].to_numpy(np.int64)), names.get_indexer(rows["term"])
    order = np.lexsort((at_term, at_query))
    at_query, at_term, weight = at_query[order], at_term[order], rows["weight"].to_numpy(float)[order]
    begin = np.searchsorted(at_query, np.arange(len(ids) + 1))
    shared = index.documents.sparkSession.sparkContext.broadcast((ids, list(names), at_term, weight, begin))
    mean_length = index.mean_length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, names, at_term, weight, begin = shared.value
        place = {t: i for i, t in enumerate(names)}
        best = Best(ids, k)
        for pdf in batches:
            pdf = pdf.sort_values("doc_id", kind="stable", ignore_index=True)
            doc, term, tf = [], [], []
            for i, (terms, counts) in enumerate(zip(pdf["terms"], pdf["tfs"], strict=True)):
                for t, n in zip(terms, counts, strict=True):
                    j = place.get(t)
                    if j is not None:
                        doc.append(i)
                        term.append(j)
                        tf.append(n)
            doc, term, tf = np.array(doc, np.int64), np.array(term, np.int64), np.array(tf, float)
            part = score_of(tf, pdf["length"].fillna(0).to_numpy(float)[doc], mean_length)
            by_term = np.argsort(term, kind="stable")
            doc, part = doc[by_term], part[by_term]
            first = np.searchsorted(term[by_term], np.arange(len(names) + 1))
            candidates = pdf["doc_id"].to_numpy(np.int64)
            for q0, q1 in best.blocks(len(candidates)):
                score = np.zeros((q1 - q0, len(candidates)))
                for q in range(q0, q1):
                    row = score[q - q0]
                    for at in range(begin[q], begin[q + 1]):
                        t = at_term[at]
                        # A document stands once among those of a term.
                        row[doc[first[t] : first[t + 1]]] += weight[at] * part[first[t] : first[t + 1]]
                best.offer(q0, candidates, score)
        yield from best.rows()

    return index.documents.select("doc_id", "length", F.col("terms.term").alias("terms"), F.col("terms.tf").alias("tfs")).mapInPandas(run, _FOUND)


def normalised(ranking: DataFrame) -> DataFrame:
    """Scores by the best score of their query, which counts as 1e-9 at least."""
    best = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    return ranking.withColumn("score", F.col("score") / best)
