"""The k best rows of each query, kept while a partition of rows passes by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores that are held at once.
SCORES = 1 << 22


class Best:
    """Running k best candidates for each of a block of queries; equal scores (at six decimals) go to the least id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.ids = np.zeros((len(queries), k), np.int64)
        self.scores = np.full((len(queries), k), -np.inf)

    def blocks(self, candidates: int) -> Iterator[tuple[int, int]]:
        """Ranges of queries whose scores against so many candidates are held at once."""
        step = max(1, SCORES // max(1, candidates))
        for at in range(0, len(self.queries), step):
            yield at, min(at + step, len(self.queries))

    def offer(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take the scores (queries from ``at`` on x candidates) into account."""
        n = len(scores)
        if not n or not len(ids):
            return
        known = self.scores[at : at + n]
        rounded = np.round(scores, 6)
        # Below the k-th best score, of the new candidates or of the known ones, nothing can enter.
        least = np.round(known[:, -1], 6)
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(rounded, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(rounded >= least[:, None])
        old_row, old_col = np.nonzero(np.isfinite(known))
        rows = np.r_[row, old_row]
        everyone = np.r_[ids[col], self.ids[at : at + n][old_row, old_col]]
        value = np.r_[scores[row, col], known[old_row, old_col]]
        order = np.lexsort((everyone, -np.round(value, 6), rows))
        rows, everyone, value = rows[order], everyone[order], value[order]
        begin = np.searchsorted(rows, np.arange(n))
        place = np.arange(len(rows)) - begin[rows]
        kept = place < self.k
        known[:] = -np.inf
        known[rows[kept], place[kept]] = value[kept]
        self.ids[at : at + n][rows[kept], place[kept]] = everyone[kept]

    def rows(self) -> Iterator[pd.DataFrame]:
        """Rows (query_id, chunk_id, score)."""
        for at in range(0, len(self.queries), 65_536):
            row, col = np.nonzero(np.isfinite(self.scores[at : at + 65_536]))
            if len(row):
                row = row + at
                yield pd.DataFrame({"query_id": self.queries[row], "chunk_id": self.ids[row, col], "score": self.scores[row, col]})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank) of the k best of what the partitions found."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
