"""Splitting pages into overlapping, sentence-aware chunks, and numbering them.

The window rule is sequential within a page and independent between pages, so
pages are split in Arrow batches where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pothi.plans.store import materialise

SIZE, OVERLAP, LEAST = 1000, 200, 50
# Fixed value: sentence ends, by priority and not by place.
SENTENCE_ENDS = ("।", ".", "?", "!", "\n")


def windows(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str]]:
    """(start, chunk) of each chunk of more than ``least`` characters; null and empty texts have none.

    A window that is not the last ends after the last sentence end of the first
    kind that stands beyond its middle.  The next one begins ``overlap`` before
    that end, but at least half a window further, so that a tail of text that
    was already given may follow.
    """
    out: list[tuple[int, str]] = []
    start, n = 0, len(text or "")
    while start < n:
        stop = min(start + size, n)
        if stop < n:
            half = start + size // 2
            for mark in SENTENCE_ENDS:
                at = text.rfind(mark, start, stop)
                if at > half:
                    stop = at + 1
                    break
        chunk = text[start:stop].strip()
        if len(chunk) > least:
            out.append((start, chunk))
        start += max(stop - start - overlap, size // 2, 1)
    return out


def split_pages(
    pages: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (key, chunk_pos, start, text, char_count, kept columns of the page); pages are stripped first, blank ones give nothing."""
    kind = pages.schema[key].dataType.simpleString()
    kept = [(f"_kept{i}", c) for i, c in enumerate(keep)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, own = [], []
            for i, (k, page) in enumerate(zip(pdf["key"], pdf["text"], strict=True)):
                for position, (start, chunk) in enumerate(windows((page or "").strip(), size, overlap, least)):
                    rows.append((k, position, start, chunk, len(chunk)))
                    own.append(i)
            out = pd.DataFrame(rows, columns=["key", "chunk_pos", "start", "text", "char_count"])
            yield out.assign(**{n: pdf[n].iloc[own].to_numpy() for n, _ in kept})

    schema = ", ".join([f"key {kind}, chunk_pos int, start int, text string, char_count int", *(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in kept)])
    return (
        pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(n) for n, c in kept))
        .mapInPandas(run, schema)
        .withColumnsRenamed({"key": key} | dict(kept))
    )


def number_rows(df: DataFrame, order: list[str], name: str = "chunk_id", first: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in the given order.

    Rows are range-partitioned and written once; the sizes of the partitions
    give offsets, so the only global step is a sum over partitions.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + rank - 1 + first).cast("bigint"))
        .drop("_part", "_before")
    )
