"""Dense retrieval: embedding, exact search in blocks, and an inverted-file index.

Exact search compares a stated set of queries with all rows: rows stay in place,
queries travel to them in blocks of bounded size, meet them as matrix products,
and only the k best rows of each query leave a partition.  The inverted file
clusters a bounded sample into as many cells as the square root of the rows,
puts every row into its nearest cell, and searches the nearest cells of a query,
as many as reach the wanted recall on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.operators.sampling import hashed_sample
from pothi.operators.topk import Best, ranked
from pothi.plans.store import materialise
from pothi.plugins import Embedder

#: Bytes of a block of queries that is broadcast.
BLOCK_BYTES = 64 << 20
#: Queries and rows of a cell that one task compares.
QUERY_BLOCK, ROW_BLOCK = 16_384, 65_536
#: Cells of the inverted file, and rows that they are fitted on, at most (or forty for each cell).
MOST_CELLS, SAMPLE = 4096, 20_000


def embed_column(embedder: Embedder, prefix: str = "", kind: str = "float"):
    """Pandas UDF of text to unit vectors of floats or doubles; null counts as empty."""

    @F.pandas_udf(f"array<{kind}>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed([prefix + (t or "") for t in texts])), index=texts.index)

    return embed


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _found(ids: np.ndarray, vectors: np.ndarray, batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows (query_id, chunk_id, score): the k best rows (id, vector) of all batches for each query."""
    best = Best(ids, k)
    for pdf in batches:
        if not len(pdf) or not len(ids):
            continue
        candidates, x = pdf["id"].to_numpy(np.int64), _unit(_matrix(pdf["vector"].to_numpy())).T
        for q0, q1 in best.blocks(len(candidates)):
            best.offer(q0, candidates, vectors[q0:q1] @ x)
    yield from best.rows()


def _block(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block of queries."""
    pdf = queries.select("id", "vector").toPandas()
    return pdf["id"].to_numpy(np.int64), _unit(_matrix(pdf["vector"].to_numpy()))


def dense_top(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """Exact rows (query_id, chunk_id, score, rank); both sides have (id, vector), vectors are compared by cosine.

    Rows stay where they are and are read once for each block of queries; a
    block is broadcast and has ``BLOCK_BYTES`` at most.  Only the k best rows of
    each query leave a partition.  Rows and queries without a vector are left out.
    """
    queries, rows = queries.where("vector is not null"), rows.where("vector is not null").select("id", "vector")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    # Twice what the blocks need on average, because they are told by hashes.
    blocks = max(1, -(-2 * size["n"] * 8 * (size["d"] or 1) // BLOCK_BYTES)) if size["n"] * 8 * (size["d"] or 1) > BLOCK_BYTES else 1
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        shared = rows.sparkSession.sparkContext.broadcast(_block(part))

        def meet(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return _found(*shared.value, batches, k)

        scored = rows.mapInPandas(meet, "query_id long, chunk_id long, score double")
        found = scored if found is None else found.union(scored)
    return ranked(found, k)


def cells_of(n: int) -> int:
    """Cells of an inverted file over n rows: the square root, at most ``MOST_CELLS``."""
    return int(min(max(1, n**0.5), MOST_CELLS))


def sampled(rows: DataFrame, sample: int, seed: int = 3) -> np.ndarray:
    """Unit vectors of the ``sample`` rows with the least hashes."""
    part = hashed_sample(rows.where("vector is not null"), F.xxhash64("id", F.lit(seed)), sample, "id").select("vector").toPandas()
    return _unit(_matrix(part["vector"].to_numpy())) if len(part) else np.zeros((0, 1))


def fit_cells(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres (unit length) of at most ``cells`` cells of sampled unit vectors."""
    if not len(x):
        return np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[at : at + 4096] @ c.T, axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(c)) > 0
        c = np.where(filled[:, None], _unit(sums), c)
    return c


def choose_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float = 0.97, asked: int = 200) -> int:
    """Least number of nearest cells that hold this share of the k nearest sampled rows of ``asked`` of them.

    The rows of a sample lie further apart than all rows do, so the recall over all rows is rather greater.
    """
    if not len(x):
        return 1
    q = x[: min(asked, len(x))]
    own = np.concatenate([np.argmax(x[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(x), 4096)])
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(place, own[near], 1).reshape(-1))
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1


def assign_cells(rows: DataFrame, centres: np.ndarray, nearest: int = 1) -> DataFrame:
    """Rows (id, vector, cell) with the ``nearest`` cells of each."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(shared.value):
                order = np.argsort(-(_unit(_matrix(pdf["vector"].to_numpy())) @ shared.value.T), axis=1, kind="stable")[:, :nearest]
                yield pd.DataFrame({"id": pdf["id"], "vector": pdf["vector"], "cell": list(order.astype(np.int32))})

    return (
        rows.where("vector is not null")
        .select("id", "vector")
        .mapInPandas(run, "id long, vector array<float>, cell array<int>")
        .withColumn("cell", F.explode("cell"))
    )


def inverted_file_top(queries: DataFrame, rows: DataFrame, k: int = 10, cells: int | None = None, probes: int | None = None, recall: float = 0.97) -> DataFrame:
    """Approximate rows (query_id, chunk_id, score, rank): every row is indexed, the ``probes`` nearest cells are searched.

    The number of cells grows with the square root of the rows, and the number
    of probes is the least that reaches ``recall`` on the sample, unless they are
    given.  Rows are moved once, to their cell; a cell with many rows is split by
    salt, one that many queries ask is read by several slices of them.
    """
    rows = rows.where("vector is not null").select("id", "vector")
    cells = cells or cells_of(rows.count())
    x = sampled(rows, max(SAMPLE, 40 * cells))
    centres = fit_cells(x, cells)
    probes = probes or choose_probes(x, centres, k, recall)
    indexed = materialise(assign_cells(rows, centres), "cells")
    asked = materialise(assign_cells(queries, centres, probes), "probes")
    held = indexed.groupBy("cell").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("salts"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("slices"))
    # One row for each cell, MOST_CELLS at most unless more are asked for, so it may be broadcast.
    table = F.broadcast(held.join(wanted, "cell"))
    r = indexed.join(table, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    r = r.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("salts", "slices")
    q = asked.join(table, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "slices")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "chunk_id": [], "score": []}).astype({"query_id": "int64", "chunk_id": "int64", "score": "float64"})
        if not len(left) or not len(right):
            return empty
        return pd.concat([empty, *_found(left["id"].to_numpy(np.int64), _unit(_matrix(left["vector"].to_numpy())), iter([right]), k)])

    found = (
        q.groupBy("cell", "salt", "slice")
        .cogroup(r.groupBy("cell", "salt", "slice"))
        .applyInPandas(meet, "query_id long, chunk_id long, score double")
    )
    return ranked(found, k)


def retrieval_recall(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact ranking's rows that the approximate one has."""
    both = exact.select("query_id", "chunk_id").join(approximate.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return both.count() / max(1, exact.count())


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key does not come in, and the incoming ones."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key, the last delivered."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(by, *(c for c in others if c != by))).alias("_row")).select(key, *(F.col(f"_row.`{c}`") for c in others))
