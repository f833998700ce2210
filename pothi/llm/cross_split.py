"""Same or near-same records across splits, by minwise hashing.

Every record becomes a bag of words (``shingles``); equal bags on the same side
of the split are one class and are compared once.  Minwise hashes of the bag
are banded, and only buckets that hold both a training and an evaluation record
give candidates.

A bucket entry carries the number of its words and bit maps of them, so that a
bucket tells by itself which of its pairs cannot reach the threshold: a bit that
only one of two records sets stands for a word that the other lacks.  The test
is exact, so no pair alike is lost, and what leaves the buckets grows with the
pairs that are found and not with the square of a bucket.  Buckets are sorted
and streamed; one beyond ``STREAMED`` entries is cut into blocks, whose
pairs are met in many tasks.

Each candidate is verified by the exact Jaccard similarity of the bags (the
share of common words 0.8 is Jaccard 2/3).  Confirmed pairs are counted by
split and source.

Defined results: null questions and answers are empty; a record without words
is like no other; rows with a null key or a null split are left out; repeated
rows of a key count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pothi.llm.near_duplicates import mix
from pothi.llm.shingles import bags, dice
from pothi.plans.store import materialise

#: Entries of a bucket that one task compares; larger buckets are cut into blocks of ``BLOCK`` entries over ``CELLS`` cells.
STREAMED, BLOCK, CELLS = 4096, 2048, 16
#: Pairs of entries compared at once.
_AT_ONCE = 1 << 20
#: Bits of a tag for the number of words; a larger number is not used to exclude anything.
_SIZE_BITS = 16
_MOST_WORDS = (1 << _SIZE_BITS) - 1
_MAP_BITS = 63 - _SIZE_BITS


@dataclass(frozen=True)
class MinwiseBands:
    """A pair at the threshold J = 2/3 is missed with probability (1 - J^rows)^bands."""

    bands: int = 48
    rows: int = 5
    seed: int = 77_003

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, n, dtype=np.uint64)


def minwise(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minwise hashes of one set of 64-bit words: the upper half of multiply-and-add, least over the set."""
    return ((words.view(np.uint64)[:, None] * a + b) >> np.uint64(32)).min(axis=0)


#: Bits of the maps of an entry; the last map shares its word with the number of words and the side.
MAPS = (64, 64, _MAP_BITS)


def sketches(words: list[np.ndarray], held_out: np.ndarray) -> np.ndarray:
    """Words of bits for each set, a row each: bit maps, the last of which also holds the number of words and, as its sign, the side."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = mix(np.concatenate(words).view(np.uint64))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    slot = (flat >> np.uint64(8)) % np.uint64(sum(MAPS))
    out = np.zeros((len(words), len(MAPS)), np.uint64)
    begin = 0
    for j, width in enumerate(MAPS):
        inside = (slot >= begin) & (slot < begin + width)
        bit = np.uint64(1) << np.where(inside, slot - np.uint64(begin), np.uint64(0))
        out[:, j] = np.bitwise_or.reduceat(np.where(inside, bit, np.uint64(0)), starts)
        begin += width
    n = np.minimum(sizes, _MOST_WORDS).astype(np.uint64)
    out[:, -1] |= (n << np.uint64(_MAP_BITS)) | (held_out.astype(np.uint64) << np.uint64(63))
    return out.view(np.int64)


def may_be_alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the similarity of two sketched records (rows of unsigned words) may reach ``least``; never false for a pair that does."""
    low = np.uint64((1 << _MAP_BITS) - 1)
    n, o = (((m[:, -1] >> np.uint64(_MAP_BITS)) & np.uint64(_MOST_WORDS)).astype(np.int64) for m in (x, y))
    alone, other = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for j in range(len(MAPS)):
        mask = low if j == len(MAPS) - 1 else ~np.uint64(0)
        alone += np.bitwise_count(x[:, j] & ~y[:, j] & mask)
        other += np.bitwise_count(y[:, j] & ~x[:, j] & mask)
    known = (n < _MOST_WORDS) & (o < _MOST_WORDS)
    return ~known | (2 * np.minimum(n - alone, o - other) >= least * (n + o) - 1e-9)


_SKETCH = [f"m{j}" for j in range(len(MAPS))]
ENTRY = ", ".join(f"{c} long" for c in ("key", "id", *_SKETCH))
#: Bytes of a packed entry (id and sketch).
_PACKED = 8 * (1 + len(MAPS))


def _entries(bands: MinwiseBands):
    """Bucket entries of the bands of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = bands.coefficients()
        salt = mix(np.arange(bands.bands, dtype=np.uint64) + np.uint64(bands.seed))
        for whole in batches:
            for at in range(0, len(whole), 2048):
                pdf = whole.iloc[at : at + 2048]
                words = [np.asarray(w, np.int64) for w in pdf["words"]]
                hashes = np.stack([minwise(w, a, b) for w in words]).reshape(len(pdf), bands.bands, bands.rows)
                key = np.broadcast_to(salt, hashes.shape[:2]).copy()
                for r in range(bands.rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[:, :, r])
                maps = sketches(words, ~pdf["train"].to_numpy(bool))
                yield pd.DataFrame(
                    {"key": key.view(np.int64).reshape(-1)}
                    | {c: np.repeat(v, bands.bands) for c, v in (("id", pdf["id"].to_numpy(np.int64)), *zip(_SKETCH, maps.T, strict=True))}
                )

    return run


def _compare(e: np.ndarray, t: np.ndarray, sides: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs of ids, out of pairs of rows (e, t) of entries (id, sketch), that may be alike."""
    for at in range(0, len(e), _AT_ONCE):
        x, y = sides[e[at : at + _AT_ONCE]], sides[t[at : at + _AT_ONCE]]
        kept = may_be_alike(x[:, 1:].view(np.uint64), y[:, 1:].view(np.uint64), least)
        if kept.any():
            yield np.stack([x[kept, 0], y[kept, 0]], axis=1)


def _pairs_of_runs(key: np.ndarray, rows: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Candidates of whole buckets; entries are sorted by key, held-out ones first."""
    held = rows[:, -1] < 0
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[begin, len(key)])
    n_held = np.add.reduceat(held.astype(np.int64), begin)
    both = (n_held > 0) & (n_held < length)
    begin, length, n_held = begin[both], length[both], n_held[both]
    n_pairs = n_held * (length - n_held)
    # Buckets are taken together up to a number of pairs; one bucket has no more than STREAMED plus a batch of entries.
    group = np.cumsum(n_pairs) // _AT_ONCE
    for g in np.unique(group):
        take = group == g
        b, h, k = begin[take], n_held[take], n_pairs[take]
        owner = np.repeat(np.arange(len(b)), k)
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        width = h[owner]
        yield from _compare(b[owner] + within % width, b[owner] + width + within // width, rows, least)


def _buckets(least: float):
    """Candidates (e, t) of buckets up to ``STREAMED`` entries; larger ones go on as packed blocks (key, train, cell, data)."""

    def blocks(key: int, rows: np.ndarray, number: int) -> list[tuple]:
        out = []
        for train in (False, True):
            side = rows[(rows[:, -1] >= 0) == train]
            for at in range(0, len(side), BLOCK):
                out.append((None, None, int(key), train, (number + len(out)) % CELLS, side[at : at + BLOCK].tobytes()))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["e", "t", "key", "train", "cell", "data"]
        rest_key, rest = np.zeros(0, np.int64), np.zeros((0, 1 + len(MAPS)), np.int64)
        large, number = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            key = np.r_[rest_key, pdf["key"].to_numpy(np.int64)]
            rows = np.vstack([rest, pdf[["id", *_SKETCH]].to_numpy(np.int64)])
            rest_key, rest = key[:0], rows[:0]
            last = int(np.searchsorted(key, key[-1]))
            packed: list[tuple] = []
            if large is not None:
                end = int(np.searchsorted(key, large, side="right"))
                packed += blocks(large, rows[:end], number)
                key, rows, last = key[end:], rows[end:], max(last - end, 0)
                if len(key):
                    large = None
            if len(key) - last > STREAMED:
                large = int(key[-1])
                packed += blocks(large, rows[last:], number + len(packed))
            else:
                rest_key, rest = key[last:], rows[last:]
            number += len(packed)
            if packed:
                yield pd.DataFrame(packed, columns=columns)
            if last:
                for found in _pairs_of_runs(key[:last], rows[:last], least):
                    yield pd.DataFrame({"e": found[:, 0], "t": found[:, 1]}).reindex(columns=columns)
        if len(rest_key):
            for found in _pairs_of_runs(rest_key, rest, least):
                yield pd.DataFrame({"e": found[:, 0], "t": found[:, 1]}).reindex(columns=columns)

    return run


def _block_pairs(least: float):
    """Candidates of pairs of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["held"], pdf["trained"], strict=True):
                rows = np.frombuffer(x + y, np.int64).reshape(-1, 1 + len(MAPS))
                h, n = len(x) // _PACKED, len(y) // _PACKED
                for at in range(0, h, max(1, _AT_ONCE // n)):
                    some = np.arange(at, min(h, at + max(1, _AT_ONCE // n)))
                    for found in _compare(np.repeat(some, n), np.tile(np.arange(h, h + n), len(some)), rows, least):
                        yield pd.DataFrame({"e": found[:, 0], "t": found[:, 1]})

    return run


def bucket_candidates(sides: DataFrame, least: float, bands: MinwiseBands) -> DataFrame:
    """Distinct pairs (e, t) of a held-out and a training record that share a bucket and may be alike, from rows (id, train, words)."""
    sorted_buckets = sides.select("id", "train", "words").mapInPandas(_entries(bands), ENTRY).repartition("key").sortWithinPartitions("key", _SKETCH[-1])
    met = materialise(sorted_buckets.mapInPandas(_buckets(least), "e long, t long, key long, train boolean, cell int, data binary"), "buckets")
    blocks = met.where("data is not null")
    held = blocks.where("not train").select("key", F.col("data").alias("held"), F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    crossed = held.join(blocks.where("train").select("key", "cell", F.col("data").alias("trained")), ["key", "cell"])
    return (
        met.where("e is not null").select("e", "t").union(crossed.select("held", "trained").mapInPandas(_block_pairs(least), "e long, t long")).distinct()
    )


def _classes(df: DataFrame, key: str, question: str, answer: str, split: str, train: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bags of the rows, members (id, bag, split, train), and classes (bag, train, rep, copies) named by their least ids."""
    prepared = bags(df.where(F.col(f"`{split}`").isNotNull()), key, question, answer, {split: T.StringType()})
    prepared = materialise(prepared.where("n > 0").select("id", "bag", "words", F.col(f"`{split}`").alias("split")), "bags")
    # Of unequal rows of one key the least bag counts.
    members = prepared.groupBy("id").agg(F.min(F.struct("bag", "split")).alias("m")).select("id", "m.bag", "m.split", (F.col("m.split") == train).alias("train"))
    members = materialise(members, "members")
    return prepared, members, members.groupBy("bag", "train").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def _links(
    df: DataFrame, key: str, question: str, answer: str, split: str, train: str, least: float, bands: MinwiseBands
) -> tuple[DataFrame, DataFrame]:
    """Links (e, t, similarity) of classes, named by their least ids, and members (rep, id, train, split, copies)."""
    prepared, members, classes = _classes(df, key, question, answer, split, train)
    # A row that is delivered twice is met twice here; its candidates and links are the same and count once.
    words = prepared.select("id", "bag", "words")
    sides = words.join(classes.select(F.col("rep").alias("id"), "bag", "train"), ["id", "bag"]).select("id", "train", "words")
    candidates = materialise(bucket_candidates(sides, least, bands), "candidates")
    asked = candidates.select(F.col("e").alias("id")).union(candidates.select(F.col("t").alias("id"))).distinct()
    asked = materialise(words.join(asked, "id").groupBy("id").agg(F.min(F.struct("bag", "words")).alias("w")).select("id", "w.words"), "asked")
    links = (
        candidates.join(asked.withColumnsRenamed({"id": "e", "words": "a_words"}), "e")
        .join(asked.withColumnsRenamed({"id": "t", "words": "b_words"}), "t")
        .select("e", "t", dice().alias("similarity"))
        .where(F.col("similarity") >= least)
    )
    copied = members.join(classes, ["bag", "train"])
    return materialise(links, "links"), materialise(copied.select("rep", "id", "train", "split", "copies"), "copied")


def cross_split_classes(
    df: DataFrame, key: str = "pair_id", question: str = "question", answer: str = "answer", split: str = "split", train: str = "train"
) -> DataFrame:
    """One row (id, class_id, split, copies) for each key with words and a split.

    ``class_id`` is the least id among the exact copies on the same side of the
    split (in train or not), ``copies`` their number.
    """
    _, members, classes = _classes(df, key, question, answer, split, train)
    return members.join(classes, ["bag", "train"]).select("id", F.col("rep").alias("class_id"), "split", "copies")


def cross_split_pairs(
    df: DataFrame,
    key: str = "pair_id",
    question: str = "question",
    answer: str = "answer",
    split: str = "split",
    train: str = "train",
    least: float = 0.8,
    bands: MinwiseBands | None = None,
    copies_listed: int = 1000,
) -> DataFrame:
    """Pairs (a, b, similarity, split, a < b) of which exactly one stands in train; ``split`` is that of the other.

    A class of more than ``copies_listed`` copies on one side is not expanded
    into all pairs: its least id stands for it, and each of its other copies is
    linked to the least id of every class that is like it on the other side.
    """
    links, copied = _links(df, key, question, answer, split, train, least, bands or MinwiseBands())
    listed = (F.col("copies") <= copies_listed) | (F.col("id") == F.col("rep"))
    held = copied.where(~F.col("train")).select(F.col("rep").alias("e"), F.col("id").alias("x"), "split", listed.alias("x_listed"))
    trained = copied.where("train").select(F.col("rep").alias("t"), F.col("id").alias("y"), listed.alias("y_listed"))
    # Copies of a large class meet the other side by its least id only.
    every = links.join(held.where("x_listed"), "e").join(trained.where("y_listed"), "t").select("x", "y", "similarity", "split")
    held_out = links.join(held.where(~F.col("x_listed")), "e").select("x", F.col("t").alias("y"), "similarity", "split")
    in_train = (
        links.join(trained.where(~F.col("y_listed")), "t")
        .join(held.where(F.col("x") == F.col("e")), "e")
        .select("x", "y", "similarity", "split")
    )
    return every.union(held_out).union(in_train).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity", "split", F.col("x").alias("held_out")
    )


def overlap_report(
    df: DataFrame,
    key: str = "pair_id",
    question: str = "question",
    answer: str = "answer",
    split: str = "split",
    source: str = "source",
    train: str = "train",
    least: float = 0.8,
    bands: MinwiseBands | None = None,
) -> DataFrame:
    """Counts of overlapping pairs and held-out records by split and source of the held-out record; a null source is its own group.

    Counted from the membership of classes, so no class is too large to count.
    """
    links, copied = _links(df, key, question, answer, split, train, least, bands or MinwiseBands())
    sizes = copied.where(F.col("train") & (F.col("id") == F.col("rep"))).select(F.col("rep").alias("t"), "copies")
    partners = (
        links.join(sizes, "t")
        .groupBy(F.col("e").alias("rep"))
        .agg(F.sum("copies").alias("pairs"), F.sum(F.when(F.col("similarity") == 1.0, F.col("copies")).otherwise(0)).alias("exact_pairs"))
    )
    origin = df.groupBy(F.col(f"`{key}`").cast("bigint").alias("id")).agg(F.min(F.col(f"`{source}`")).alias("source"))
    return (
        copied.where(~F.col("train"))
        .select("rep", "id", "split")
        .join(partners, "rep")
        .join(origin, "id")
        .groupBy("split", "source")
        .agg(F.sum("pairs").alias("pairs"), F.count("*").alias("records"), F.sum("exact_pairs").alias("exact_pairs"))
    )
