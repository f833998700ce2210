"""Near-duplicate records with small edits, by one-permutation hashing.

1. Each record becomes a bag of words (``shingles``); records with equal bags
   form a class, and only its representative goes on.
2. One hash of every word fills the bins of one permutation; an empty bin
   borrows from a filled one chosen by its own hash sequence (optimal
   densification), so that each bin agrees with probability J.
3. Bins are banded.  Records sharing a band share a bucket, and a bucket gives
   a star: its record with the least hash is the hub, and the edges join it to
   the others, so a bucket of m records costs m - 1 candidates.  Stars are first
   built inside each batch and only their hubs are shuffled, so a bucket that
   holds a third of all rows reaches a reducer as one row per batch.
4. Candidates are verified exactly.  Where one of two alike records of a bucket
   lies within t = 1/3 of the hub, the other lies, by the triangle inequality of
   the Jaccard distance, within 2t, so these pairs are searched between the near
   and the half-near neighbours of a hub.  The records of a bucket beyond t of
   its hub are compared with each other.  All of these pairs are verified too.

Copies (equal bags) count as pairs as well.  A class of more than
``copies_listed`` copies is linked to its representative (its least id) and
not expanded: its membership is what ``near_duplicate_groups`` returns.

Defined results: null questions and answers are empty; a record without words
is like no other; rows with a null key are left out; repeated rows of a key
count once (they carry equal content; of unequal ones the bag with the least
digest counts); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.shingles import bags, dice
from pothi.plans.store import materialise


@dataclass(frozen=True)
class Banding:
    """Bands of rows: a pair at the threshold J = 2/3 is missed with probability (1 - J^rows)^bands."""

    bands: int = 48
    rows: int = 5
    #: bands share bins: bins = bands * rows
    seed: int = 20_240_501

    @property
    def bins(self) -> int:
        return self.bands * self.rows


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; products wrap around."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probes(banding: Banding, tries: int) -> np.ndarray:
    """For every bin, the sequence of bins that it borrows from."""
    at = np.arange(banding.bins * tries, dtype=np.uint64) + np.uint64(banding.seed)
    return (mix(at * _MIX) % np.uint64(banding.bins)).astype(np.int32).reshape(banding.bins, tries)


def one_permutation(word_lists: list[np.ndarray], banding: Banding) -> np.ndarray:
    """Densified signatures, a row of ``bins`` values for each list of word hashes (none may be empty)."""
    k, n = banding.bins, len(word_lists)
    sizes = np.fromiter(map(len, word_lists), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    value = mix(np.concatenate(word_lists).view(np.uint64) + np.uint64(banding.seed))
    cell = owner * k + (value % np.uint64(k)).astype(np.int64)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.r_[True, cell[1:] != cell[:-1]]
    table = np.zeros(n * k, np.uint64)
    filled = np.zeros(n * k, bool)
    table[cell[first]] = value[first]
    filled[cell[first]] = True
    filled = filled.reshape(n, k)
    table = table.reshape(n, k)
    out = table.copy()
    empty_row, empty_bin = np.nonzero(~filled)
    tries = 64
    probes = _probes(banding, tries)
    for t in range(tries):
        if not len(empty_row):
            break
        source = probes[empty_bin, t]
        ok = filled[empty_row, source]
        # The bin is mixed in, so that two bins that borrow the same value differ by nothing but it.
        out[empty_row[ok], empty_bin[ok]] = table[empty_row[ok], source[ok]]
        empty_row, empty_bin = empty_row[~ok], empty_bin[~ok]
    for r, b in zip(empty_row, empty_bin, strict=True):
        own = np.nonzero(filled[r])[0]
        out[r, b] = table[r, own[probes[b, 0] % len(own)]]
    return out


def band_keys(signatures: np.ndarray, banding: Banding) -> np.ndarray:
    """One 64-bit bucket key for each band; the number of the band is part of it."""
    parts = signatures.reshape(len(signatures), banding.bands, banding.rows)
    key = np.broadcast_to(mix(np.arange(banding.bands, dtype=np.uint64) + _MIX), parts.shape[:2]).copy()
    for r in range(banding.rows):
        key = mix(key * _MIX + parts[:, :, r])
    return key.view(np.int64)


def _priority(ids: np.ndarray, seed: int) -> np.ndarray:
    """Random order in which records become hubs, the same in every bucket and batch."""
    return mix(ids.astype(np.int64).view(np.uint64) * _MIX + np.uint64(seed)).view(np.int64)


def _local_stars(banding: Banding):
    """Band keys of a batch; buckets inside the batch become stars at once, and only hubs keep their key.

    Rows are bucket entries (key, hub, its priority) or local edges (key, hub, other).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["id"].to_numpy(np.int64)
            priority = _priority(ids, banding.seed)
            order = np.argsort(priority, kind="stable")
            ids, priority = ids[order], priority[order]
            lists = [np.asarray(w, np.int64) for w in pdf["words"].to_numpy()[order]]
            keys = band_keys(one_permutation(lists, banding), banding)
            flat = keys.T.reshape(-1)
            rank = np.tile(np.arange(len(ids)), banding.bands)
            by_key = np.lexsort((rank, flat))
            flat, rank = flat[by_key], rank[by_key]
            head = np.r_[True, flat[1:] != flat[:-1]]
            hub = rank[np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
            yield pd.DataFrame({"key": flat[head], "hub": ids[rank[head]], "other": priority[rank[head]], "local": False})
            if not head.all():
                yield pd.DataFrame({"key": flat[~head], "hub": ids[hub[~head]], "other": ids[rank[~head]], "local": True})

    return run


def _stream_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars over rows sorted by bucket and priority; only the current hub is kept in memory."""
    last_key, last_hub = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy(np.int64)
        ids = pdf["hub"].to_numpy(np.int64)
        head = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(head, np.arange(len(ids)), -1))
        hub = np.where(at >= 0, ids[at], last_hub)
        last_key, last_hub = key[-1], hub[-1]
        away = hub != ids
        if away.any():
            yield pd.DataFrame({"key": key[away], "hub": hub[away], "other": ids[away]})


def stars(representatives: DataFrame, banding: Banding) -> DataFrame:
    """Every record that shares a bucket with the bucket's hub, as rows (key, hub, other), from rows (id, words)."""
    built = materialise(
        representatives.select("id", "words").mapInPandas(
            _local_stars(banding), "key long, hub long, other long, local boolean"
        ),
        "bands",
    )
    shuffled = (
        built.where(~F.col("local"))
        .select("key", "hub", "other")
        .repartition("key")
        .sortWithinPartitions("key", "other")
        .mapInPandas(_stream_stars, "key long, hub long, other long")
    )
    shuffled = materialise(shuffled, "hubs")
    # A record that a batch tied to its own hub belongs to the hub of that hub in the same bucket.
    lifted = (
        built.where("local")
        .select("key", F.col("hub").alias("own"), "other")
        .join(shuffled.withColumnRenamed("other", "own"), ["key", "own"], "left")
        .select("key", F.coalesce("hub", "own").alias("hub"), "other")
    )
    return materialise(shuffled.union(lifted), "entries")


#: Number of 64-bit maps of the words of a record.
MAPS = 4


def word_maps(words: str) -> dict[str, F.Column]:
    """Bit maps of the words of a record: each word sets one of 64 bits of one of the maps."""
    one = F.lit(1).cast("long")

    def bits(j: int) -> F.Column:
        def add(s: F.Column, w: F.Column) -> F.Column:
            return F.when(F.shiftright(w, 6).bitwiseAND(MAPS - 1) == j, s.bitwiseOR(F.call_function("shiftleft", one, w.bitwiseAND(63).cast("int")))).otherwise(s)

        return F.aggregate(words, F.lit(0).cast("long"), add)

    return {f"map{j}": bits(j) for j in range(MAPS)}


#: Members of a group of which one cell of pairs holds about so many.
CELL = 256


def group_pairs(members: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of the members of each group whose similarity may reach ``least``.

    Rows are (kind, key, x, near, dx, n, maps): ``key`` names a hub, whose pairs
    need one member near it, or a bucket, all of whose members are far from its
    hub.  All tests are exact, so no pair is lost: the distances to the hub of two
    records alike differ by t at most, and a bit that only one of two records
    sets stands for a word that the other lacks.  What leaves a group therefore
    follows the pairs alike in it.  Large groups are split into cells, so that
    their pairs are met in many tasks.
    """
    t = 1 - least / (2 - least)
    maps = [f"map{j}" for j in range(MAPS)]
    several = members.groupBy("kind", "key").agg(F.count("*").alias("m"), F.max("near").alias("some")).where("m > 1 and (some or kind = 'bucket')")
    cells = materialise(
        members.join(several, ["kind", "key"])
        .withColumn("cells", F.ceil(F.col("m") / CELL))
        .withColumn("cell", F.pmod(F.xxhash64("x"), F.col("cells")))
        .drop("m", "some"),
        "cells",
    )
    left = cells.withColumn("other", F.explode(F.sequence("cell", F.col("cells") - 1))).drop("cells")
    right = cells.drop("cells").withColumnsRenamed({"x": "y", "dx": "dy", "n": "ny", "near": "neary", "cell": "other"} | {c: f"{c}y" for c in maps})

    def alone(one: str, other: str) -> F.Column:
        return sum((F.bit_count(F.col(c + one).bitwiseAND(F.bitwise_not(c + other))) for c in maps), F.lit(0))

    common = F.least(F.col("n") - alone("", "y"), F.col("ny") - alone("y", ""))
    return (
        left.join(right, ["kind", "key", "other"])
        .where((F.col("cell") < F.col("other")) | (F.col("x") < F.col("y")))
        .where((F.col("kind") == "bucket") | F.col("near") | F.col("neary"))
        .where(F.abs(F.col("dx") - F.col("dy")) <= t + 1e-9)
        .where(2 * common >= least * (F.col("n") + F.col("ny")) - 1e-9)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def with_words(pairs: DataFrame, representatives: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the word arrays of both ends."""
    words = representatives.select("id", "words")
    return pairs.join(words.withColumnsRenamed({"id": a, "words": "a_words"}), a).join(
        words.withColumnsRenamed({"id": b, "words": "b_words"}), b
    )


def classes(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, bag) and representatives (id, bag, words, copies); a representative has the least id of its class."""
    # A key that is delivered twice with unequal content counts with its least bag.
    members = prepared.groupBy("id").agg(F.min(F.struct("bag", "words")).alias("m")).select("id", "m.bag", "m.words")
    members = materialise(members.where(F.size("words") > 0), "members")
    representatives = members.groupBy("bag").agg(
        F.min_by(F.struct("id", "words"), "id").alias("r"), F.count("*").alias("copies")
    )
    return members.select("id", "bag"), representatives.select("r.id", "bag", "r.words", "copies", *(c.alias(n) for n, c in word_maps("r.words").items()))


def similar_representatives(representatives: DataFrame, least: float, banding: Banding) -> DataFrame:
    """All pairs (a, b, similarity) of representatives with similarity of ``least`` or more, a < b."""
    t = 1 - least / (2 - least)  # distance of Jaccard at the threshold
    entries = stars(representatives, banding)
    maps = [f"map{j}" for j in range(MAPS)]
    measured = materialise(
        entries.select("hub", "other").distinct()
        .join(representatives.select(F.col("id").alias("hub"), F.col("words").alias("a_words")), "hub")
        .join(representatives.select(F.col("id").alias("other"), F.col("words").alias("b_words"), *maps), "other")
        .select("hub", "other", dice().alias("similarity"), F.size("b_words").alias("n"), *maps)
        .withColumn("distance", 1 - F.col("similarity") / (2 - F.col("similarity"))),
        "stars",
    )
    scored = measured.where(F.col("distance") <= 2 * t + 1e-9)
    ordered = scored.where(F.col("similarity") >= least).select(
        F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "similarity"
    )
    near = F.col("distance") <= t + 1e-9
    columns = [F.col("other").alias("x"), near.alias("near"), F.col("distance").alias("dx"), "n", *maps]
    around = scored.select(F.lit("hub").alias("kind"), F.col("hub").alias("key"), *columns)
    far = entries.join(measured.where(~near), ["hub", "other"]).select(F.lit("bucket").alias("kind"), "key", *columns)
    # Pairs around one hub of which one or both are near it, and the pairs of those in a bucket that are not.
    open_pairs = group_pairs(around.union(far), least).join(ordered.select("a", "b"), ["a", "b"], "left_anti")
    closed = with_words(open_pairs, representatives, "a", "b").select("a", "b", dice().alias("similarity"))
    return ordered.union(closed.where(F.col("similarity") >= least)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def expand_copies(links: DataFrame, members: DataFrame, representatives: DataFrame, copies_listed: int) -> DataFrame:
    """Pairs of ids (a < b) from links of representatives and from classes of copies."""
    several = representatives.where("copies > 1").select("bag", F.col("id").alias("rep"), "copies")
    # Members that stand for their class: all of a small class, the representative of a large one.
    copied = members.join(several, "bag").select("rep", "id", "copies")
    listed = copied.where((F.col("copies") <= copies_listed) | (F.col("id") == F.col("rep")))
    large = copied.where((F.col("copies") > copies_listed) & (F.col("id") != F.col("rep")))
    inside = (
        listed.alias("l")
        .join(listed.alias("r"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.id") < F.col("r.id")))
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        .union(large.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    )
    stand = listed.select("rep", "id")
    across = (
        links.select("a", "b")
        .join(stand.withColumnsRenamed({"rep": "a", "id": "ida"}), "a", "left")
        .join(stand.withColumnsRenamed({"rep": "b", "id": "idb"}), "b", "left")
        .select(F.coalesce("ida", "a").alias("x"), F.coalesce("idb", "b").alias("y"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return inside.union(across)


def near_duplicate_pairs(
    df: DataFrame,
    key: str = "pair_id",
    question: str = "question",
    answer: str = "answer",
    least: float = 0.8,
    banding: Banding | None = None,
    copies_listed: int = 1000,
) -> DataFrame:
    """All pairs (a, b) of keys whose similarity is at least ``least``, a < b, each once."""
    members, representatives = classes(bags(df, key, question, answer))
    representatives = materialise(representatives, "representatives")
    links = similar_representatives(representatives, least, banding or Banding())
    return expand_copies(links, members, representatives, copies_listed)


def near_duplicate_groups(
    df: DataFrame,
    key: str = "pair_id",
    question: str = "question",
    answer: str = "answer",
    least: float = 0.8,
    banding: Banding | None = None,
) -> DataFrame:
    """One row (id, class_id, group_id, links) for each key with words.

    ``class_id`` is the least id among the exact copies, ``group_id`` the least
    class id of all records linked directly or through others, ``links`` the
    number of classes that are like the record's own.
    """
    members, representatives = classes(bags(df, key, question, answer))
    representatives = materialise(representatives, "representatives")
    links = materialise(
        similar_representatives(representatives, least, banding or Banding()).select("a", "b"), "links"
    )
    both = links.union(links.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    group = connected(links)
    return (
        members.join(representatives.select("bag", F.col("id").alias("class_id")), "bag")
        .join(group.withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(degree, "class_id", "left")
        .select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of edges (a, b); the component is its least node.

    Large-star and small-star rounds: each round ties the neighbours of a node
    to the least of them, so chains shorten geometrically and the number of
    edges never grows.  Every round is written to the shared folder.
    """
    edges = edges.select("a", "b").where("a != b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        sides = edges.union(edges.select("b", "a"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = materialise(small.where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b")
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = now
