"""A sample whose categories follow given proportions, by swap repair.

Records are grouped by category signature; every signature without a target
shares one pool, so the plan handles as many counts as there are targets, plus
one.  The plan starts from a random sample that satisfies the floors (drawn as
signature counts, which has the same distribution as drawing records), and
exchanges counts between signatures as long as an exchange lowers the sum of
deviations from the targets.  The counts are then materialised by random
records: those with the least hashes of each signature, found by counting hash
buckets, so that no signature is sorted in one task.

Defined results: keys delivered twice count once (of unequal contents the least
signature counts); rows with a null key are left out; null categories match
only targets that are null too; floors are met as far as records go, and when
they exceed the sample size together they are cut in proportion; an empty
table gives an empty sample and reports every target with a need as not met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pothi.plans.store import materialise

#: Records of one signature that are ranked together, about.
RANKED = 50_000


@dataclass
class Plan:
    """Counts for each target, in the order of the targets, and for the pool without target."""

    size: int
    sampled: list[int]
    pool: int
    start_deviation: float
    deviation: float


def plan_counts(available: list[int], permille: list[float], floors: list[int], pool: int, size: int, seed: int = 11) -> Plan:
    """Signature counts of the sample: random start above the floors, then exchanges."""
    k = len(available)
    have = np.array([*available, pool], np.int64)
    size = int(min(size, have.sum()))
    floor = np.minimum(np.array([*floors, 0], np.int64), have)
    if floor.sum() > size:
        floor = np.floor(floor * (size / floor.sum())).astype(np.int64)
    rng = np.random.default_rng(seed)
    rest = have - floor
    counts = floor + _draw(rng, rest, size - int(floor.sum()))
    target = np.array([*(p * size / 1000 for p in permille), 0.0])
    start = float(np.abs(counts - target).sum())
    while True:
        # Whole records above and below the targets are exchanged together.
        give = np.maximum(0, np.minimum(counts - floor, np.floor(counts - target + 1e-9).astype(np.int64)))
        take = np.maximum(0, np.minimum(have - counts, np.floor(target - counts + 1e-9).astype(np.int64)))
        a, b = int(np.argmax(give)), int(np.argmax(take))
        moved = int(min(give[a], take[b]))
        if not moved:
            a, b, moved = _best_exchange(counts, floor, have, target)
        if not moved:
            break
        counts[a] -= moved
        counts[b] += moved
    return Plan(size, counts[:k].tolist(), int(counts[k]), start, float(np.abs(counts - target).sum()))


def _best_exchange(counts: np.ndarray, floor: np.ndarray, have: np.ndarray, target: np.ndarray) -> tuple[int, int, int]:
    """The single exchange (from, to, 1) that lowers the deviation most, or no exchange."""
    now = np.abs(counts - target)
    leave = np.where(counts > floor, now - np.abs(counts - 1 - target), -np.inf)
    enter = np.where(counts < have, now - np.abs(counts + 1 - target), -np.inf)
    best = (0, 0, 0)
    gain = 1e-9
    for a in np.argsort(-leave, kind="stable")[:2]:
        for b in np.argsort(-enter, kind="stable")[:2]:
            if a != b and leave[a] + enter[b] > gain:
                gain, best = leave[a] + enter[b], (int(a), int(b), 1)
    return best


def _draw(rng: np.random.Generator, rest: np.ndarray, n: int) -> np.ndarray:
    """Random signature counts of ``n`` records, each signature in expectation by its share, none beyond what it has.

    Binomial draws one after the other, the same at every number of records; the
    exchange that follows starts from them.
    """
    out, left = np.zeros_like(rest), int(rest.sum())
    for i, r in enumerate(rest.tolist()):
        if n <= 0 or left <= 0:
            break
        got = int(rng.binomial(n, r / left))
        got = max(min(got, r), n - (left - r))
        out[i] = got
        n -= got
        left -= r
    return out


def _same(left: str, right: str, categories: list[str]):
    return reduce(lambda x, y: x & y, (F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in categories))


@dataclass
class Sampled:
    sample: DataFrame
    report: DataFrame
    plan: Plan


def sample_to_targets(
    df: DataFrame,
    targets: DataFrame,
    key: str = "pair_id",
    categories: tuple[str, ...] = ("language", "subject", "class_num"),
    share: float = 0.5,
    seed: int = 11,
) -> Sampled:
    """A sample of ``share`` of the distinct keys (rounded down) and the report of every target.

    ``targets`` has the categories, ``target_permille`` and ``min_rows``; it is
    a configuration table and is held in memory.
    """
    names = list(categories)
    wanted = targets.groupBy(*names).agg(F.max("target_permille").alias("target_permille"), F.max("min_rows").alias("min_rows"))
    wanted = wanted.orderBy(*names)
    goals = wanted.collect()
    spark = df.sparkSession
    schema = wanted.schema
    cells = spark.createDataFrame([(i, *g) for i, g in enumerate(goals)], "cell int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
    records = (
        df.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("key"))
        .agg(F.min(F.struct(*(F.col(f"`{c}`") for c in names))).alias("s"))
        .select("key", *(F.col(f"s.`{c}`").alias(c) for c in names))
    )
    # The targets fit in memory, as said above; -1 is the pool without target.
    placed = materialise(
        records.alias("r")
        .join(F.broadcast(cells).alias("c"), _same("r", "c", names), "left")
        .select("key", F.coalesce("c.cell", F.lit(-1)).alias("cell")),
        "placed",
    )
    total = dict(placed.groupBy("cell").agg(F.count("*").alias("n")).collect())
    n = sum(total.values())
    available = [total.get(i, 0) for i in range(len(goals))]
    permille = [float(g["target_permille"] or 0) for g in goals]
    floors = [int(g["min_rows"] or 0) for g in goals]
    size = math.floor(n * share)
    plan = plan_counts(available, permille, floors, total.get(-1, 0), size, seed)
    quota = {i: q for i, q in enumerate(plan.sampled)} | {-1: plan.pool}
    need = [max(f, int(p * size // 1000)) for p, f in zip(permille, floors, strict=True)]
    rows = [
        (*g, size, need[i], available[i], plan.sampled[i], available[i] >= need[i], plan.sampled[i] - p * size / 1000)
        for i, (g, p) in enumerate(zip(goals, permille, strict=True))
    ]
    report = spark.createDataFrame(
        rows,
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        + ", sample_size long, need long, available long, sampled long, can_be_met boolean, deviation double",
    )
    return Sampled(_materialise_counts(placed, quota, n, seed).withColumnRenamed("key", key), report, plan)


def _materialise_counts(placed: DataFrame, quota: dict[int, int], n: int, seed: int) -> DataFrame:
    """``quota`` random keys of each cell."""
    spark = placed.sparkSession
    buckets = max(1, math.ceil(n / RANKED))
    hashed = placed.withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)))
    wanted = spark.createDataFrame(list(quota.items()), "cell int, quota long")
    tally = hashed.groupBy("cell", "bucket").agg(F.count("*").alias("m")).join(F.broadcast(wanted), "cell")
    before = tally.select(
        "cell", "bucket", "quota",
        F.coalesce(F.sum("m").over(Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("h", "key")))
    return ranked.join(before, ["cell", "bucket"]).where(F.col("before") + F.col("rank") <= F.col("quota")).select("key")
