"""Stratified and simple samples that are the same on every run.

Random order is the order of a hash of the id and a seed.  Within a stratum the
hash is cut into buckets that are counted first, so that no stratum is sorted
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def log_allocation(df: DataFrame, strata: list[str], total: int) -> DataFrame:
    """Rows (strata, size, allocation): shares by log(1 + size), at least one, at most the size.

    Strata that come later in order give way when the shares exceed the total;
    when the total reaches the number of rows, every stratum is taken whole.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    # Strata are combinations of a few categories, so their table is small; its sums are windows over it.
    everything = Window.partitionBy()
    share = F.lit(total) * F.log1p("size") / F.sum(F.log1p("size")).over(everything)
    wanted = F.least(F.col("size"), F.greatest(F.lit(1), F.bround(share).cast("bigint")))
    sizes = sizes.withColumn("_rows", F.sum("size").over(everything)).withColumn("_wanted", wanted)
    earlier = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum("_wanted").over(earlier), F.lit(0))
    allocation = F.when(F.col("_rows") <= total, F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("_wanted"), left)))
    return sizes.select(*strata, "size", allocation.cast("bigint").alias("allocation"))


def arithmetic_order(c: Column) -> Column:
    """Pseudo-random order of ids by arithmetic that any engine has."""
    return F.pmod(c.cast("bigint") * 7919 + 104729, F.lit(1_000_003))


def stratified_sample(df: DataFrame, key: str, strata: list[str], total: int, order: Column | None = None) -> DataFrame:
    """Rows of ``df`` (distinct keys) by logarithmic allocation; null strata are strata of their own."""
    order = order if order is not None else F.xxhash64(F.col(f"`{key}`"))
    ordered = df.withColumn("_order", order).withColumn("_bucket", F.pmod("_order", F.lit(BUCKETS)))
    sizes = log_allocation(df, strata, total)
    names = [F.col(f"`{s}`") for s in strata]
    counts = ordered.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    ranked = ordered.withColumn("_rank", F.row_number().over(Window.partitionBy(*names, "_bucket").orderBy("_order", key)))

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for s in strata:
            out = out & F.col(f"{a}.`{s}`").eqNullSafe(F.col(f"{b}.`{s}`"))
        return out

    placed = ranked.alias("r").join(offsets.alias("o"), same("r", "o") & (F.col("r._bucket") == F.col("o._bucket")))
    placed = placed.select("r.*", (F.col("o._before") + F.col("r._rank")).alias("_place"))
    joined = placed.alias("p").join(sizes.alias("s"), same("p", "s"))
    return joined.where(F.col("p._place") <= F.col("s.allocation")).select(*(F.col(f"p.`{c}`") for c in df.columns))


def hashed_sample(df: DataFrame, order: Column, size: int, *ties: str) -> DataFrame:
    """The ``size`` rows with the least hashes.

    A threshold on the hash, from the number of rows, lets about twice as many
    rows pass, so that what is sorted does not grow with the table.
    """
    n = df.count()
    if n > 4 * size:
        space = 1 << 30
        df = df.where(F.pmod(order, F.lit(space)) < F.lit(int(space * 2 * size / n)))
        order = F.pmod(order, F.lit(space))
    return df.orderBy(order, *ties).limit(size)


def gold_sample(df: DataFrame, key: str, size: int = 200, order: Column | None = None) -> DataFrame:
    """A simple random sample of ``size`` rows."""
    return df.orderBy(order if order is not None else F.xxhash64(F.col(f"`{key}`")), key).limit(size)


def training_rest(df: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """The rows that the gold sample leaves for training."""
    return df.join(gold.select(key), key, "left_anti")


def day_slice(df: DataFrame, key: str, day: int, size: int) -> DataFrame:
    """Rows of one day, when consecutive ids from 0 are worked off ``size`` a day."""
    return df.where((F.col(key) >= (day - 1) * size) & (F.col(key) < day * size))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")
