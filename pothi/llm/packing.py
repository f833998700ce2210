"""Filling containers of fixed capacity with texts, by dominance reduction and best fit.

Texts of equal size are interchangeable, so the packing is planned on counts of
sizes.  There are at most ``capacity`` sizes, however large the corpus is.

1. A text larger than the capacity is cut into full pieces and a rest; nothing
   else is ever split.
2. Reduction (Martello and Toth): going down from the largest size, a small set
   that provably dominates every other set with that text is fixed for good:
   the text alone when nothing fits beside it; with a text that fills the rest
   exactly; with the largest that fits when no two fit; with the two largest
   that fit when no three fit and no other pair can beat them.  Fixed sets
   leave the instance.
3. The remainder is packed by best fit in falling order of size; containers
   with equal contents are handled together.
4. Each text gets a rank among the texts of its size (hashed buckets and their
   offsets, so that no size is ranked in one task), and the plan says which
   ranks of a size go into which container.

Defined results: texts without content (null, empty, blank) have size 0 and go
into container 0; null keys are packed like others; an empty table of texts or
capacities gives an empty result; capacities that are null or below 1 are left
out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pothi.plans.configuration import each_of
from pothi.plans.store import materialise

Pattern = tuple[tuple[int, int], ...]

#: Ranks of a size that share a join key with the runs that hold them.
BLOCK = 64
#: Texts ranked in one task, about.
RANKED = 200_000


class _Sizes:
    """Sizes with counts, in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.order[bisect_left(self.order, size)]

    def largest_within(self, room: int, without: dict[int, int]) -> int | None:
        """Largest size of at most ``room`` of which there is one more than those already chosen."""
        at = bisect_right(self.order, room) - 1
        while at >= 0:
            size = self.order[at]
            if self.count[size] > without.get(size, 0):
                return size
            at -= 1
        return None

    def smallest(self, n: int, without: dict[int, int]) -> list[int]:
        """The ``n`` smallest items besides those already chosen."""
        out: list[int] = []
        for size in self.order:
            out += [size] * min(n - len(out), self.count[size] - without.get(size, 0))
            if len(out) >= n:
                break
        return out


def dominating_set(sizes: _Sizes, largest: int, capacity: int) -> list[int] | None:
    """A set with the largest size that dominates every other one, or nothing if none is proved."""
    room = capacity - largest
    used = {largest: 1}
    first = sizes.largest_within(room, used)
    if first is None:
        return [largest]
    if first == room:
        return [largest, first]
    low = sizes.smallest(3, used)
    if len(low) < 2 or low[0] + low[1] > room:
        return [largest, first]
    if len(low) == 3 and sum(low) <= room:
        return None
    used[first] = used.get(first, 0) + 1
    second = sizes.largest_within(room - first, used)
    if second is None:
        return None
    # Another pair would need both of its sizes above the second.
    at = bisect_right(sizes.order, second)
    if at == len(sizes.order) or 2 * sizes.order[at] > room:
        return [largest, first, second]
    return None


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns ((size, items in a container), ...) and how many containers have each; sizes are 1 to capacity."""
    sizes = _Sizes(counts)
    done: list[tuple[Pattern, int]] = []
    kept: dict[int, int] = {}
    while sizes.order:
        largest = sizes.order[-1]
        if kept and min(kept) <= capacity - largest:
            # A size kept for best fit could stand beside this one, so no set is proved from here on.
            break
        chosen = dominating_set(sizes, largest, capacity)
        if chosen is None:
            kept[largest] = sizes.count[largest]
            sizes.take(largest, sizes.count[largest])
            continue
        need: dict[int, int] = {}
        for s in chosen:
            need[s] = need.get(s, 0) + 1
        times = min(sizes.count[s] // k for s, k in need.items())
        for s, k in need.items():
            sizes.take(s, k * times)
        done.append((tuple(sorted(need.items(), reverse=True)), times))
    for s, n in sizes.count.items():
        kept[s] = kept.get(s, 0) + n
    return done + best_fit(kept, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in falling order of size, over groups of containers with equal contents."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, pattern, n = capacity, (), left
            each = min(room // size, left)
            filled = min(n, left // each)
            put(room - each * size, (*pattern, (size, each)), filled)
            if pattern:
                put(room, pattern, n - filled)
            left -= each * filled
    return [g for room in rooms for g in groups[room]]


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of one capacity: ranks slot_from .. slot_to of a size go into containers from first on, so many in each."""
    counts = dict(zip(pdf["size"].tolist(), pdf["items"].tolist(), strict=True))
    name, capacity = pdf["pack_name"].iloc[0], int(pdf["capacity"].iloc[0])
    empty = counts.pop(0, 0)
    rows, next_slot, container = [], {}, 0
    for pattern, times in plan_containers(counts, capacity):
        for size, each in pattern:
            slot = next_slot.get(size, 0)
            next_slot[size] = slot + each * times
            rows.append((name, capacity, size, slot, slot + each * times, container, each))
        container += times
    if empty:
        rows.append((name, capacity, 0, 0, empty, 0, empty))
    return pd.DataFrame(rows, columns=["pack_name", "capacity", "size", "slot_from", "slot_to", "first", "each"])


def pack(sized: DataFrame, packs: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """Rows (pack_name, container_id, key, piece, tokens, first_token) that place every text in every capacity.

    ``sized`` has one row for each text, ``packs`` has (pack_name, capacity_tokens).
    """
    packs = (
        packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity"))
        .where("capacity >= 1")
        .distinct()
    )
    texts = sized.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("total"))
    cut = each_of(texts, packs).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / F.col("capacity")) - 1).cast("int"))))
    items = materialise(
        cut.select(
            "pack_name", "capacity", "key", "piece",
            F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")).alias("size"),
            (F.col("piece") * F.col("capacity")).alias("first_token"),
        ),
        "items",
    )
    buckets = max(1, -(-items.count() // RANKED))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    of_size = ["pack_name", "size"]
    tally = materialise(items.groupBy("pack_name", "capacity", "size", "bucket").agg(F.count("*").alias("n")), "tally")
    offsets = tally.select(
        *of_size, "bucket",
        (F.sum("n").over(Window.partitionBy(*of_size).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    counts = tally.groupBy("pack_name", "capacity", "size").agg(F.sum("n").alias("items"))
    runs = counts.groupBy("pack_name").applyInPandas(
        _plan, "pack_name string, capacity long, size long, slot_from long, slot_to long, first long, each long"
    )
    runs = materialise(runs, "runs")
    in_blocks = runs.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("slot_from") / BLOCK), F.floor((F.col("slot_to") - 1) / BLOCK)))
    )
    ranked = (
        items.where("size > 0")
        .withColumn("within", F.row_number().over(Window.partitionBy(*of_size, "bucket").orderBy("key", "piece")) - 1)
        .join(offsets, [*of_size, "bucket"])
        .withColumn("slot", F.col("within") + F.coalesce("before", F.lit(0)))
        .withColumn("block", F.floor(F.col("slot") / BLOCK))
    )
    placed = ranked.join(in_blocks.drop("capacity"), [*of_size, "block"]).where(
        (F.col("slot") >= F.col("slot_from")) & (F.col("slot") < F.col("slot_to"))
    )
    return (
        placed.select(
            "pack_name",
            (F.col("first") + F.floor((F.col("slot") - F.col("slot_from")) / F.col("each"))).alias("container_id"),
            F.col("key").alias(key), "piece", F.col("size").alias("tokens"), "first_token",
        )
        .unionByName(
            items.where("size = 0").select(
                "pack_name", F.lit(0).cast("long").alias("container_id"), F.col("key").alias(key), "piece",
                F.col("size").alias("tokens"), "first_token",
            )
        )
    )


def pack_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """Containers, tokens, share of filled room and the least possible number of containers of each capacity."""
    sums = placed.groupBy("pack_name").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts")
    )
    room = F.col("containers") * F.col("capacity_tokens")
    return sums.join(packs, "pack_name").select(
        "pack_name", "capacity_tokens", "containers", "tokens", "texts",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / room).alias("filled"),
    )
