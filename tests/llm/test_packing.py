import random
from itertools import combinations

import pytest

from pothi.llm import packing
from pothi.llm.packing import _Sizes, dominating_set, pack, pack_report, plan_containers


def optimum(items, capacity):
    """Least number of containers, by trying every way."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def counts(items):
    return {s: items.count(s) for s in set(items)}


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
    chosen = dominating_set(_Sizes(counts(items)), items[0], 20)
    if chosen is None:
        return
    assert sum(chosen) <= 20 and chosen[0] == items[0]
    rest = list(items)
    for s in chosen:
        rest.remove(s)
    assert 1 + optimum(rest, 20) == optimum(items, 20)


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 50) for _ in range(rng.randint(0, 12))]
    plan = plan_containers(counts(items), 50)
    placed = [s for pattern, times in plan for s, n in pattern for _ in range(n * times)]
    assert sorted(placed) == sorted(items)
    assert all(sum(s * n for s, n in pattern) <= 50 for pattern, _ in plan)
    assert sum(t for _, t in plan) <= optimum(sorted(items, reverse=True), 50) + 1


def test_large_counts_are_planned_together():
    plan = plan_containers({s: 10**7 for s in range(1, 400)}, 512)
    assert len(plan) < 5000
    room = 512 * sum(t for _, t in plan)
    assert sum(s * 10**7 for s in range(1, 400)) / room > 0.999


@pytest.fixture
def packs(spark):
    return spark.createDataFrame([("small", 10), ("wide", 64), ("none", None), ("zero", 0), ("small", 10)], "pack_name string, capacity_tokens int")


def test_pack(spark, packs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 40)
    monkeypatch.setattr(packing, "BLOCK", 4)
    rng = random.Random(2)
    sizes = [0, 0, None, 10, 25, 64, 65, 200] + [rng.choice([3, 3, 3, rng.randint(1, 30)]) for _ in range(300)]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc_id long, tokens long, size string").repartition(5)
    rows = pack(df, packs).collect()
    for name, capacity in (("small", 10), ("wide", 64)):
        own = [r for r in rows if r["pack_name"] == name]
        assert len({(r["doc_id"], r["piece"]) for r in own}) == len(own)
        room, per_doc = {}, {}
        for r in own:
            room[r["container_id"]] = room.get(r["container_id"], 0) + r["tokens"]
            per_doc.setdefault(r["doc_id"], []).append(r)
        assert set(room) == set(range(len(room))) and max(room.values()) <= capacity
        assert sorted(per_doc) == list(range(len(sizes)))
        for i, s in enumerate(sizes):
            assert sum(r["tokens"] for r in per_doc[i]) == (s or 0)
            assert len(per_doc[i]) == max(1, -(-(s or 0) // capacity))
        assert len(room) <= 1.1 * -(-sum(s or 0 for s in sizes) // capacity)
    report = {r["pack_name"]: r for r in pack_report(pack(df, packs), packs.where("pack_name <> 'none'").distinct()).collect()}
    assert report["wide"]["filled"] > 0.95 and report["wide"]["texts"] == len(sizes)


def test_edge_cases(spark, packs):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    assert pack(empty, packs).count() == 0
    blank = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, tokens long")
    assert {(r["pack_name"], r["container_id"]) for r in pack(blank, packs).collect()} == {("small", 0), ("wide", 0)}
    assert pack(blank, packs.limit(0)).count() == 0


def test_pairs_of_equal_sizes():
    for a, b in combinations((3, 5, 7), 2):
        assert sum(t for _, t in plan_containers({a: 6, b: 6}, a + b)) == 6
