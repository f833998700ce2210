import numpy as np
import pytest

from pothi.llm import proportional_sample
from pothi.llm.proportional_sample import plan_counts, sample_to_targets

SCHEMA = "pair_id long, language string, subject string, class_num int, key string"
TARGETS = "language string, subject string, class_num int, target_permille int, min_rows int"


def rows(counts):
    out, i = [], 0
    for (language, subject, class_num), n in counts.items():
        for _ in range(n):
            out.append((i, language, subject, class_num, "clash"))
            i += 1
    return out


def test_report_and_sample(spark, monkeypatch):
    monkeypatch.setattr(proportional_sample, "RANKED", 30)
    counts = {("bn", "ICT", 6): 120, ("en", "ICT", 6): 10, ("en", None, 7): 30, ("xx", "Music", 9): 40}
    data = rows(counts)
    df = spark.createDataFrame(data + data[:25], SCHEMA).repartition(5)
    targets = spark.createDataFrame(
        [("bn", "ICT", 6, 400, 3), ("en", "ICT", 6, 400, 2), ("en", None, 7, 200, 0), ("hi", "ICT", 6, 0, 5), ("fr", "ICT", 6, 0, 0)], TARGETS
    )
    s = sample_to_targets(df, targets)
    report = {(r["language"], r["subject"]): r for r in s.report.collect()}
    assert s.plan.size == 100
    assert [k for k, r in report.items() if not r["can_be_met"]] == [("en", "ICT"), ("hi", "ICT")]
    assert report["en", "ICT"]["need"] == 40 and report["en", "ICT"]["available"] == report["en", "ICT"]["sampled"] == 10
    assert s.plan.deviation <= s.plan.start_deviation
    ids = [r["pair_id"] for r in s.sample.collect()]
    assert len(ids) == len(set(ids)) == 100
    signature = {r[0]: r[1:4] for r in data}
    got = {k: sum(signature[i] == k for i in ids) for k in counts}
    assert got["en", "ICT", 6] == 10 and got["bn", "ICT", 6] == report["bn", "ICT"]["sampled"] and got["xx", "Music", 9] == s.plan.pool
    assert sorted(ids) == sorted(r["pair_id"] for r in sample_to_targets(df.repartition(2), targets).sample.collect())


@pytest.mark.parametrize("seed", range(30))
def test_no_exchange_improves(seed):
    rng = np.random.default_rng(seed)
    k = 6
    have = rng.integers(0, 60, k).tolist()
    permille = (rng.dirichlet(np.ones(k)) * 1000).round().tolist()
    floors = rng.integers(0, 8, k).tolist()
    plan = plan_counts(have, permille, floors, 30, (sum(have) + 30) // 2, seed)
    counts = np.array([*plan.sampled, plan.pool])
    assert counts.sum() == plan.size and (counts <= [*have, 30]).all()
    floor = np.minimum([*floors, 0], [*have, 30])
    if floor.sum() <= plan.size:
        assert (counts >= floor).all()
    else:
        return
    target = np.array([*(p * plan.size / 1000 for p in permille), 0])
    for a in range(k + 1):
        for b in range(k + 1):
            if a != b and counts[a] > floor[a] and counts[b] < [*have, 30][b]:
                moved = counts.copy()
                moved[a] -= 1
                moved[b] += 1
                assert np.abs(moved - target).sum() >= plan.deviation - 1e-6


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    targets = spark.createDataFrame([("bn", "ICT", 6, 1000, 3)], TARGETS)
    s = sample_to_targets(empty, targets)
    assert s.sample.count() == 0 and not s.report.first()["can_be_met"]
    assert sample_to_targets(spark.createDataFrame(rows({("bn", "ICT", 6): 9}), SCHEMA), targets.limit(0)).sample.count() == 4
    nulls = spark.createDataFrame([(None, "bn", "ICT", 6, "x"), (1, None, None, None, None), (2, None, None, None, None)], SCHEMA)
    assert sample_to_targets(nulls, targets).sample.count() == 1
