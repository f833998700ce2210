import os
import random
from collections import Counter

import numpy as np
import pytest

from pothi.llm import cross_split, near_duplicates
from pothi.llm.cross_split import MinwiseBands, bucket_candidates, cross_split_classes, cross_split_pairs, may_be_alike, minwise, overlap_report, sketches
from pothi.llm.near_duplicates import Banding, band_keys, connected, near_duplicate_groups, near_duplicate_pairs, one_permutation
from pothi.llm.shingles import numbered_hashes, words_of


def similarity(a, b):
    a, b = Counter(words_of(*a)), Counter(words_of(*b))
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 0.0


def corpus(n, seed):
    """Records of random words, many of them edited copies of earlier ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out)[0].split()
            for _ in range(rng.randrange(0, 7)):
                at = rng.randrange(len(words))
                words[at] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 30))]
        cut = rng.randrange(len(words))
        out.append((" ".join(words), None if cut % 5 == 0 else " ".join(words[cut:cut])))
    return out


SCHEMA = "pair_id long, question string, answer string, split string, source string, bag string, id string"


def frame(spark, records, seed=0):
    rng = random.Random(seed)
    rows = [(i, q, a, rng.choice(["train", "train", "test", "validation"]), rng.choice(["s1", None]), "clash", "clash") for i, (q, a) in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_against_brute_force(spark, seed):
    records = corpus(300, seed)
    df, split = frame(spark, records, seed)
    want = {(i, j) for j in range(300) for i in range(j) if similarity(records[i], records[j]) >= 0.8}
    assert len(want) > 50
    got = [(r["a"], r["b"]) for r in near_duplicate_pairs(df).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    across = [(r["a"], r["b"]) for r in cross_split_pairs(df).collect()]
    assert len(across) == len(set(across))
    assert set(across) == {(i, j) for i, j in want if (split[i] == "train") != (split[j] == "train")}
    groups = {r["id"]: r["group_id"] for r in near_duplicate_groups(df).collect()}
    assert all(groups[i] == groups[j] for i, j in want)


def test_small_batches_lose_nothing(spark):
    records = corpus(200, 3)
    df, _ = frame(spark, records)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["a"], r["b"]) for r in near_duplicate_pairs(df).select("a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(i, j) for j in range(200) for i in range(j) if similarity(records[i], records[j]) >= 0.8}


def test_pairs_far_from_every_hub(spark):
    """A family with a common frame (J = 0.644) in which only the two records of a cluster are alike (J = 2/3)."""
    frame_words = " ".join(f"f{i}" for i in range(47))
    records = [(f"{frame_words} c{c} " + " ".join(f"own{c}y{k}x{i}" for i in range(12)), None) for c in range(80) for k in range(2)]
    rng = random.Random(5)
    rng.shuffle(records)
    df, _ = frame(spark, records)
    want = {(i, j) for j in range(len(records)) for i in range(j) if similarity(records[i], records[j]) >= 0.8}
    assert len(want) == 80
    got = [(r["a"], r["b"]) for r in near_duplicate_pairs(df).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r["a"], r["b"]) for r in near_duplicate_pairs(df).select("a", "b").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_copies_edits_and_nulls(spark):
    rows = [
        (1, "Ａ b c d e f g h i j?", "k l m n"), (2, "a B c d e f g h i j", "k, l m n."), (3, "a b c d e f g h i x", "k l m n"), (3, "a b c d e f g h i x", "k l m n"),
        (4, None, None), (5, "", "?!"), (6, None, None), (None, "a b c d e f g h i j", "k l m n"), (7, "z " * 4000, None), (8, "z " * 4000, ""),
    ]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string")
    assert {(r["a"], r["b"]) for r in near_duplicate_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3), (7, 8)}
    got = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in near_duplicate_groups(df).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 7: (7, 7, 0), 8: (7, 7, 0)}
    assert near_duplicate_pairs(df.limit(0)).count() == 0 and near_duplicate_groups(df.limit(0)).count() == 0


def test_large_classes_are_linked_to_their_representative(spark):
    rows = [(i, "a b c d e f g h i j k l", None) for i in range(30)] + [(30, "a b c d e f g h i j k x", None)]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string")
    assert near_duplicate_pairs(df).count() == 31 * 30 // 2
    got = {(r["a"], r["b"]) for r in near_duplicate_pairs(df, copies_listed=10).collect()}
    assert got == {(0, i) for i in range(1, 31)}


def test_signatures_agree_with_probability_j():
    rng = np.random.default_rng(1)
    shared = rng.integers(-(2**62), 2**62, 40)
    agree, mins = [], []
    a, b = MinwiseBands().coefficients()
    for _ in range(30):
        shared = rng.integers(-(2**62), 2**62, 40)
        x, y = (np.concatenate([shared, rng.integers(-(2**62), 2**62, 10)]) for _ in range(2))
        s = one_permutation([x, y], Banding())
        agree.append((s[0] == s[1]).mean())
        mins.append((minwise(x, a, b) == minwise(y, a, b)).mean())
    assert abs(np.mean(agree) - 40 / 60) < 0.03 and abs(np.mean(mins) - 40 / 60) < 0.03


def test_short_lists_fill_all_bins():
    s = one_permutation([np.array([5], np.int64), np.array([5], np.int64), np.array([6], np.int64)], Banding())
    assert (s[0] == s[1]).all() and (s[0] != s[2]).all()
    k = band_keys(s, Banding())
    assert (k[0] == k[1]).all() and (k[0] != k[2]).all() and len(set(k[0].tolist())) == Banding().bands


def test_numbered_hashes():
    assert len(set(numbered_hashes("a a b a".split()))) == 4
    assert numbered_hashes(["a"]) == numbered_hashes(["a", "b"])[:1]
    seen = [h for w in range(1000) for h in numbered_hashes([f"w{w}"] * 4)]
    assert len(set(seen)) == 4000


def test_connected(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (50, 50)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlap_report(spark):
    text = "a b c d e f g h i j k l"
    rows = [(1, text, None, "train", "s"), (2, text, None, "test", "s"), (3, text + " m", None, "test", None), (4, text, None, None, "s")]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string, split string, source string")
    got = {(r["split"], r["source"]): (r["pairs"], r["records"], r["exact_pairs"]) for r in overlap_report(df).collect()}
    assert got == {("test", "s"): (1, 1, 1), ("test", None): (1, 1, 0)}
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_large_classes_across_splits(spark):
    """Five copies in test and validation and four in train, all beyond the number that is listed."""
    text = "a b c d e f g h i j k l"
    rows = [(i, text, None, "test" if i < 3 else "validation", "s" if i % 2 else "u") for i in range(5)] + [(i, text, None, "train", "s") for i in range(10, 14)]
    rows += [(20, text + " m", None, "test", "s"), (30, text + " n", None, "train", "s")]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string, split string, source string")
    across = {(i, j) for i in (0, 1, 2, 3, 4, 20) for j in (10, 11, 12, 13, 30)}
    everything = {(min(p), max(p)) for p in across}
    pairs = [(r["a"], r["b"]) for r in cross_split_pairs(df).collect()]
    assert len(pairs) == len(everything) and set(pairs) == everything
    pairs = [(r["a"], r["b"]) for r in cross_split_pairs(df, copies_listed=2).collect()]
    # One of the two is the least id of its class.
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(min(p), max(p)) for p in across if p[0] in (0, 20) or p[1] in (10, 30)}
    want = {("test", "u"): (10, 2, 8), ("test", "s"): (10, 2, 4), ("validation", "s"): (5, 1, 4), ("validation", "u"): (5, 1, 4)}
    got = {(r["split"], r["source"]): (r["pairs"], r["records"], r["exact_pairs"]) for r in overlap_report(df).collect()}
    assert got == want


def test_report_counts_classes_beyond_the_listed_number(spark):
    text = "a b c d e f g h i j k l"
    rows = [(0, text, None, "train", "s")] + [(i, text, None, "test" if i < 800 else "validation", "s") for i in range(1, 1202)]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string, split string, source string")
    got = {r["split"]: (r["pairs"], r["records"], r["exact_pairs"]) for r in overlap_report(df).collect()}
    assert got == {"test": (799, 799, 799), "validation": (402, 402, 402)}
    assert cross_split_pairs(df).count() == 1201


def test_local_folder_is_used_only_where_none_is_named(spark):
    assert near_duplicates.materialise(spark.range(3), "x").count() == 3


def test_sketches_exclude_only_pairs_below_the_threshold():
    rng = np.random.default_rng(3)
    shared = [rng.integers(-(2**62), 2**62, 40) for _ in range(200)]
    own = [rng.integers(-(2**62), 2**62, rng.integers(0, 25)) for _ in range(400)]
    x = [np.r_[s, own[2 * i]] for i, s in enumerate(shared)]
    y = [np.r_[s, own[2 * i + 1]] for i, s in enumerate(shared)]
    mx, my = (sketches(z, np.full(200, side)).view(np.uint64) for z, side in ((x, True), (y, False)))
    alike = np.array([80 / (len(a) + len(b)) >= 0.8 for a, b in zip(x, y, strict=True)])
    may = may_be_alike(mx, my, 0.8)
    assert alike.any() and not alike.all() and may[alike].all() and may[~alike].mean() < 0.5
    assert not may_be_alike(mx, np.roll(my, 1, axis=0), 0.8).any()


@pytest.mark.parametrize("streamed", [2, 40])
def test_large_buckets_are_cut_into_blocks(spark, monkeypatch, streamed):
    monkeypatch.setattr(cross_split, "STREAMED", streamed)
    monkeypatch.setattr(cross_split, "BLOCK", 3)
    records = corpus(150, 8)
    df, split = frame(spark, records)
    want = {(i, j) for j in range(150) for i in range(j) if similarity(records[i], records[j]) >= 0.8 and (split[i] == "train") != (split[j] == "train")}
    got = [(r["a"], r["b"]) for r in cross_split_pairs(df).collect()]
    assert len(want) > 10 and len(got) == len(set(got)) and set(got) == want


def test_copies_beyond_the_listed_number_are_counted_and_have_a_class(spark):
    text = "a b c d e f g h i j k l"
    df = spark.range(1503).selectExpr("id as pair_id", f"'{text}' as question", "cast(null as string) as answer", "if(id < 1500, 'train', 'test') as split", "'s' as source")
    assert [tuple(r) for r in overlap_report(df).select("pairs", "records", "exact_pairs").collect()] == [(4500, 3, 4500)]
    assert {(r["class_id"], r["copies"]) for r in cross_split_classes(df).collect()} == {(0, 1500), (1500, 3)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_candidates_grow_with_the_records(spark):
    counts = {}
    for sf in ("0.01", "0.1"):
        df = spark.read.parquet(f"/root/testdata/sf{sf}/nctb_qa.parquet")
        prepared, _, classes = cross_split._classes(df, "pair_id", "question", "answer", "split", "train")
        sides = prepared.join(classes.selectExpr("rep as id", "bag", "train"), ["id", "bag"]).select("id", "train", "words")
        counts[sf] = bucket_candidates(sides, 0.8, MinwiseBands()).count()
    assert 0 < counts["0.1"] <= 10**1.1 * counts["0.01"]


def families(rng, frames, cores, copies, core_words, core_kept, copy_kept):
    """Two levels of template families: each record keeps a share of its core, each core a share of its frame."""
    fresh = lambda: f"v{rng.randrange(10**9)}"
    out = []
    for _ in range(frames):
        frame_words = [fresh() for _ in range(core_words)]
        for _ in range(cores):
            core = [w if rng.random() < core_kept else fresh() for w in frame_words]
            out += [" ".join(w if rng.random() < copy_kept else fresh() for w in core) for _ in range(copies)]
    rng.shuffle(out)
    return [(x, None) for x in out]


@pytest.mark.parametrize(("words", "core_kept", "copy_kept"), [(60, 0.80, 0.86), (40, 0.82, 0.84)])
def test_recall_in_wide_families(spark, words, core_kept, copy_kept):
    records = families(random.Random(words), 3, 12, 14, words, core_kept, copy_kept)
    sets = [set(q.split()) for q, _ in records]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 2 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]))}
    df, _ = frame(spark, records)
    got = {(r["a"], r["b"]) for r in near_duplicate_pairs(df).select("a", "b").collect()}
    assert len(want) > 300 and got <= want and len(got) >= 0.99 * len(want)


def test_groups_give_hardly_more_than_the_pairs_alike(spark, monkeypatch):
    """A family of 500 records around few hubs: 125,000 pairs meet, and nearly only the pairs alike leave."""
    records = families(random.Random(7), 1, 25, 20, 50, 0.85, 0.9)
    sets = [set(q.split()) for q, _ in records]
    alike = sum(2 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j])) for j in range(len(sets)) for i in range(j))
    left = []
    whole = near_duplicates.group_pairs
    monkeypatch.setattr(near_duplicates, "group_pairs", lambda members, least: left.append(whole(members, least)) or left[-1])
    df, _ = frame(spark, records)
    near_duplicate_pairs(df).count()
    assert left[0].count() <= 2 * alike < 0.1 * 125_000
