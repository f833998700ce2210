from pyspark.sql import functions as F

from pothi.operators import sampling


def sizes(spark, counts):
    rows = [(s, i) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "id long, s string")


def allocation(spark, counts, total):
    return {r["s"]: r["allocation"] for r in sampling.log_allocation(sizes(spark, counts), ["s"], total).collect()}


def test_log_allocation(spark):
    assert allocation(spark, {"a": 100, "b": 10, "c": 2}, 10) == {"a": 6, "b": 3, "c": 1}
    assert allocation(spark, {"a": 1, "b": 1, "c": 50}, 4) == {"a": 1, "b": 1, "c": 2}
    assert allocation(spark, {"a": 3, "b": 2}, 9) == {"a": 3, "b": 2}


def test_stratified_sample(spark):
    df = sizes(spark, {"a": 100, "b": 10, "c": 2}).withColumn("s", F.when(F.col("s") != "b", F.col("s")))
    got = sampling.stratified_sample(df, "id", ["s"], 10)
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {None: 3, "a": 6, "c": 1}
    assert got.select("id").distinct().count() == 10
    assert sorted(got.collect()) == sorted(sampling.stratified_sample(df.repartition(5), "id", ["s"], 10).collect())


def test_gold_and_rest(spark):
    df = spark.range(50)
    gold = sampling.gold_sample(df, "id", 20)
    rest = sampling.training_rest(df, gold, "id")
    assert gold.count() == 20 and rest.count() == 30 and gold.join(rest, "id").count() == 0
    assert sampling.gold_sample(df, "id", 99).count() == 50


def test_slices_and_resume(spark):
    df = spark.range(10)
    assert [r["id"] for r in sampling.day_slice(df, "id", 2, 4).orderBy("id").collect()] == [4, 5, 6, 7]
    assert sampling.not_done(df, spark.createDataFrame([(1,), (1,), (3,)], "id long"), "id").count() == 8


def test_hashed_sample(spark):
    df = spark.range(5000)
    got = sampling.hashed_sample(df, F.xxhash64("id"), 100, "id")
    assert got.count() == 100 and got.distinct().count() == 100
    assert sampling.hashed_sample(df.limit(0), F.xxhash64("id"), 100, "id").count() == 0
