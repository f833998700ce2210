from datetime import datetime, timedelta

from pothi.streaming import incremental

START = datetime(2031, 1, 1)
SCHEMA = "pair_id long, source string, loaded_at timestamp"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_resume_and_latest(spark, tmp_path):
    folder, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    deliver(spark, folder, [(1, "a", START), (2, "a", START)])
    for _ in range(2):
        incremental.run_stage(incremental.new_rows(spark, folder, SCHEMA), lambda b: b.where("source <> 'x'"), target, checkpoint).awaitTermination()
    deliver(spark, folder, [(2, "b", START + timedelta(days=1)), (3, "x", START)])
    incremental.run_stage(incremental.new_rows(spark, folder, SCHEMA), lambda b: b.where("source <> 'x'"), target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).count() == 3
    assert {r["pair_id"]: r["source"] for r in incremental.current(spark, target, "pair_id", "loaded_at").collect()} == {1: "a", 2: "b"}


def test_once_and_counts(spark, tmp_path):
    folder = f"{tmp_path}/in"
    deliver(spark, folder, [(1, "a", START), (1, "a", START + timedelta(days=2)), (2, "b", START), (None, "b", START)])
    deliver(spark, folder, [(9, "a", START + timedelta(days=200))])
    stream = incremental.once(incremental.new_rows(spark, folder, SCHEMA), "pair_id", "loaded_at")
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["pair_id"] for r in spark.table("once").collect()) == [1, 2, 9]
    counted = incremental.counts_over_time(incremental.new_rows(spark, folder, SCHEMA), "loaded_at", "source")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("counted").collect()) == 4
