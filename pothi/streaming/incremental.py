"""Incremental variants of the stages: resume, late deliveries, counts over time.

A stage that is resumed is a stream of new files: Spark's checkpoint remembers
what was read, and every micro-batch is written under its own number, so a
batch that runs twice replaces its own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pothi.operators.dense import latest


def new_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def run_stage(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch stage to each micro-batch and write it as one numbered part of the target; stops when nothing is left."""

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str, by: str) -> DataFrame:
    """What a target holds now: the last delivery of each key over all batches."""
    return latest(spark.read.parquet(target), key, by).drop("batch")


def once(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """First delivery of each key, kept in state as long as repeats may come late."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_over_time(stream: DataFrame, time: str, by: str, width: str = "7 days", late: str = "30 days") -> DataFrame:
    """Rows of each window of arrival and group; a window is given out once nothing for it can come any more."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("start"), by, "n")
