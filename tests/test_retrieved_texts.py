"""Queries that meet answers with the texts of their retrieved ids: what is moved, and odd rows, against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SCHEMA = "config_id int, pair_id long, predicted string, retrieved_ids array<long>, question string"
ODD = [
    (1, 1, "red cell", [7, 77, 8, 9, 10, 11, 12], "q"),
    (1, 1, "red cell", [7, 77, 8, 9, 10, 11, 12], "q"),
    (1, 2, "green leaf", [77, 78], "q"),
    (1, 3, None, [8], "q"),
    (1, 4, "leaf", None, "q"),
    (1, 5, "leaf leaf root", [12, None, 12, 7], "q"),
    (1, 6, "root", [], "q"),
    (None, 7, "red cell", [7], "q"),
    (2, None, "red cell", [7, 9], "q"),
    (2, 8, "red leaf", [7], "q"),
    (2, 8, "red leaf", [7], "another question"),
    (2, 9, "root 12", [12, 7], "q"),
]
CHUNKS = [(7, "The red, red cell"), (8, None), (9, ""), (10, "blue"), (11, "cell cell"), (12, "red cell leaf ১২"), (12, "red cell leaf ১২")]


def nodes(plan):
    """Physical plan as it ran, shared exchanges once."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return nodes(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return nodes(plan.plan())
    if name == "ReusedExchangeExec":
        return []
    return [plan, *(x for i in range(plan.children().size()) for x in nodes(plan.children().apply(i)))]


def ran(spark, name, folder):
    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    return rows, nodes(df._jdf.queryExecution().executedPlan())


def written(spark, folder, predictions, chunks):
    spark.createDataFrame(predictions, SCHEMA).write.parquet(f"{folder}/predictions.parquet")
    chunks.write.parquet(f"{folder}/chunks.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"), ODD, spark.createDataFrame(CHUNKS, "chunk_id long, text string"))


@pytest.fixture(scope="module")
def named_often(spark, tmp_path_factory):
    """Ten texts of some hundred kilobytes, each named by three hundred answers."""
    chunks = spark.range(10).select(F.col("id").alias("chunk_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), i + 20_000 * F.col("id"))), " ").alias("text"))
    return written(spark, tmp_path_factory.mktemp("often"), [(1, i, f"w{i}", list(range(10)), "q") for i in range(300)], chunks)


@pytest.mark.parametrize("name", ["faithfulness_scores", "passage_coverage"])
def test_odd_rows_against_sql(spark, odd, name):
    c = duckdb.connect()
    for t in ("predictions", "chunks"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(repr([r[n] for n in names]) for r in ran(spark, name, odd)[0]) == sorted(repr(list(r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["faithfulness_scores", "passage_coverage"])
def test_texts_are_moved_once(spark, named_often, name):
    rows, plan = ran(spark, name, named_often)
    moved = sum(p.metrics().apply("dataSize").value() for p in plan if p.getClass().getSimpleName() == "ShuffleExchangeExec")
    text = spark.read.parquet(f"{named_often}/chunks.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert len(rows) == 300 and moved < 3 * text
