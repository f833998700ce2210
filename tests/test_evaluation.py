from pyspark.sql import functions as F

from pothi.plans import evaluation
from pothi.plugins import HashingEmbedder, OverlapScorer

SCHEMA = "config_id int, pair_id long, question string, gold_answer string, predicted string, open_answer string, retrieved_ids array<long>, gold_chunk_id long, language string, grade_band string, subject_code string, retrieval_ms int, generation_ms int"


def results(spark):
    rows = [
        (1, 1, "q", "ram stores data", "RAM stores data.", "", [7, 3, 9], 9, "en", "junior_sec", "ict", 10, 20),
        (1, 2, "q", "শাপলা", "গোলাপ", "শাপলা", [5], 5, "bn", "ssc", "science", None, 40),
        (2, 1, "q", "ram stores data", None, None, [], 9, "en", "junior_sec", "ict", 10, 20),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_scored_and_summary(spark):
    s = evaluation.scored(results(spark))
    got = {(r["config_id"], r["pair_id"]): r for r in s.collect()}
    assert got[1, 1]["em"] == 1 and got[1, 1]["recall_at_3"] == 1 and got[1, 1]["recall_at_1"] == 0 and got[1, 1]["hallucination"] == 0
    assert got[2, 1]["token_f1"] == 0 and all(r["rouge_l"] <= r["token_f1"] for r in got.values())
    configs = spark.createDataFrame([(i, "bm25", "g", "grounded") for i in (1, 2, 3)], "config_id int, retriever string, generator string, prompt_type string")
    wide = evaluation.summary(s, configs)
    row = wide.where("config_id = 1").first()
    assert wide.count() == 2 and row["n"] == 2 and row["em"] == 0.5 and row["bn_em"] == 0 and row["en_em"] == 1
    more = evaluation.enhanced_summary(s, configs).where("config_id = 1").first()
    assert more["avg_retrieval_ms"] == 5 and more["ict_f1"] == 1 and more["token_f1_std"] > 0
    assert len(evaluation.enhanced_summary(s, configs).columns) == 37
    assert evaluation.long_breakdown(wide).count() == 4 and evaluation.long_grades(wide).count() == 4
    assert evaluation.best_configuration(wide).first()["config_id"] == 1
    assert evaluation.present_columns(wide, ["config_id", "nothing"]).columns == ["config_id"]


def test_merge(spark):
    a = spark.createDataFrame([(1, 0.1, 5), (2, 0.2, 5)], "config_id int, em double, n int")
    b = spark.createDataFrame([(2, 0.9), (3, 0.3)], "config_id int, em double")
    assert [tuple(r) for r in evaluation.merge_summaries(a, b).collect()] == [(1, 0.1, 5), (2, 0.9, None), (3, 0.3, None)]


def test_runs_and_answers(spark):
    configs = spark.createDataFrame([(1,), (2,)], "config_id int")
    tests = spark.createDataFrame([(1, "q1"), (2, "q2")], "pair_id long, question string")
    runs = evaluation.configuration_runs(configs, tests)
    assert runs.count() == 4
    assert evaluation.missing_runs(runs, spark.createDataFrame([(1, 1)], "config_id int, pair_id long")).count() == 3

    class Counting:
        def generate(self, prompts):
            return [None if "Passage 1:\nfirst" in p else str(p.count("Passage ")) for p in prompts]

    ranking = spark.createDataFrame([(1, 20, 1), (1, 10, 2), (1, 99, 3)], "query_id long, chunk_id long, rank int")
    chunks = spark.createDataFrame([(10, "second"), (20, "first")], "chunk_id long, text string")
    contexts = evaluation.passages_of(ranking, chunks, 5)
    assert contexts.first()["retrieved_ids"] == [20, 10]
    got = {r["pair_id"]: r for r in evaluation.answer(tests, contexts, Counting()).collect()}
    assert got[1]["predicted"] == "" and got[2]["predicted"] == "3" and got[2]["open_answer"] == "0"


def test_similarity_and_faithfulness(spark):
    df = spark.createDataFrame([("a b", "A, b"), (None, "x")], "p string, g string")
    got = [r[0] for r in df.select(evaluation.sentence_similarity(F.col("p"), F.col("g"), HashingEmbedder(64))).collect()]
    assert abs(got[0] - 1) < 1e-6 and got[1] < 1
    answers = spark.createDataFrame([(1, "red cell", ["blue", "the cell", "a cell"]), (2, "x", [])], "query_id long, answer string, passages array<string>")
    rows = {r["query_id"]: (r["score"], r["rank"]) for r in evaluation.faithfulness(answers, OverlapScorer()).collect()}
    assert rows[1][1] == 2 and rows[2] == (0.0, -1)


def test_grouping_counts(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 1)], "a string, b int")
    got = {(r["dimension"], r["value"]): r["n"] for r in evaluation.grouping_counts(df, ["a", "b"]).collect()}
    assert got == {("a", "x"): 2, ("a", None): 1, ("b", "1"): 2, ("b", "2"): 1}
