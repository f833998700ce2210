import pytest
from pyspark.sql import functions as F

from pothi.operators import validation
from pothi.plugins import ScriptDetector
from pothi.queries import QUERIES

SOURCE = "RAM or Random Access Memory stores temporary data for the processor to access quickly during computation"


@pytest.mark.parametrize(
    ("answer", "source", "share"),
    [
        ("RAM stores temporary data for fast processor access", SOURCE, 0.875),
        ("The moon is made of cheese and rocks", "RAM stores temporary data for the processor", 0.125),
        ("", SOURCE, 0.0),
        (None, SOURCE, 0.0),
        ("x", None, 0.0),
    ],
)
def test_overlap(spark, answer, source, share):
    df = spark.createDataFrame([(answer, source)], "a string, s string")
    assert df.select(validation.overlap(F.col("a"), F.col("s"))).first()[0] == share


@pytest.mark.parametrize(
    ("q", "a", "e", "reason"),
    [
        ("What is the main function of RAM?", "RAM stores data for fast processor access.", "x", "ok"),
        ("What?", "Yes.", "", "question_too_short"),
        ("What is a cell", "A unit of life", "x", "ok"),
        ("Describe the cell", "A unit of life", "x", "not_a_question"),
        ("Same words here?", "same words HERE?", "x", "question_equals_answer"),
        ("What is a cell?", "Yes.", "x", "answer_too_short"),
        ("What is a cell?", "A unit of life", None, "missing_evidence"),
        (None, None, None, "question_too_short"),
    ],
)
def test_structure(spark, q, a, e, reason):
    df = spark.createDataFrame([(q, a, e)], "q string, a string, e string")
    assert df.select(validation.structure_reason(F.col("q"), F.col("a"), F.col("e"))).first()[0] == reason


PAIRS = "pair_id long, chunk_id long, question string, answer string, evidence string, source_text string, language string"


def flagged(spark):
    rows = [
        (1, 10, "What is in the cell?", "A small nucleus", "x", "a small nucleus is in the cell", "en"),
        (2, 11, "What is in the cell?", "A small nucleus", "x", "nothing of the kind", "en"),
        (3, 12, "কোষে কী থাকে বলো?", "একটি নিউক্লিয়াস", "x", "কোষে একটি নিউক্লিয়াস থাকে", "bn"),
        (4, 13, "What is in the cell?", "A small nucleus", "x", "a small nucleus", None),
    ]
    return validation.signals(spark.createDataFrame(rows, PAIRS))


def test_signals_and_funnel(spark):
    df = flagged(spark)
    assert [(r["s3"], r["s4"], r["s5"]) for r in df.orderBy("pair_id").collect()] == [(True, True, True), (False, True, True), (True, True, True), (True, True, True)]
    ranking = spark.createDataFrame([(1, 10, 1), (3, 12, 4), (4, 13, 3)], "query_id long, chunk_id long, rank int")
    df = validation.round_trip(df, ranking).withColumns({"s2": F.col("pair_id") < 4, "s6": F.lit(True)})
    row = validation.funnel(df).first()
    assert (row["total_raw"], row["after_s3_s4_s5"], row["after_s2"], row["after_s1"], row["after_s6"], row["after_dedup"]) == (4, 3, 2, 1, 1, 1)
    assert row["cmar"] == 0.25 and row["cmar_of_verified"] == 1 and not row["cmar_met"] and row["gold_test_set_size"] == 1


def test_funnel_of_nothing(spark):
    df = validation.round_trip(flagged(spark).limit(0), spark.createDataFrame([], "query_id long, chunk_id long, rank int"))
    row = validation.funnel(df.withColumns({"s2": F.lit(True), "s6": F.lit(True)})).first()
    assert row["total_raw"] == 0 and row["cmar"] == 0


def test_injected_models(spark):
    class Picky:
        def generate(self, prompts):
            return [None if "কোষে" in p else " pass, it does" if "small nucleus is" in p else "FAIL" for p in prompts]

    got = validation.verify(flagged(spark), "s2", Picky()).orderBy("pair_id").collect()
    assert [(r["s2"], r["s2_verdict"]) for r in got] == [(True, " pass, it does"), (False, "FAIL"), (False, "api_failed"), (False, "FAIL")]
    texts = spark.createDataFrame([("RAM কী?",), ("123",), (None,)], "t string")
    assert [r[0] for r in texts.select(validation.detect_language(F.col("t"), ScriptDetector())).collect()] == ["en", None, None]


def test_registered_funnel_ends_with_elimination(spark, tmp_path):
    """Against brute force: a copy of a question that passed goes, one of a question that was rejected stays."""
    source = "a small nucleus is in the cell"
    cell, leaf = "What is in the cell?", "What is in the leaf?"
    # (pair, question, source): the first pair is rejected for its source, so the second is the first that passes.
    rows = [(1, cell, "nothing"), (2, cell, source), (3, "in the cell? What is", source), (4, leaf, source), (5, cell, source), (6, leaf, "nothing")]
    qa = [(i, 10 + i, q, "A small nucleus", "x", s, "en", 0) for i, q, s in rows]
    spark.createDataFrame(qa, PAIRS + ", loaded_at long").write.parquet(f"{tmp_path}/nctb_qa.parquet")
    ranking = [(i, 10 + i, 1, "bm25") for i, _, _ in rows]
    spark.createDataFrame(ranking, "query_id long, chunk_id long, rank int, retriever string").write.parquet(f"{tmp_path}/rankings.parquet")
    kept = []
    for _, q, s in rows:
        if s == source and not any(sorted(q.lower().split()) == sorted(k.lower().split()) for k in kept):
            kept.append(q)
    row = QUERIES["validation_funnel_deduplicated"](spark, str(tmp_path)).first()
    assert (row["total_raw"], row["after_s6"], row["after_dedup"], row["gold_test_set_size"]) == (6, 4, len(kept), 2)
    assert row["cmar_of_verified"] == 0.5 and row["cmar"] == round(2 / 6, 6) and not row["cmar_met"]
