import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pothi.operators import chunking, fusion, generation, lexical, retrievers
from pothi.plans import pipeline, run
from pothi.plugins import CallPolicy, FirstWords, HashingEmbedder, OverlapScorer, PlainTextExtractor, ServiceGenerator
from pothi.sources import files

# Workers do not import the tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
CHUNKS = [(0, "the red cell divides"), (1, "blue sky over the hill"), (2, "a red lamp near the cell"), (3, "green tea"), (4, "cell wall of a plant")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "red cell"), (2, "blue sky")], "query_id long, question string")


@pytest.fixture(scope="module")
def of_words(chunks):
    return retrievers.lexical_retriever(lexical.build_index(chunks, "chunk_id"))


def test_two_stage(chunks, questions, of_words):
    embedder = HashingEmbedder(64)
    vectors = retrievers.embedded_chunks(chunks, embedder)
    of_meaning = retrievers.dense_retriever(vectors, embedder)
    found = retrievers.TwoStage(of_words, OverlapScorer(), chunks, of_meaning, of_words, vectors)(questions, 3)
    first = {r["query_id"]: r["chunk_id"] for r in found.where("rank = 1").collect()}
    assert found.count() == 6 and first[1] in (0, 2) and first[2] == 1
    plain = retrievers.TwoStage(of_words, OverlapScorer(), chunks)(questions, 5)
    assert plain.count() == 10 and plain.where("rank = 1 and query_id = 2").first()["chunk_id"] == 1
    hybrid = retrievers.hybrid_retriever(of_meaning, of_words)(questions, 2)
    assert hybrid.count() == 4


def test_parents_are_reranked_only_where_there_are_more_than_asked(spark, questions):
    children = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)], "query_id long, chunk_id long, rank int")
    parents = spark.createDataFrame([(1, "p1", "blue"), (2, "p2", "red"), (3, "p3", "a red cell")], "chunk_id long, parent_id string, text string")
    got = {(r["query_id"], r["rank"]): r["parent_id"] for r in retrievers.hierarchical(children, parents, questions, 2, OverlapScorer()).collect()}
    assert got == {(1, 1): "p3", (1, 2): "p2", (2, 1): "p1"}
    plain = {(r["query_id"], r["rank"]): r["parent_id"] for r in retrievers.hierarchical(children, parents, questions, 2).collect()}
    assert plain == {(1, 1): "p1", (1, 2): "p2", (2, 1): "p1"}


class Counting:
    def __init__(self, path):
        self.path = path

    def generate(self, prompts):
        with open(self.path, "a") as f:
            f.writelines("x\n" for _ in prompts)
        return FirstWords(3).generate(prompts)


def test_run_over_configurations(spark, chunks, of_words, tmp_path):
    configs = spark.createDataFrame([(i, r, "g", p) for i, (r, p) in enumerate([("bm25", "grounded"), ("bm25", "open"), ("again", "grounded"), ("none", "open")])], "config_id int, retriever string, generator string, prompt_type string")
    tests = spark.createDataFrame([(1, "red cell", "the red cell divides", 0), (2, "blue sky", None, None), (3, None, "x", 3)], "pair_id long, question string, gold_answer string, gold_chunk_id long")
    calls = str(tmp_path / "calls")
    asked = {"bm25": of_words, "again": of_words}
    out = run.run_matrix(configs, tests, chunks, asked, {"g": Counting(calls)})
    rows = {(r["config_id"], r["pair_id"]): r for r in out.collect()}
    assert sorted(rows) == [(c, p) for c in (0, 1, 2) for p in (1, 2, 3)]
    assert rows[0, 1]["predicted"] == "the red cell" and rows[0, 1]["recall_at_1"] == 1.0 and rows[1, 1]["open_answer"] == "" and rows[1, 1]["hallucination"] == 0
    # Three open answers for all configurations, and three grounded ones for each of two.
    assert len(open(calls).readlines()) == 3 + 6
    rest = run.run_matrix(configs, tests, chunks, asked, {"g": FirstWords(3)}, done=out.where("config_id = 0 or pair_id = 1").select("config_id", "pair_id"))
    assert sorted((r["config_id"], r["pair_id"]) for r in rest.collect()) == [(1, 2), (1, 3), (2, 2), (2, 3)]
    with pytest.raises(ValueError, match="no configuration"):
        run.run_matrix(configs.where("retriever = 'none'"), tests, chunks, asked, {"g": FirstWords(3)})


def test_rescored_rows_keep_what_the_base_has(spark):
    schema = "config_id int, predicted string, gold_answer string, open_answer string, retrieved_ids array<long>, gold_chunk_id long, language string, grade_band string, subject_code string"
    results = spark.createDataFrame([(1, "a b", "a b", "", [1], 1, "bn", "ssc", "ict"), (1, "a", "b", "", [1], 2, "en", "ssc", "ict"), (2, "a", "a", "", [], None, None, None, None)], schema)
    base = spark.createDataFrame([(1, "bm25", 0.9, 9.0)], "config_id int, retriever string, token_f1 double, rouge_l double")
    got = {r["config_id"]: r for r in run.rescored(results, base).collect()}
    assert got[1]["rouge_l"] == 0.5 and got[1]["token_f1"] == 0.9 and got[1]["bn_rouge_l"] == 1.0 and got[1]["ict_f1"] == 0.5
    assert got[2]["retriever"] is None and got[2]["token_f1_std"] == 0.0


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"books": str(tmp_path), "output": "out", "configs": [{"config_id": 1, "retriever": "bm25", "generator": "g"}]}))
    s = pipeline.Settings.read(str(path))
    assert s.configs[0].prompt_type == "grounded"
    for bad in ({"chunk_overlap": 1000}, {"dedup_cosine": 0}, {"attempts": 0}, {"colour": 1}, {"configs": [{"config_id": 1, "retriever": "a", "generator": "b", "prompt_type": "x"}]}, {"configs": [s.configs[0]] * 2}):
        with pytest.raises(ValueError):
            pipeline.Settings.of({"books": "b", "output": "o"} | bad)
    with pytest.raises(OSError, match="key"):
        pipeline.validate(spark, s)
    pipeline.validate(spark, s, needs_service=False)
    with pytest.raises(FileNotFoundError):
        pipeline.validate(spark, pipeline.Settings(books=f"{tmp_path}/none", output="o", service_key="k"))


def test_stages_run_once_and_after_what_changed(spark, tmp_path):
    settings, ran = pipeline.Settings(books=str(tmp_path), output=str(tmp_path / "out")), []

    def stage(name, make):
        def run_it(spark, settings, tables):
            ran.append(name)
            return make(tables)

        return run_it

    stages = {"a": stage("a", lambda t: spark.range(3)), "b": stage("b", lambda t: t["a"].where("id > 0"))}
    assert pipeline.run_stages(spark, settings, stages)["b"].count() == 2 and ran == ["a", "b"]
    pipeline.run_stages(spark, settings, stages)
    assert ran == ["a", "b"]
    pipeline.run_stages(spark, settings, stages, frozenset({"a"}))
    assert ran == ["a", "b", "a", "b"]
    with pytest.raises(ZeroDivisionError):
        pipeline.run_stages(spark, settings, stages | {"c": stage("c", lambda t: 1 / 0), "d": stage("d", lambda t: t["a"])})
    assert ran[-1] == "c"


def test_service_is_called_under_its_policy():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    failures = iter([RuntimeError("429"), None, ValueError("no"), ValueError("no"), ValueError("no")])

    def ask(prompt):
        e = next(failures, None)
        if e is not None:
            raise e
        return prompt.upper()

    policy = CallPolicy(attempts=3, first_wait=1.0, calls_per_minute=120.0, sleep=sleep, clock=lambda: now[0])
    assert ServiceGenerator(ask, policy, tasks=2).generate(["a", "b", "c"]) == ["A", None, "C"]
    # Two tasks share the rate, so one of them waits a second between calls.
    assert max(waits) == 1.0 and policy.shared(4).calls_per_minute == 30.0


def test_generation_keeps_a_cache_and_asks_empty_chunks_again(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "en", "ICT", 6, "one"), (2, "en", "ICT", 6, "two")], "chunk_id long, language string, subject string, class_num int, text string")

    class Some:
        def generate(self, prompts):
            return ['[{"question": "q", "answer": "a"}]' if "two" not in p else "[]" for p in prompts]

    class All:
        def generate(self, prompts):
            return ['[{"question": "q", "answer": "a"}]' for _ in prompts]

    cache = str(tmp_path / "cache")
    assert [r["chunk_id"] for r in generation.cached_pairs(chunks, Some(), cache).collect()] == [1]
    both = generation.cached_pairs(chunks, All(), cache)
    assert sorted(r["chunk_id"] for r in both.collect()) == [1, 2]
    assert [r["qa_id"] for r in generation.numbered_pairs(both, ["chunk_id"]).orderBy("chunk_id").collect()] == ["qa_00000", "qa_00001"]


def test_extraction_by_method_with_resume(spark):
    contents = spark.createDataFrame([("A_eng_class6.pdf", b"x" * 40 + b"\fmore"), ("B_ben_class6.pdf", b"y"), ("C_eng_class6.pdf", b"\xff"), ("D_eng_class6.pdf", b"z" * 40)], "filename string, content binary")
    listed = contents.select("filename").withColumn("lang_code", F.when(F.col("filename").contains("_ben_"), "bn").otherwise("en"))
    audited = files.sampled_audit(listed, contents, PlainTextExtractor())
    assert {r["filename"][0]: r["extraction_method"] for r in audited.collect()} == {"A": "ocr", "B": "ocr", "C": None, "D": "native"}
    done = spark.createDataFrame([("B_ben_class6.pdf",)], "filename string")
    pages = files.run_extraction(audited, contents, PlainTextExtractor(), PlainTextExtractor(), done)
    assert sorted((r["filename"][0], r["page_num"], r["extraction_method"]) for r in pages.collect()) == [("A", 1, "ocr"), ("A", 2, "ocr"), ("D", 1, "native")]
    assert {r["filename"][0]: r["status"] for r in files.extraction_status(audited, pages).collect()} == {"A": "extracted", "B": "audited", "C": "audit_failed", "D": "extracted"}


def test_chunks_keep_columns_of_their_page(spark):
    pages = spark.createDataFrame([(1, "word " * 300, "ICT", "clash"), (2, None, "x", "y")], "id long, text string, subject string, start string")
    got = chunking.split_pages(pages.withColumnRenamed("start", "from"), "id", keep=("subject", "from")).collect()
    assert len(got) > 1 and {(r["subject"], r["from"]) for r in got} == {("ICT", "clash")}


def test_previews(spark):
    ranking = spark.createDataFrame([(1, 5, 1), (1, 6, 4)], "query_id long, chunk_id long, rank int")
    records = spark.createDataFrame([(5, "p"), (6, "q")], "chunk_id long, preview string")
    assert [r["preview"] for r in retrievers.previewed(ranking, records).collect()] == ["p"]
    assert fusion.rerank_rows(ranking.withColumn("score", F.lit(1.0))).count() == 2
