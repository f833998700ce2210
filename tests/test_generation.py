import json

import pytest
from pyspark.sql import functions as F

from pothi.operators import generation
from pothi.plugins import CallPolicy

PAIR = {"question": "Q", "answer": "A"}


@pytest.mark.parametrize(
    ("response", "parsed"),
    [
        (json.dumps([PAIR | {"evidence": "E"}]), [("Q", "A", "E")]),
        ("```json\n" + json.dumps([PAIR | {"evidence": "E"}]) + "\n```", [("Q", "A", "E")]),
        ("```\n" + json.dumps([PAIR | {"evidence": "E"}]) + "\n```", [("Q", "A", "E")]),
        (json.dumps([PAIR | {"evidence": ["E1", "E2"]}]), [("Q", "A", "E1")]),
        (json.dumps([PAIR]), [("Q", "A", "")]),
        (json.dumps([PAIR | {"evidence": []}]), [("Q", "A", "")]),
        (json.dumps([PAIR | {"evidence": 7}]), [("Q", "A", "")]),
        (json.dumps([PAIR, PAIR | {"evidence": "E"}]), [("Q", "A", ""), ("Q", "A", "E")]),
        (json.dumps(PAIR), None),
        (json.dumps([{"question": "Q"}]), None),
        ("[]", None),
        ("not json", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_pairs(spark, response, parsed):
    got = spark.createDataFrame([(response,)], "r string").select(generation.parse_pairs(F.col("r"))).first()[0]
    assert (None if got is None else [tuple(x) for x in got]) == parsed


def test_prompts(spark):
    df = spark.createDataFrame([("bn", "ICT", 6, "পাঠ"), ("en", None, None, "text 100%")], "l string, s string, c int, t string")
    bn, en = [r[0] for r in df.select(generation.qa_prompt(F.col("l"), F.col("s"), F.col("c"), F.col("t"))).collect()]
    assert bn.startswith("তুমি একজন শিক্ষক") and "Class 6 ICT" in bn and bn.endswith("পাঠ")
    assert "exactly 2 question-answer" in en and en.endswith("Text:\ntext 100%")
    p = df.select(generation.grounded_prompt(F.lit("Q?"), F.array(*(F.lit(c * 500) for c in "abcdef"))), generation.open_prompt(F.lit("Q?"))).first()
    assert "Passage 5:\n" + "e" * 400 + "\n\nQuestion: Q?\nAnswer:" in p[0] and "f" * 9 not in p[0]
    assert p[1].endswith("Question: Q?\nAnswer:")


def test_generated_pairs_resume(spark):
    class Echo:
        def generate(self, prompts):
            return [json.dumps([PAIR | {"evidence": "E"}]) if "good" in p else "sorry" for p in prompts]

    chunks = spark.createDataFrame([(1, "good", "en", "s", 6), (2, "bad", "en", "s", 6), (3, "good", "en", "s", 6)], "chunk_id long, text string, language string, subject string, class_num int")
    done = spark.createDataFrame([(3,)], "chunk_id long")
    got = generation.generated_pairs(chunks, Echo(), done).collect()
    assert [(r["chunk_id"], r["question"], r["source_text"]) for r in got] == [(1, "Q", "good")]


def test_call_policy():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def fail():
        calls.append(1)
        raise RuntimeError("429")

    policy = CallPolicy(attempts=3, calls_per_minute=60, sleep=sleep, clock=lambda: now[0])
    assert policy.call(fail, lambda e: "429" in str(e)) is None and len(calls) == 3
    assert slept == [1.0, 2.0, 4.0]
    assert policy.call(lambda: "x") == "x"
