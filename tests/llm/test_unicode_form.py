import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pothi.llm.unicode_form import MAYBE_UNSTABLE, canonical, canonical_column, normalise, unstable_fields

NUKTA, HASANTA, ZWJ, ZWNJ = "়", "্", "‍", "‌"


@pytest.mark.parametrize(
    ("raw", "form"),
    [
        ("Ｗｈａｔ ｉｓ？", "What is?"),
        ("a b c　d e", "a b c d e"),
        ("a\r\nb c", "a\nb\nc"),
        ("so­ft ze​ro jo⁠in bo﻿m", "soft zero join bom"),
        ("brоwѕеr", "browser"),
        ("Тhe Ηaze cονers", "The Haze covers"),
        ("е́té", "été"),
        ("ﬁre ﬂow", "fire flow"),
        ("য়ড়ঢ়", "য" + NUKTA + "ড" + NUKTA + "ঢ" + NUKTA),
        ("কো কৌ", "কো কৌ"),
        ("অাঁকল কব" + NUKTA + "ে", "আঁকল করে"),
        ("র" + ZWJ + HASANTA + "যাম উদ" + HASANTA + ZWNJ + "ঘাটন", "র" + ZWJ + HASANTA + "যাম উদ" + HASANTA + ZWNJ + "ঘাটন"),
        ("ক" + ZWJ + "রে", "করে"),
        ("λ wave Δt = 4 Ω π α, 25 m² H₂O 37 °C", "λ wave Δt = 4 Ω π α, 25 m² H₂O 37 °C"),
        ("“quoted” – dash — and…", "“quoted” – dash — and…"),
        ("काक़", "काक़"),
        ("", ""),
        (None, None),
    ],
)
def test_form(raw, form):
    assert canonical(raw) == form


ALPHABET = "ab é éকো়্‍‌​ ­Ａ，оѕαλΩﬁ।१२\n\r\t য়অাবৌ가"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=30))
def test_idempotent_composed_and_seen_by_java(text):
    form = canonical(text)
    assert canonical(form) == form
    assert unicodedata.is_normalized("NFC", form)


def test_long_text():
    text = ("word " * 50_000) + "ｅnd"
    assert canonical(text) == ("word " * 50_000) + "end"
    assert len(canonical("x" * 300_000 + "​")) == 300_000


def test_every_unstable_value_reaches_python(spark):
    raw = [c + t for c in ("", "a") for t in ALPHABET] + [a + b for a in ALPHABET for b in ALPHABET]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    for r in df.select("t", canonical_column(F.col("t")).alias("f"), F.col("t").rlike(MAYBE_UNSTABLE).alias("m")).collect():
        assert r["f"] == canonical(r["t"])


def test_unstable_fields(spark):
    rows = [(1, "ok", "Ａ", None), (1, "ok", "Ａ", None), (2, None, "", "x​"), (3, "same", "same", "same")]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string, field string")
    got = {tuple(r) for r in unstable_fields(df, "pair_id", ["question", "answer", "field"]).collect()}
    assert got == {(1, "answer"), (2, "field")}
    assert unstable_fields(df.limit(0), "pair_id", ["question"]).count() == 0
    kept = normalise(df, ["answer"]).where("pair_id = 1").first()
    assert kept["answer"] == "A" and kept["question"] == "ok"
