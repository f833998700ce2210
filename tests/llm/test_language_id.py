import pytest
from pyspark.sql import functions as F

from pothi.llm.language_id import SEEDS, languages_of, named_by, of_record, record_languages, segment_languages, segments, train

HELD_OUT = {
    "en": ["Why did the old sailor leave his boat near the island?", "Which of these plants needs more light than water?"],
    "fr": ["Pourquoi la petite fille cherche-t-elle son chat dans le jardin?", "Nous avons trouvé une pierre lourde près du chemin."],
    "es": ["¿Cuándo llegaron los barcos al puerto de la isla?", "El perro de mi vecino duerme todo el día bajo la mesa."],
    "bn": ["নদীর ধারে পুরোনো মন্দিরটি কে তৈরি করেছিল?", "amar bon er notun boi ti khub bhalo ar ekti golpo ache"],
    "hi": ["नदी के किनारे पुराना मंदिर किसने बनाया था?", "mere bhai ki nayi kitaab bahut achchhi hai aur usmein kahani hai"],
}


@pytest.fixture(scope="module")
def model():
    return train([])


def test_held_out_sentences(model):
    for language, texts in HELD_OUT.items():
        for text, found in zip(texts, languages_of(texts, model), strict=True):
            assert {n for _, n, _ in found} == {language}, (text, found)


def test_mixed_and_borrowed(model):
    texts = [
        "নদীর ধারে কী আছে বলো। What does the farmer do after the rain?",
        "কম্পিউটারে CPU ও RAM কীভাবে কাজ করে বলো?",
        "What is written on the atlas of Kelbromivar near Zorlumtapa?",
        "",
        None,
        "12 + 7 = ?",
    ]
    own = [of_record(f) for f in languages_of(texts, model)]
    assert sorted(n for n, _ in own[0]) == ["bn", "en"]
    assert [n for n, _ in own[1]] == ["bn"] and [n for n, _ in own[2]] == ["en"]
    assert own[3] == own[4] == [("und", 0.0)] and own[5][0][0] == "und"
    assert all(0.5 < c <= 1 for _, c in own[0])


def test_segments():
    assert segments("One two. Three? চার পাঁচ। ছয়") == ["One two.", "Three?", "চার পাঁচ।", "ছয়"]
    assert segments("এই নদীর পানি খুব ঠান্ডা the water of this river is cold") == ["এই নদীর পানি খুব ঠান্ডা", "the water of this river is cold"]
    assert segments("x " * 30_000) == [("x " * 30_000).strip()]


@pytest.mark.parametrize(
    ("label", "language"),
    [("bn-BD", "bn"), ("Bangla", "bn"), (" EN ", "en"), ("en_GB", "en"), ("English", "en"), ("", None), ("  ", None), (None, None), ("xx", None), ("und", None), ("as", None)],
)
def test_labels(label, language):
    assert named_by(label) == language


def test_records(spark):
    en, bn = SEEDS["en"][0], SEEDS["bn"][0]
    rows = [(1, en, "en-GB"), (2, bn, "en"), (3, f"{en} {bn}", "en"), (4, None, "en"), (5, en, None), (5, en, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "pair_id long, question string, language string, key string, text string")
    got = {(r["pair_id"], r["language"], r["label_right"]) for r in record_languages(df).collect()}
    assert got == {(1, "en", True), (2, "bn", False), (3, "en", False), (3, "bn", False), (4, "und", False), (5, "en", False)}
    parts = segment_languages(df).where("pair_id = 3").orderBy("position").collect()
    assert [r["language"] for r in parts] == ["en", "bn"]
    assert record_languages(df.limit(0)).count() == 0
    assert segment_languages(df).agg(F.min("confidence")).first()[0] >= 0
