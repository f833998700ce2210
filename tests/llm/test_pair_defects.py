import random

import pytest

from pothi.llm import language_id
from pothi.llm.pair_defects import MENTION_FRAMES, REFUSAL_PARTS, compose_refusal, context_tokens, find_defects, tail_state, train

NOUNS = "river bridge garden lamp engine map paper wheel farmer basket storm valley".split()
VERBS = "lifts cools guides stores copies turns holds marks".split()
QUESTION = "During the lesson a new {0} stood near the old {1}. Why does the {2} of the school {3} the {4} below the {5}?"
ANSWER = "Because the small {0} slowly {1} the quiet {2}. After 20 days, the {3} reached the {4} beside the open {5}."


def pair(rng):
    n = [rng.choice(NOUNS) for _ in range(10)]
    return QUESTION.format(n[0], n[1], n[2], rng.choice(VERBS)[:-1], n[3], n[4]), ANSWER.format(n[5], rng.choice(VERBS), n[6], n[7], n[8], n[9])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return train([pair(rng) for _ in range(400)], language_id.train([]))


def cases(rng):
    q, a = pair(rng)
    first, second = q.split(". ")
    yield q, None, a, "empty"
    yield q, "  ", a, "empty"
    yield q, "N/A", a, "empty"
    yield q, "—", a, "empty"
    yield q, a[:-30].rstrip(" ."), a, "truncated"
    yield q, " ".join(a.split()[:-3]) + "…", a, "truncated"
    yield q, q, a, "copy"
    yield q, second.upper(), a, "copy"
    yield q, "The question asks: " + q[0].lower() + q[1:-1], a, "copy"
    yield q, "I am sorry, but the passage does not say anything about it.", a, "refusal"
    yield "এই নদীর ধারে পুরোনো সেতুটি কে তৈরি করেছিল?", "দুঃখিত, আমি এই প্রশ্নের উত্তর দিতে পারছি না।", a, "refusal"
    yield q, "কারণ নদীর পানি খুব ঠান্ডা এবং বাতাস ধীরে ধীরে বয়ে যায়।", a, "other_language"
    yield q, a, a, None
    yield q, a.rstrip("."), a, None
    yield q, "RAM", a, None
    yield q, "20 days", a, None
    yield q, first + ", and the reason is this: because the small lamp slowly cools the quiet wheel.", a, None
    yield q, "It cannot be determined by touch, so the gauge is read after 14 minutes.", a, None


def test_held_out_defects(model):
    rng = random.Random(9)
    all_cases = [c for _ in range(12) for c in cases(rng)]
    got = model.judge([(q, a, e, None) for q, a, e, _ in all_cases])
    wrong = [(g, c) for g, c in zip(got, all_cases, strict=True) if g != c[3]]
    assert len(wrong) <= 0.05 * len(all_cases), wrong[:5]


def test_refusals_of_unseen_parts():
    """Trained on every second part, the classifier knows refusals composed of the others, and not what only quotes them."""
    rng = random.Random(2)
    halves = [{lang: {k: v[h::2] or v for k, v in p.items()} for lang, p in REFUSAL_PARTS.items()} for h in (0, 1)]
    model = train([pair(rng) for _ in range(400)], language_id.train([]), parts=halves[0])
    pairs = [pair(rng) for _ in range(200)]
    refused = [(q, compose_refusal(rng, "en", " ".join(q.split()[3:6]), halves[1]), None, None) for q, _ in pairs]
    quoted = [(q, rng.choice(MENTION_FRAMES["en"]).format(r=compose_refusal(rng, "en", "it", halves[1])[:-1], n=rng.randint(2, 99), w=rng.choice(NOUNS)), None, None) for q, _ in pairs]
    found = [k == "refusal" for k in model.judge(refused)]
    false = [k == "refusal" for k in model.judge(quoted + [(q, a, None, None) for q, a in pairs])]
    assert sum(found) >= 0.9 * len(found), [r[1] for r, ok in zip(refused, found, strict=True) if not ok][:20]
    assert sum(found) >= 0.95 * (sum(found) + sum(false)), [r[1] for r, bad in zip(quoted, false, strict=False) if bad][:20]


@pytest.mark.parametrize(
    ("answer", "context", "state"),
    [
        ("the red lamp on the", "He saw the red lamp on the table. Then", "mid"),
        ("the red lamp on the ta", "He saw the red lamp on the table. Then", "part"),
        ("the red lamp on the table", "He saw the red lamp on the ta-\nble. Then", "end"),
        ("something else was here", "He saw the red lamp", "none"),
        ("no", "no", "none"),
    ],
)
def test_tail(answer, context, state):
    assert tail_state(answer, context_tokens(context, None)) == state


def test_tables(spark, model):
    q, a = pair(random.Random(3))
    rows = [(1, q, None, a, a), (1, q, None, a, a), (2, q, a, a, None), (3, None, None, None, None), (4, q, q, None, a), (None, q, None, a, a), (5, q * 400, a, a, a * 400)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "pair_id long, question string, answer string, evidence string, source_text string, key string, defect string")
    assert {(r["pair_id"], r["defect"]) for r in find_defects(df, model=model).collect()} == {(1, "empty"), (3, "empty"), (4, "copy")}
    assert find_defects(df.limit(0)).count() == 0
    assert find_defects(df).where("defect = 'empty'").count() == 2
