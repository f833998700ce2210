import random

import pytest

from pothi.llm.scan_repair import ScanModel, count_texts, distinct_texts, fit_scan, is_page_number, line_edges, printed_edges, repair, repaired, scan_noise
from pothi.llm.unicode_form import canonical

WORDS = "river bridge garden mineral engine market paper shallow farmer basket steady valley silent metal distant".split()


def page(rng, n=6):
    return [" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lines = page(rng)
        if i % 4 == 0:
            lines.insert(0, f"Lesson {i}: The {rng.choice(WORDS)}")
        if i % 8 == 1:
            lines.insert(3, rng.choice([f"The Home Studio | Session {i}", "THE HOME STUDIO", "For class use only", f"{i}  For class use only"]))
        if i % 8 == 2:
            lines.insert(2, f"Chapter {i % 5}: The {rng.choice(WORDS).title()}")
        rows.append((i, "\n".join(lines), lines[0], "x"))
    return spark.createDataFrame(rows, "pair_id long, source_text string, evidence string, page boolean".replace("boolean", "string"))


@pytest.fixture(scope="module")
def counted(corpus):
    return count_texts(distinct_texts(corpus, ["evidence", "source_text"]))


@pytest.fixture(scope="module")
def model(counted):
    return fit_scan(counted, 160)


@pytest.fixture(scope="module")
def headers(counted):
    return {r["item"] for r in printed_edges(counted).collect()}


@pytest.mark.parametrize(
    ("text", "kinds", "fixed"),
    [
        ("The steady far-\nmer saw the river.", {"hyphen"}, "The steady farmer saw the river."),
        ("The steady far- \n— 12 —\n\nmer saw the river.", {"hyphen", "page_no"}, "The steady farmer saw the river."),
        ("The stcady farmer saw the rnetal bri1ge of the 5hallow valley.", {"misread"}, None),
        ("The river\nThe Home Studio | Session 77\nsaw the market.", {"header"}, "The river saw the market."),
        ("The river\nTHE HOME STUDIO    [31]\nsaw the market.", {"header", "page_no"}, "The river saw the market."),
        ("The river\nChapter 3: The Quiet Lamp\nsaw the market.", {"header"}, "The river saw the market."),
        ("The river saw\n৪২\nthe market.", {"page_no"}, "The river saw the market."),
        ("The river saw\nthe market. A well-\nknown dash - here\nstays.", {"hyphen"}, None),
        ("Lesson 12: The garden\nThe river saw\nthe market.", set(), "Lesson 12: The garden\nThe river saw the market."),
        ("Readings:\n228\n331\n853\nThe river saw the market.", set(), None),
        ("1. The river.\n2. The market.", set(), "1. The river.\n2. The market."),
        ("Zorbelmi and Kelvarto saw Tamgrinav.", set(), "Zorbelmi and Kelvarto saw Tamgrinav."),
        ("H2O, CO2, MP3 and 4G on port RS-232.", set(), "H2O, CO2, MP3 and 4G on port RS-232."),
        ("", set(), ""),
        (" \n ", set(), " \n "),
        (None, set(), None),
    ],
)
def test_repair(model, headers, text, kinds, fixed):
    got, found = repair(text, model, {p: p in headers for p in line_edges(canonical(text) or "")})
    assert found == kinds
    assert fixed is None or got == fixed


def test_misread_words_come_back(model):
    assert repair("The stcady farmer saw the rnetal of the 5hallow va1ley.", model)[0] == "The steady farmer saw the metal of the shallow valley."


def test_page_numbers():
    assert is_page_number(["text", "[ 12 ]"], 1) and is_page_number(["a", "Page 4", "b"], 1) and is_page_number(["", "১২"], 1)
    assert not is_page_number(["Readings:", "12"], 1) and not is_page_number(["12", "13"], 0) and not is_page_number(["12 cm"], 0)


def test_long_text(model):
    text = "The river saw the market.\n" * 20_000 + "The far-\nmer."
    got, found = repair(text, model)
    assert found == {"hyphen"} and got.endswith("The farmer.")


def test_tables(spark, corpus):
    extra = spark.createDataFrame(
        [(900, "The steady far-\nmer saw the river.", None, "x"), (900, "The steady far-\nmer saw the river.", None, "x"), (901, None, "the mar-\nket", "x"), (None, "far-\nmer", None, "x"), (902, "", " ", "x")],
        corpus.schema,
    )
    got = {tuple(r) for r in scan_noise(corpus.unionByName(extra)).where("pair_id >= 900").collect()}
    assert got == {(900, "source_text", "hyphen"), (901, "evidence", "hyphen")}
    fixed = {r["pair_id"]: r for r in repaired(corpus.unionByName(extra)).where("pair_id >= 900").collect()}
    assert fixed[901]["evidence"] == "the market" and fixed[901]["source_text"] is None and fixed[902]["source_text"] == ""
    assert scan_noise(corpus.limit(0)).count() == 0 and repaired(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [100, 79_999, 80_000, 537_000, 50_000_000])
def test_misreadings_do_not_depend_on_the_number_of_texts(texts):
    model = ScanModel(texts, {"steady": 20, "well-known": 2})
    assert repair("The stcady river.", model) == ("The steady river.", {"misread"})
    assert repair("A well-\nknown river.", model) == ("A well-known river.", set())


def test_vocabulary_does_not_depend_on_the_number_of_texts(spark):
    rows = [(i, f"river {i}" + (" a well-known dash" if i < 2 else "")) for i in range(60_000)]
    model = fit_scan(count_texts(distinct_texts(spark.createDataFrame(rows, "id long, text string"), ["text"])), 60_000)
    assert model.words["well-known"] == 2 and model.words["river"] == 60_000


def books(rng, pages, source, title):
    """Pages of a book whose title stands on every third one, inside wrapped text; two of them are misread."""
    rows = []
    for i in range(pages):
        words = [rng.choice(WORDS) for _ in range(60)]
        lines = [" ".join(words[k : k + 6]) for k in range(0, 60, 6)]
        if i % 3 == 0:
            lines.insert(4, f"{title if i not in (3, 6) else title.replace('o', 'a', 1)} | {i + 1}")
        rows.append((len(rows), "\n".join(lines) + ".", None, source))
    return rows


def test_headers_are_counted_by_book(spark):
    """Other books change nothing, and a misread title is the title."""
    schema = "pair_id long, source_text string, evidence string, source string"
    rng = random.Random(11)
    small = books(rng, 24, "small", "Stories of the old harbour")
    others = [r for b in range(40) for r in books(rng, 60, f"other {b}", f"Volume of matters {chr(97 + b % 26)}{b}")]

    def found(rows):
        df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], schema)
        return {r["pair_id"] for r in scan_noise(df).where("noise = 'header'").collect() if r["pair_id"] < len(small)}

    assert found(small) == set(range(0, 24, 3)) == found(small + others)
