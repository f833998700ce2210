import pytest

from pothi.operators.chunking import number_rows, split_pages, windows


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("x" * 40, []),
        ("x" * 51, [(0, 51)]),
        ("x" * 500, [(0, 500)]),
        ("x" * 540, [(0, 540)]),
        ("x" * 551, [(0, 551), (500, 51)]),
        ("x" * 700, [(0, 700), (500, 200)]),
        ("x" * 900, [(0, 900), (700, 200)]),
        ("x" * 1000, [(0, 1000), (800, 200)]),
        ("x" * 1001, [(0, 1000), (800, 201)]),
        ("x" * 2300, [(0, 1000), (800, 1000), (1600, 700), (2100, 200)]),
        ("a" * 600 + "।" + "b" * 300 + "." + "c" * 700, [(0, 601), (500, 1000), (1300, 302)]),
        ("a" * 400 + "।" + "b" * 300 + "." + "c" * 900, [(0, 702), (502, 1000), (1302, 300)]),
        ("", []),
        (None, []),
    ],
)
def test_windows(page, expected):
    assert [(start, len(chunk)) for start, chunk in windows(page)] == expected


def test_split_pages(spark):
    pages = spark.createDataFrame([(1, "  " + "x" * 551 + "\n"), (2, "   "), (3, None), (4, "y" * 60)], "k long, text string")
    got = split_pages(pages, "k").orderBy("k", "chunk_pos").collect()
    assert [(r["k"], r["chunk_pos"], r["start"], r["char_count"]) for r in got] == [(1, 0, 0, 551), (1, 1, 500, 51), (4, 0, 0, 60)]


def test_windows_cover_long_pages():
    page = "".join(f"Sentence number {i} stands here. " for i in range(900)).strip()
    ends = [start + len(chunk) for start, chunk in windows(page)]
    starts = [start for start, _ in windows(page)]
    assert starts[0] == 0 and max(ends) >= len(page) - 1
    assert all(b <= a for a, b in zip(ends, starts[1:], strict=False))


def test_number_rows(spark):
    df = spark.createDataFrame([(b, p) for b in "cab" for p in range(40)], "book string, page int").repartition(7)
    got = number_rows(df, ["book", "page"]).orderBy("chunk_id").collect()
    assert [(r["book"], r["page"]) for r in got] == [(b, p) for b in "abc" for p in range(40)]
    assert [r["chunk_id"] for r in got] == list(range(120))
