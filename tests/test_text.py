import pytest
from pyspark.sql import functions as F

from pothi.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "normal"),
    [
        ("The answer is: শাপলা।", "শাপলা"),
        ("২০", "20"),
        ("Based on the passage, X is Y", "x is y"),
        ("Based on the passage X is Y", ""),
        ("  A,  b-c \n d ", "a b c d"),
        ("...", ""),
        ("", ""),
        (None, None),
    ],
)
def test_normal_form(spark, raw, normal):
    assert one(spark, raw, text.normal_form) == normal


@pytest.mark.parametrize(
    ("raw", "stem"),
    [("testing", "test"), ("cities", "cit"), ("plants", "plants"), ("being", "being"), ("operation", "opera"), ("বইগুলো", "বইগুলো")],
)
def test_stem(spark, raw, stem):
    assert one(spark, raw, text.stem) == stem


@pytest.mark.parametrize(("raw", "expanded"), [("What is RAM", "What is RAM RAM"), ("RAM", "RAM"), ("২০ টাকা", "২০ টাকা 20 টাকা")])
def test_expand_query(spark, raw, expanded):
    assert one(spark, raw, text.expand_query) == expanded


def test_tokens_split_where_python_does(spark):
    for raw in ("", "  ", "A b c　D\ne", "x"):
        assert one(spark, raw, text.tokens) == raw.lower().split()


@pytest.mark.parametrize(
    ("name", "parsed"),
    [
        ("ICT_ben_class6.pdf", ("ICT", "ben", "bn", 6, "class6_bn")),
        ("Earth_Sci_ENG_class10.PDF", ("Earth_Sci", "eng", "en", 10, "class10_en")),
        ("notes.pdf", None),
        ("ICT_fra_class6.pdf", None),
        ("ICT_ben_classX.pdf", None),
    ],
)
def test_parse_filename(spark, name, parsed):
    got = one(spark, name, text.parse_filename)
    assert (tuple(got) if got else None) == parsed


def test_lookups(spark):
    row = (
        spark.createDataFrame([("ICT", 7, "bn"), ("Music", 11, "hi")], "s string, c int, l string")
        .select(text.subject_code(F.col("s")), text.grade_band(F.col("c")), text.script(F.col("l")), text.chunk_key(F.col("c")))
        .collect()
    )
    assert [tuple(r) for r in row] == [("ict", "junior_sec", "bengali", "chunk_000007"), ("music", "unknown", "latin", "chunk_000011")]


def test_output_path(spark):
    path = text.output_path("out", F.lit("class6_bn"), F.lit("ICT_ben_class6.pdf"), ".json")
    assert spark.range(1).select(path).first()[0] == "out/class6_bn/ICT_ben_class6.json"
