"""Queries of the operators in this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of scanning noise in each source text and evidence."""
    from pothi.llm.scan_repair import scan_noise

    return scan_noise(_table(spark, folder, "nctb_qa"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Source texts and evidence as continuous paragraphs."""
    from pothi.llm.scan_repair import repaired

    return repaired(_table(spark, folder, "nctb_qa").select("pair_id", "source", "evidence", "source_text").distinct())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are not in the consistent form."""
    from pothi.llm.unicode_form import unstable_fields

    return unstable_fields(_table(spark, folder, "nctb_qa"), "pair_id", ["question", "answer", "source_text"])


def p2_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """The records with question, answer and source_text in the consistent form."""
    from pothi.llm.unicode_form import normalise

    fields = ["question", "answer", "source_text"]
    return normalise(_table(spark, folder, "nctb_qa").select("pair_id", *fields).distinct(), fields)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose label does not name the one language of the question, with each language of the question."""
    from pothi.llm.language_id import record_languages

    found = record_languages(_table(spark, folder, "nctb_qa"))
    return found.where((~F.col("label_right")) & (F.col("language") != "und")).select("pair_id", "language").distinct()


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each language of each record with its confidence."""
    from pothi.llm.language_id import record_languages

    return record_languages(_table(spark, folder, "nctb_qa")).distinct()


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment of each question with its language and confidence."""
    from pothi.llm.language_id import segment_languages

    return segment_languages(_table(spark, folder, "nctb_qa")).distinct()


def _sampled(spark: SparkSession, folder: str):
    from pothi.llm.proportional_sample import sample_to_targets

    return sample_to_targets(_table(spark, folder, "nctb_qa"), _table(spark, folder, "target_mix"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that cannot be met by a sample of half of the pairs."""
    return _sampled(spark, folder).report.where(~F.col("can_be_met")).select("language", "subject", "class_num")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with what is available and what was sampled."""
    return _sampled(spark, folder).report


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample."""
    return _sampled(spark, folder).sample


P4_FOUND_SQL = """
WITH pairs AS (SELECT DISTINCT pair_id, language, subject, class_num FROM nctb_qa),
n AS (SELECT floor(count(DISTINCT pair_id) / 2) AS size FROM nctb_qa),
have AS (SELECT language, subject, class_num, count(DISTINCT pair_id) AS available FROM pairs GROUP BY ALL)
SELECT t.language, t.subject, t.class_num FROM target_mix t CROSS JOIN n LEFT JOIN have h
  ON h.language = t.language AND h.subject = t.subject AND h.class_num = t.class_num
WHERE coalesce(h.available, 0) < greatest(t.min_rows, floor(t.target_permille * n.size / 1000))
"""


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records alike of which exactly one stands in train."""
    from pothi.llm.cross_split import cross_split_pairs

    pairs = cross_split_pairs(_table(spark, folder, "nctb_qa"))
    return pairs.select(F.col("a").alias("pair_id_a"), F.col("b").alias("pair_id_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps counted by split and source."""
    from pothi.llm.cross_split import overlap_report

    return overlap_report(_table(spark, folder, "nctb_qa"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class of exact copies, on its side of the split, of each record."""
    from pothi.llm.cross_split import cross_split_classes

    return cross_split_classes(_table(spark, folder, "nctb_qa")).withColumnRenamed("id", "pair_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs with the kind of defect."""
    from pothi.llm.pair_defects import find_defects

    return find_defects(_table(spark, folder, "nctb_qa"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of records that share at least 0.8 of their words."""
    from pothi.llm.near_duplicates import near_duplicate_pairs

    pairs = near_duplicate_pairs(_table(spark, folder, "nctb_qa"))
    return pairs.select(F.col("a").alias("pair_id_a"), F.col("b").alias("pair_id_b"))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class, group and number of links of each record."""
    from pothi.llm.near_duplicates import near_duplicate_groups

    return near_duplicate_groups(_table(spark, folder, "nctb_qa")).withColumnRenamed("id", "pair_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    from pothi.llm.token_tree import encode_corpus

    return encode_corpus(_table(spark, folder, "documents"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from pothi.llm.packing import pack
    from pothi.llm.token_tree import token_counts

    documents = _table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("text").rlike(r"(?U)\S"), F.col("text")).alias("text")
    )
    packs = _table(spark, folder, "pack_sizes")
    return pack(token_counts(documents), packs), packs


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every document, or piece of one, for each capacity."""
    return _packed(spark, folder)[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    from pothi.llm.packing import pack_report

    return pack_report(*_packed(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold template residue, filler, or messages of the delivering system."""
    from pothi.llm.residue import find_residue

    return find_residue(_table(spark, folder, "documents")).select("doc_id").distinct()


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are left once residue is excluded."""
    from pothi.llm.residue import without_residue

    return without_residue(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_repaired, p2_found, p2_normalised, p3_found, p3_records, p3_segments, p4_found, p4_report, p4_sample, p5_found, p5_report, p5_classes, p6_found, p7_found, p7_groups, p8_ids, p9_packed, p9_report, p10_found, p10_clean)
}

ORACLES: dict[str, str] = {"p4_found": P4_FOUND_SQL}
