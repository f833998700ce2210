"""Book files: listing, audit, page extraction, and readers and writers of stage tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.functions.text import parse_filename
from pothi.plugins import PageExtractor

#: A page counts as text from this many characters on; share of text pages; pages looked at.
PAGE_CHARACTERS, TEXT_SHARE, SAMPLED_PAGES = 30, 0.6, 5
PARSED = ("subject", "lang", "lang_code", "class_num", "folder_key")


def list_books(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Rows of the files under a folder whose names parse, with size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    named = files.select(F.col("path").alias("full_path"), F.col("length"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"))
    return with_parsed_name(named).withColumn("file_size_mb", F.round(F.col("length") / 1048576, 2))


def with_parsed_name(df: DataFrame, name: str = "filename") -> DataFrame:
    """Rows whose name fits, with what it says; other rows are skipped."""
    return df.withColumn("_name", parse_filename(F.col(name))).where("_name is not null").select(*(c for c in df.columns if c not in PARSED), "_name.*")


def extraction_method(lang_code: Column, text_pages: Column, sampled: Column) -> Column:
    """How a file is read: Bengali by OCR, others natively when enough sampled pages hold text (also when there are none)."""
    return F.when(lang_code == "bn", "ocr").when(text_pages >= TEXT_SHARE * sampled, "native").otherwise("ocr")


def extract_pages(files: DataFrame, extractor: PageExtractor, first: int | None = None) -> DataFrame:
    """Rows (filename, page_num, text, error) of files (filename, content); a file that fails gives one row with its error.

    With ``first`` only so many pages are extracted, where the extractor can stop early (``first_pages``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for name, content in zip(pdf["filename"], pdf["content"], strict=True):
                try:
                    some = getattr(extractor, "first_pages", None) if first is not None else None
                    pages = some(bytes(content), first) if some else extractor.pages(bytes(content))[:first]
                    rows += [(name, i, p.strip(), None) for i, p in enumerate(pages, 1)]
                except Exception as e:  # noqa: BLE001 - a broken file must not stop the others
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filename", "page_num", "text", "error"])

    return files.select("filename", "content").mapInPandas(run, "filename string, page_num int, text string, error string")


def audit(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files with page count, method, status and error, from all extracted pages of which the first are sampled."""
    sampled = F.col("page_num") <= SAMPLED_PAGES
    per_file = pages.groupBy("filename").agg(
        F.count_if(F.col("error").isNull()).alias("page_count"),
        F.count_if(sampled & F.col("error").isNull()).alias("_sampled"),
        F.count_if(sampled & (F.char_length("text") >= PAGE_CHARACTERS)).alias("_text"),
        F.max("error").alias("error"),
    )
    out = files.join(per_file, "filename", "left")
    failed = F.col("error").isNotNull()
    return out.withColumns(
        {
            "extraction_method": F.when(~failed, extraction_method(F.col("lang_code"), F.coalesce("_text", F.lit(0)), F.coalesce("_sampled", F.lit(0)))),
            "status": F.when(failed, "audit_failed").otherwise("audited"),
        }
    ).drop("_sampled", "_text")


def sampled_audit(files: DataFrame, contents: DataFrame, extractor: PageExtractor) -> DataFrame:
    """Files with method, status and error, from their first pages only, before anything is extracted in full.

    ``page_count`` is that of the sample here; extraction tells the rest.
    """
    return audit(files, extract_pages(contents, extractor, SAMPLED_PAGES))


def to_extract(audited: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Audited files that have no result yet (``done`` has filename), each with the branch that reads it; failed ones are left out."""
    todo = audited.where((F.col("status") != "audit_failed") & F.col("extraction_method").isNotNull())
    if done is not None:
        todo = todo.join(done.select("filename").distinct(), "filename", "left_anti")
    return todo.withColumn("branch", F.when(F.col("extraction_method") == "native", "native").otherwise("ocr"))


def run_extraction(audited: DataFrame, contents: DataFrame, native: PageExtractor, ocr: PageExtractor, done: DataFrame | None = None) -> DataFrame:
    """Rows (filename, page_num, text, error, extraction_method) of the files that have no result yet, each read by its method.

    The two branches are separate plans, so a slow recognition never holds up native reading in one task.
    """
    todo = to_extract(audited, done).select("filename", "branch")
    parts = []
    for branch, extractor in (("native", native), ("ocr", ocr)):
        mine = contents.join(todo.where(F.col("branch") == branch).select("filename"), "filename", "left_semi")
        parts.append(extract_pages(mine, extractor).withColumn("extraction_method", F.lit(branch)))
    return parts[0].unionByName(parts[1])


def extraction_status(audited: DataFrame, pages: DataFrame) -> DataFrame:
    """Audited files with the outcome of extraction: done, failed (with its error), or not attempted."""
    outcome = pages.groupBy("filename").agg(F.count_if(F.col("error").isNull()).alias("extracted_pages"), F.max("error").alias("extraction_error"))
    status = F.when(F.col("extraction_error").isNotNull(), "extraction_failed").when(F.col("extracted_pages").isNotNull(), "extracted").otherwise(F.col("status"))
    return audited.join(outcome, "filename", "left").withColumn("status", status)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON, an array of records."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Lines of JSON; the commit protocol makes the write atomic."""
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for tables of a row for each configuration."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, by: str = "folder_key") -> None:
    """Parquet with a folder for each value, in place of one result file for each source."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
