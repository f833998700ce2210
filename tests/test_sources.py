from pyspark.sql import functions as F

from pothi.plugins import PlainTextExtractor
from pothi.sources import files


def test_list_extract_audit(spark, tmp_path):
    book = tmp_path / "a"
    book.mkdir()
    (book / "ICT_eng_class6.pdf").write_text("x" * 40 + "\f" + "short")
    (book / "Science_ben_class9.pdf").write_text("y" * 40)
    (book / "Music_eng_class7.pdf").write_bytes(b"\xff\xfe\x00")
    (book / "notes.pdf").write_text("no")
    found = files.list_books(spark, str(tmp_path))
    assert sorted(r["filename"] for r in found.collect()) == ["ICT_eng_class6.pdf", "Music_eng_class7.pdf", "Science_ben_class9.pdf"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    pages = files.extract_pages(raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content"), PlainTextExtractor())
    got = {r["filename"]: r for r in files.audit(found, pages).collect()}
    assert got["ICT_eng_class6.pdf"]["extraction_method"] == "ocr" and got["ICT_eng_class6.pdf"]["page_count"] == 2
    assert got["Science_ben_class9.pdf"]["extraction_method"] == "ocr" and got["Science_ben_class9.pdf"]["folder_key"] == "class9_bn"
    assert got["Music_eng_class7.pdf"]["status"] == "audit_failed" and got["Music_eng_class7.pdf"]["error"]


def test_method(spark):
    df = spark.createDataFrame([("bn", 5, 5), ("en", 3, 5), ("en", 2, 5), ("en", 0, 0)], "l string, t int, n int")
    assert [r[0] for r in df.select(files.extraction_method(F.col("l"), F.col("t"), F.col("n"))).collect()] == ["ocr", "native", "ocr", "native"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "শাপলা", "k1"), (2, None, "k2")], "id long, name string, folder_key string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert sorted(files.read_csv(spark, f"{tmp_path}/csv", "id long, name string, folder_key string").collect()) == sorted(df.collect())
    files.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    files.write_partitioned(df, f"{tmp_path}/parquet")
    assert (tmp_path / "parquet" / "folder_key=k1").is_dir()
    (tmp_path / "whole.json").write_text('[{"id": 1, "name": "x"},\n {"id": 2}]')
    assert files.read_json(spark, f"{tmp_path}/whole.json", "id long, name string").count() == 2
