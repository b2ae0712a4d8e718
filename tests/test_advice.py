"""Rows that a reviewer found missing."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from carelake.plans.tables import TABLES
from carelake.sources.docx import build_docx
from carelake.sources.extract import extract_lines, extract_text
from oracle_harness import compare, duck

SMALL = "/root/testdata/sf0.001"


def test_files_without_a_path_keep_their_rows(spark):
    files = spark.createDataFrame([(None, b"one"), (None, b"two"), ("u/a.txt", b"three"), ("u/b.docx", build_docx(["four"]))], "path string, content binary")
    assert sorted((r.path or "", r.text) for r in extract_text(files).collect()) == [("", "one"), ("", "two"), ("u/a.txt", "three"), ("u/b.docx", "four")]
    assert extract_lines(files).where("path is null").count() == 2


def test_extract_text_matches_its_sql_with_null_languages(spark, tmp_path):
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    (docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).toPandas()
     .to_parquet(tmp_path / "documents.parquet"))
    got = E.queries()["extract_text"](spark, str(tmp_path))
    assert got.where("path like '%.txt'").count() == docs.where("doc_id % 3 = 0").count() > 1
    for name in ("extract_text", "question_context"):
        assert not compare(E.queries()[name](spark, str(tmp_path)), duck(str(tmp_path)), E.oracle_sql()[name])
