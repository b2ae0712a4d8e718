"""Decontamination of a benchmark beyond the checked size: joined fingerprints give what broadcast ones give."""

import pytest
from pyspark.sql import functions as F

from carelake.llm import winnow
from carelake.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id long, text string, source string", "item_id string, text string"


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "spans", "items", "key").collect()), key=str)


def test_all_documents_equal(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    small = winnow.contamination(docs, items, with_key=True)
    large = winnow.contamination(docs, items, block_bytes=0, with_key=True)
    assert small.schema.simpleString() == large.schema.simpleString()
    assert _rows(small) == _rows(large)
    assert large.where(F.size("items") > 0).count() > 0


TEN = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def hard(spark):
    docs = [(1, f"a {TEN} b", "x"), (1, f"a {TEN} b", "x"), (1, "short item", "x"), (None, f"{TEN} {TEN}", None), (None, f"{TEN} {TEN}", None),
            (2, None, None), (3, "", "y"), (4, "?! ,", "y"), (5, "nine ten", "z"), (6, f"{TEN} eleven {TEN}", "z"), (7, "one " * 30_000 + TEN, "z"),
            (8, "é" + TEN, "z")]
    items = [("i1", TEN), (None, TEN + " eleven"), (None, "short item"), ("i2", "short item"), ("i3", None), ("i4", ""), ("i5", "?!"), ("i1", "one " * 12),
             ("i6", "nine ten")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)


def test_hard_rows_equal_and_have_values(hard):
    docs, items = hard
    large = winnow.contamination(docs, items, block_bytes=0, with_key=True)
    assert _rows(winnow.contamination(docs, items, with_key=True)) == _rows(large)
    found = winnow.hit_words(large)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str)
    assert (1, 2, 2, ["i2", None]) in got and (2, 0, 0, []) in got and (3, 0, 0, []) in got and (5, 2, 2, ["i6"]) in got
    assert got.count((1, 12, 10, ["i1", "i6", None])) == 2 and got.count((None, 20, 20, ["i1", "i6", None])) == 2
    assert (7, 30_010, 30_010, ["i1", "i6", None]) in got
    assert [list(s) for s in found.where("doc_id = 6").first()["spans"]] == [[0, 21]]
    assert (8, 10, 2, ["i6"]) in got


def test_empty_tables_and_clean(spark, hard, monkeypatch):
    docs, items = hard
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert winnow.contamination(none_d, items, block_bytes=0).count() == 0
    assert winnow.hit_words(winnow.contamination(docs, none_i, block_bytes=-1)).where("n_hit = 0 and size(items) = 0").count() == docs.count()
    monkeypatch.setattr(winnow.contamination, "__defaults__", (0, False))
    kept = winnow.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
