"""Corpus pipeline: language, near-duplicates, benchmark decontamination, source mix, Hilbert shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``, and extra columns as they are, whatever their
names.  An empty table gives an empty result in every stage; texts of any length are
used whole; a null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelake.llm import language, mixing, neardup, sharding, winnow
from carelake.llm.common import scratch_uri, table
from carelake.session import apply_runtime_conf


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language of share 0.4 or more, go.

    Null and empty texts have no letters.  The labels that are learned from are those of ``docs`` itself; a null
    ``lang`` or id is no reason to go.  Repeated rows go or stay together.
    """
    apply_runtime_conf(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Texts without words (null, empty, white space) all stay.  Rows without an id are compared too and are the last of
    their group; different texts of one id are different documents; of rows alike in id and text one stays.
    """
    apply_runtime_conf(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Texts without words stay, also ids that are null; items without words match nothing, items without an id match like
    others.  Repeated rows go or stay together.
    """
    apply_runtime_conf(spark)
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their targets: documents appear as often as the mix takes them, or not at all.

    A null source is a source.  Texts without words have size 0, cost nothing and appear as often as their source's
    complete passes; null ids draw their keys from the text.  Rows alike in id, text and source draw one key; where the
    budget ends among them some appear once more than the others.
    """
    apply_runtime_conf(spark)
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard (0 to 7) and slot; rows in Hilbert order.

    Columns of these names are replaced.  Nulls in lang, source, text or id are values of their own; ties on the curve
    go by checksum, size, id, lang and source, and repeated rows get slots one after the other.
    """
    apply_runtime_conf(spark)
    return sharding.place_documents(docs, 8)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix_sources), ("shard", shard)]

#: language and the sampling keys are beyond SQL; the tests hold run() against a plain Python version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_uri(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
