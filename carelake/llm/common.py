"""Helpers shared by the operators: reliable cuts, distributed ranks, table access."""

from __future__ import annotations

import gc
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.session import checkpoint_root

#: a word as most operators count it
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: lineage ends there and lost executors don't matter."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder; whoever writes first creates it."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle and checkpoint files of finished steps (Spark frees them when their owners are collected)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: rows of keys that may be broadcast (some tens of MB); beyond, the join shuffles
BROADCAST_ROWS = 2_000_000


def checked(keys: DataFrame) -> DataFrame:
    """Distinct keys, cut, marked for broadcast if they are few enough."""
    keys = cut(keys.distinct())
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def only(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids`` (one column)."""
    return df.join(checked(ids), on, "left_semi")


def text_key(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _by_key(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    named = checked(named.select("doc_id", "key")).alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (text_key("d.text") == F.col("b.key"))
    return docs.alias("d").join(named, same, how).select(*docs.columns)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows named by ``bad`` (doc_id, key): the id, null or not, and the text's hash."""
    return _by_key(docs, bad, "left_anti")


def within(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are named by ``good``, as in ``without``."""
    return _by_key(docs, good, "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a lambda body otherwise re-evaluates what it names)."""
    return F.transform(F.array(value), body)[0]


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def ranked(df: DataFrame, order: list[str], groups: list[str] | None = None, weight: str | None = None,
           partitions: int | None = None) -> DataFrame:
    """Add ``before``: rows (or the sum of ``weight``) that precede a row of its group in ``order``, for any group size.

    Range partitioning deals a hot group over many tasks, each task counts its
    own run, and only one total per (group, task) is summed again; no group is
    ever gathered in one task.  ``groups`` must lead the order.  The ordered
    rows are cut first, so that both passes see the same partitions.
    """
    groups = groups or []
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = [*groups, *[c for c in order if c not in groups]]
    run = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
           .withColumn("_part", F.spark_partition_id())
           .withColumn("_pos", F.monotonically_increasing_id()))
    run = cut(run)
    w = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("long")
    # null-safe group keys: a null group is a group of its own
    keys = [F.struct(F.col(g)).alias(f"_g{i}") for i, g in enumerate(groups)]
    run = run.select("*", w.alias("_w"), *keys)
    names = [f"_g{i}" for i in range(len(groups))]
    own = Window.partitionBy("_part", *names).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most one total per task, and one more per group
    totals = run.groupBy("_part", *names).agg(F.sum("_w").alias("_t"))
    ahead = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).drop("_t")
    out = run.withColumn("_own", F.sum("_w").over(own) - F.col("_w")).join(totals, ["_part", *names])
    return out.withColumn("before", F.col("_own") + F.col("_ahead")).drop("_part", "_pos", "_w", "_own", "_ahead", *names)
