"""Physical-plan properties that matter at scale: pushdown, pruning, bounded
broadcasts, pre-shuffle top-k and bucketed scans."""

import __spark_entry__ as E
from conftest import SF_SMALL
from pyspark.sql import functions as F

from carelake.operators.scan import carry_last


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    p = plan(E.queries()["lab_filter"](spark, SF_SMALL))
    # the filter above the union of files reaches every file's scan
    assert p.count("GreaterThan(l_quantity,") == 3 and p.count("EqualTo(l_returnflag,") == 3
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in p


def test_max_reading_prunes_columns(spark):
    p = plan(E.queries()["max_reading"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


def test_thresholds_broadcast_after_check(spark):
    p = plan(E.queries()["critical_labs"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "Expand" in p   # one lineitem scan, unpivoted


def test_history_tail_is_limited_before_shuffle(spark):
    p = plan(E.queries()["fold_conversations"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_carry_last_partitions_by_key_and_bucket(spark):
    hot = F.when(F.col("id") % 1000 < 990, F.lit("hot")).otherwise(F.lit("cold"))   # 99% of rows on one key
    df = spark.range(1000).select(hot.alias("k"), F.col("id").alias("t"),
                                  (F.col("id") % 7 == 0).alias("v"), (F.col("id") / 100).cast("long").alias("b"))
    out = carry_last(df.withColumn("v", F.when(F.col("v"), F.col("t"))), ["k"], ["t"], "b", "v", "o")
    p = plan(out)
    import re
    # the window over the raw rows is partitioned by (key, bucket), never by the key alone
    assert re.search(r"Exchange hashpartitioning\(k#\d+L?, b#\d+L?, \d+\)", p)
    # a key-only shuffle moves just the per-bucket summary (an aggregate's output)
    for m in re.finditer(r"Exchange hashpartitioning\(k#\d+L?, \d+\)", p):
        below = p[m.end():].split("Exchange", 1)[0]
        assert "Aggregate" in below
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("v", F.when(F.col("v"), F.col("t"))).withColumn("o", F.last("v", ignorenulls=True).over(w))
    assert sorted(map(tuple, out.select("t", "o").collect())) == sorted(map(tuple, ref.select("t", "o").collect()))


def test_inventory_reads_no_bytes(spark):
    p = plan(E.queries()["file_inventory_sql"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in p


def test_top_k_uses_limit(spark):
    p = plan(E.queries()["sql_topk"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
