"""Skew-safe "last value so far" per key.

A plain ``last(x) over (partition by key order by t)`` puts every row of a key
into one task; a key holding a third of all rows would then be sorted by one
core.  ``carry_last`` splits each key into ordered *buckets* (a coarse,
monotone function of the order columns, e.g. the hour of the timestamp):

1. inside each (key, bucket) the running value is a window over a bounded slice;
2. each (key, bucket) is summarised to its last non-null value (partial
   aggregation on data that is already partitioned by (key, bucket));
3. the summary -- one row per (key, bucket) -- is scanned per key to get the
   value carried into each bucket;
4. the carry-in is joined back on (key, bucket) and fills the gaps.

Steps 2-4 only move the small summary table; the big side keeps the
(key, bucket) hash partitioning it got in step 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import checkpoint_root


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str,
               value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = last non-null ``value`` over rows of the same ``keys`` that
    sort before this row by ``order`` (and the row itself when ``inclusive``).

    ``bucket`` must be non-decreasing in ``order`` within a key.
    """
    keys = list(keys)
    order_cols = [F.col(c) for c in order]
    hi = 0 if inclusive else -1
    w_local = (Window.partitionBy(*keys, bucket).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, hi))
    local = df.withColumn("_cl_local", F.last(F.col(value), ignorenulls=True).over(w_local))

    # Every bucket gets a summary row (null when it holds no value), so the
    # carry-in reaches buckets that have none of their own.
    tagged = F.when(F.col(value).isNotNull(), F.struct(*order_cols, F.col(value).alias("_v")))
    summary = (local.groupBy(*keys, bucket)
               .agg(F.max(tagged)["_v"].alias("_cl_bucket_last")))
    w_carry = (Window.partitionBy(*keys).orderBy(F.col(bucket))
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (summary
             .withColumn("_cl_carry", F.last("_cl_bucket_last", ignorenulls=True).over(w_carry))
             .select(*keys, bucket, "_cl_carry"))

    return (local.join(carry, on=[*keys, bucket], how="left")
            .withColumn(out, F.coalesce(F.col("_cl_local"), F.col("_cl_carry")))
            .drop("_cl_local", "_cl_carry"))


def hour_bucket(ts: Column) -> Column:
    """Default bucket: whole hours since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("long")


#: rows of a key that one bucket may hold before it is cut finer
DENSE_ROWS = 200_000
_EDGES = 128


def dense_buckets(df: DataFrame, keys: Sequence[str], coarse: str, order: Sequence[str], out: str, most: int | None = DENSE_ROWS) -> DataFrame:
    """Add ``out``, a bucket for ``carry_last``: (coarse, cell, tie).

    ``coarse`` (whole hours, say) is enough for most keys.  Where a key has
    more than ``most`` rows in one of them, a sketch of its first order
    column (approximate quantiles) gives cells of like size, each edge a cell of
    its own; a cell that is still too large, rows of one time that is, is cut by the second
    order column in the same way.  Only such rows are looked at again, and
    their sketches, one per ``most`` rows at the most, are broadcast.
    """
    plain = F.struct(F.col(coarse).alias("coarse"), F.lit(0).alias("cell"), F.lit(0).alias("tie"))
    if most is None:
        return df.withColumn(out, plain)
    group, t, u = [*keys, coarse], F.col(order[0]).cast("double"), F.col(order[1]).cast("double")
    checkpoint_root(df.sparkSession)
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n").checkpoint()
    if hot.isEmpty():
        return df.withColumn(out, plain)

    def edges(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
        cuts = F.percentile_approx(value, [i / _EDGES for i in range(1, _EDGES)], 10_000)
        return rows.groupBy(*by).agg(F.array_sort(F.array_distinct(cuts)).alias(name)).checkpoint()

    def cell(value: Column, name: str) -> Column:
        below = F.size(F.filter(name, lambda e: e < value))
        return F.when(F.col(name).isNull() | value.isNull(), 0).otherwise(2 * below + F.when(F.array_contains(name, value), 1).otherwise(0))
    times = edges(df.join(F.broadcast(hot), group), group, t, "_times")
    df = df.join(F.broadcast(times), group, "left").withColumn("_cell", cell(t, "_times"))
    crowded = df.where(F.col("_times").isNotNull() & (F.col("_cell") % 2 == 1))
    again = crowded.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
    ties = edges(crowded.join(F.broadcast(again), [*group, "_cell"]), [*group, "_cell"], u, "_ties")
    df = df.join(F.broadcast(ties), [*group, "_cell"], "left").withColumn("_tie", cell(u, "_ties"))
    return df.withColumn(out, F.struct(F.col(coarse).alias("coarse"), F.col("_cell").alias("cell"), F.col("_tie").alias("tie"))).drop("_times", "_cell", "_ties", "_tie")


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str,
               value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``keys`` in ``order`` (the row
    itself included when ``inclusive``), computed bucket-wise like ``carry_last``."""
    keys = list(keys)
    order_cols = [F.col(c) for c in order]
    hi = 0 if inclusive else -1
    w_local = (Window.partitionBy(*keys, bucket).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, hi))
    local = df.withColumn("_ps_local", F.coalesce(F.sum(F.col(value)).over(w_local), F.lit(0)))
    summary = local.groupBy(*keys, bucket).agg(F.sum(F.col(value)).alias("_ps_bucket"))
    w_carry = (Window.partitionBy(*keys).orderBy(F.col(bucket))
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (summary.withColumn("_ps_carry", F.coalesce(F.sum("_ps_bucket").over(w_carry), F.lit(0)))
             .select(*keys, bucket, "_ps_carry"))
    return (local.join(carry, on=[*keys, bucket], how="left")
            .withColumn(out, F.col("_ps_local") + F.col("_ps_carry"))
            .drop("_ps_local", "_ps_carry"))
