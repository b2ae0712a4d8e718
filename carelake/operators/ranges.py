"""Joins of points with ranges of values.

A condition such as ``value > high`` gives Spark one equality at most (the test), so it would compare every reading of
a test with every bound of it.  Here the values of each key are cut into bins, and the bins are the leaves of a binary
tree:

* the cuts are approximate quantiles of the ranges' own ends, and each cut is a bin of its own;
* a range takes the few tree nodes that cover the bins wholly inside it (two a level at the most), plus the bins in which it ends;
* a point takes its bin's ancestors, but only those that some range of its key has taken;
* both meet by equality of (key, node).  Only in a bin where a range ends are values compared.

So a pair that meets is a result, or one of the 1/``bins`` of pairs that meet in an end's bin; a point that no range
can hold never leaves its task.  A key or node with a large part of the rows is an ordinary skewed join key, which
AQE splits on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256


def _position(edges: Column, value: Column, bins: int) -> Column:
    """Bin of a value: 2 i + 1 on the i-th edge, else twice the number of edges below it; null for null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((bins + 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(edges, n + s - 1) < value, n + s).otherwise(n))
    return F.when(value.isNotNull(), 2 * below + F.when(F.get(edges, below) == value, 1).otherwise(0))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """Tree nodes that together hold the bins ``first`` to ``last`` (none if they cross), each bin once."""
    nodes = []
    for level in range(levels + 1):
        a, b = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(last + 1, level)
        top = 1 << (levels - level)
        nodes += [F.when((a < b) & (a % 2 == 1), a + top), F.when((a < b) & (b % 2 == 1), b - 1 + top)]
    return F.array_compact(F.array(*nodes))


def range_join(points: DataFrame, ranges: DataFrame, on: str, value: str, start: str, end: str,
               closed: bool = False, bins: int = BINS) -> DataFrame:
    """Pairs of a point and a range of the same ``on`` with start < value < end (``closed``: <=).

    A null end of a range is open to that side; a range whose ends cross holds nothing; null keys and null values
    meet nothing; NaN is above every number.  Repeated points and ranges give a pair each.  The result has the columns
    of both, ``on`` once; other columns must not share names.
    """
    levels = (2 * (bins + 2)).bit_length()
    cuts = F.percentile_approx("_rj_end", [i / bins for i in range(bins + 1)], 100 * bins)
    edges = (ranges.where(F.col(on).isNotNull()).select(on, F.explode(F.array(start, end)).alias("_rj_end"))
             .groupBy(on).agg(cuts.alias("_rj_cuts")))
    empty = F.slice(F.array("_rj_low", "_rj_high"), 1, 0)
    a, b = F.col("_rj_a"), F.col("_rj_b")

    placed = (ranges.join(edges, on).withColumns({"_rj_low": F.col(start), "_rj_high": F.col(end)})
              .withColumn("_rj_edges", F.coalesce(F.array_sort(F.array_distinct("_rj_cuts")), empty))
              .withColumns({"_rj_a": _position(F.col("_rj_edges"), F.col(start), bins), "_rj_b": _position(F.col("_rj_edges"), F.col(end), bins)}))
    # Bins on an edge hold one value, so a range that ends there has them whole or not at all.
    on_edge = F.lit(0 if closed else 1)
    inner = _cover(F.coalesce(F.when(a % 2 == 1, a + on_edge).otherwise(a + 1), F.lit(0)),
                   F.coalesce(F.when(b % 2 == 1, b - on_edge).otherwise(b - 1), F.lit((1 << levels) - 1)), levels)
    ends = F.array_distinct(F.array_compact(F.array(F.when(a % 2 == 0, a + (1 << levels)), F.when(b % 2 == 0, b + (1 << levels)))))
    taken = F.concat(F.transform(inner, lambda n: F.struct(n.alias("node"), F.lit(True).alias("whole"))),
                     F.transform(ends, lambda n: F.struct(n.alias("node"), F.lit(False).alias("whole"))))
    placed = (placed.withColumn("_rj", F.explode(taken)).withColumns({"_rj_node": F.col("_rj.node"), "_rj_whole": F.col("_rj.whole")})
              .drop("_rj", "_rj_a", "_rj_b"))

    used = placed.groupBy(on).agg(F.collect_set("_rj_node").alias("_rj_used"), F.first("_rj_edges").alias("_rj_edges"))
    bin_of = F.col("_rj_bin")
    ancestors = F.array(*[F.shiftright(bin_of, level) + (1 << (levels - level)) for level in range(levels + 1)])
    found = (points.join(used, on).withColumn("_rj_bin", _position(F.col("_rj_edges"), F.col(value), bins))
             .where(bin_of.isNotNull()).withColumn("_rj_node", F.explode(F.array_intersect(ancestors, "_rj_used")))
             .drop("_rj_bin", "_rj_used", "_rj_edges"))

    v, low, high = F.col(value), F.col("_rj_low"), F.col("_rj_high")
    inside = ((low.isNull() | ((v >= low) if closed else (v > low))) & (high.isNull() | ((v <= high) if closed else (v < high))))
    pairs = found.join(placed.drop("_rj_cuts", "_rj_edges"), [on, "_rj_node"]).where(F.col("_rj_whole") | inside)
    return pairs.drop("_rj_node", "_rj_whole", "_rj_low", "_rj_high")
