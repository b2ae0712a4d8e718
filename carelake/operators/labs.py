"""Cross-file lab questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators.ranges import BINS, range_join

_OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "=": "__eq__", "!=": "__ne__"}


def lab_filter(dfs: Sequence[DataFrame], test: str, op: str, value: float,
               test_col: str = "test", value_col: str = "value") -> DataFrame:
    """Rows of any of the files whose ``test`` reading satisfies ``op value``;
    files are aligned by column name (missing columns are null)."""
    union = dfs[0]
    for d in dfs[1:]:
        union = union.unionByName(d, allowMissingColumns=True)
    cmp = getattr(F.col(value_col), _OPS[op])(F.lit(value))
    return union.where((F.col(test_col) == test) & cmp)


def critical_labs(labs: DataFrame, thresholds: DataFrame, test: str = "test", value: str = "value") -> DataFrame:
    """Readings strictly outside their test's [low, high] range.

    The threshold table is one row per test code; Spark broadcasts it below its
    own size limit and otherwise joins by shuffle, splitting hot tests.
    """
    j = labs.join(thresholds, on=test, how="inner")
    return j.where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def critical_labs_ranged(labs: DataFrame, thresholds: DataFrame, test: str = "test", value: str = "value",
                         bins: int = BINS) -> DataFrame:
    """``critical_labs`` for any number of overlapping bounds per test: a reading meets the bounds that it breaks, not
    every bound of its test.  A null ``low`` or ``high`` bounds nothing on that side."""
    sides = F.array(F.struct(F.lit(None).cast("double").alias("start"), F.col("low").cast("double").alias("end")),
                    F.struct(F.col("high").cast("double").alias("start"), F.lit(None).cast("double").alias("end")))
    outside = (thresholds.withColumn("_side", F.explode(sides)).withColumns({"_above": F.col("_side.start"), "_below": F.col("_side.end")})
               .drop("_side").where(F.col("_above").isNotNull() | F.col("_below").isNotNull()))
    # A reading under a low and over a high that cross counts once.
    once = F.col("_above").isNull() | F.col("low").isNull() | (F.col(value) >= F.col("low"))
    return range_join(labs, outside, test, value, "_above", "_below", bins=bins).where(once).drop("_above", "_below")


def max_reading(patients: DataFrame, readings: DataFrame, min_age: int, patient: str = "patient_id",
                value: str = "reading") -> DataFrame:
    """Highest reading per patient older than ``min_age`` across all reports."""
    old = patients.where(F.col("age") > min_age).select(patient, "age")
    return (readings.join(old, on=patient, how="inner")
            .groupBy(patient, "age")
            .agg(F.max(value).alias("max_reading"), F.count(F.lit(1)).alias("n_readings")))
