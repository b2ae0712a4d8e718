"""Aggregations and reports: per-file / combined answers, monthly
revenue, year-end projection, low-volume and critical-value alert text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def to_money(c) -> Column:
    """Exact two-decimal money; sums stay exact (no float re-association)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(18,2)")


def per_file(df: DataFrame, file_col: str, aggs: Sequence[Column]) -> DataFrame:
    """The same aggregate answered independently for each file."""
    return df.groupBy(file_col).agg(*aggs)


def combined(dfs: Sequence[DataFrame], aggs: Sequence[Column]) -> DataFrame:
    """The same aggregate over the union of the selected files (columns are
    aligned by name; a column missing from one file is null there)."""
    union = dfs[0]
    for d in dfs[1:]:
        union = union.unionByName(d, allowMissingColumns=True)
    return union.agg(*aggs)


def monthly_revenue(df: DataFrame, ts: str, amount: str) -> DataFrame:
    """Revenue per calendar month: (year, month, revenue, n)."""
    return (df.select(F.year(ts).alias("year"), F.month(ts).alias("month"), to_money(amount).alias("_amt"))
            .groupBy("year", "month")
            .agg(F.sum("_amt").cast(MONEY).alias("revenue"), F.count(F.lit(1)).alias("n")))


def project_year(monthly: DataFrame, value: str = "revenue") -> DataFrame:
    """Year-end projection by ordinary least squares on month number.

    Per year: observed months and total; the fitted line is evaluated for the
    months after the last observed one and added to the observed total.  Fewer
    than two observed months -> null projection.
    """
    per_year = (monthly.groupBy("year")
                .agg(F.count(F.lit(1)).alias("months_observed"),
                     F.max("month").alias("last_month"),
                     F.sum(value).cast(MONEY).alias("observed_total"),
                     F.regr_slope(F.col(value).cast("double"), F.col("month").cast("double")).alias("slope"),
                     F.regr_intercept(F.col(value).cast("double"), F.col("month").cast("double")).alias("intercept")))
    # Sum of (a + b*m) for m = last+1 .. 12, in closed form (no row explosion).
    k = (F.lit(12) - F.col("last_month")).cast("double")
    msum = (F.lit(12 * 13 / 2) - F.col("last_month") * (F.col("last_month") + 1) / 2).cast("double")
    remaining = F.col("intercept") * k + F.col("slope") * msum
    ok = F.col("months_observed") >= 2
    return per_year.select(
        "year", "months_observed", "observed_total",
        F.when(ok, F.round(remaining, 2).cast(MONEY)).alias("projected_remaining"),
        F.when(ok, (F.col("observed_total") + F.round(remaining, 2)).cast(MONEY)).alias("year_projection"),
    )


def projection_months(monthly: DataFrame, value: str = "revenue") -> DataFrame:
    """The projected figure for each month after the last observed one."""
    fit = (monthly.groupBy("year")
           .agg(F.count(F.lit(1)).alias("_n"), F.max("month").alias("_last"),
                F.regr_slope(F.col(value).cast("double"), F.col("month").cast("double")).alias("_b"),
                F.regr_intercept(F.col(value).cast("double"), F.col("month").cast("double")).alias("_a"))
           .where(F.col("_n") >= 2))
    return (fit.where(F.col("_last") < 12)
            .select("year", F.explode(F.sequence(F.col("_last") + 1, F.lit(12))).alias("month"), "_a", "_b")
            .select("year", "month", F.round(F.col("_a") + F.col("_b") * F.col("month"), 2).cast(MONEY)
                    .alias("projected")))


def low_volume(upcoming: DataFrame, history: DataFrame, provider: str = "provider",
               day: str = "day", ratio: float = 0.5) -> DataFrame:
    """Alert when a provider's upcoming count <= ratio x its historical daily average.

    ``history`` and ``upcoming`` are row-per-appointment tables.  Days without
    rows are not averaged in; a provider with history but no upcoming rows is
    reported with count 0.
    """
    daily = history.groupBy(provider, day).agg(F.count(F.lit(1)).alias("_n"))
    avg = daily.groupBy(provider).agg(F.avg(F.col("_n").cast("double")).alias("daily_avg"),
                                      F.count(F.lit(1)).alias("history_days"))
    nxt = upcoming.groupBy(provider).agg(F.count(F.lit(1)).alias("upcoming"))
    joined = (avg.join(nxt, provider, "left")
              .withColumn("upcoming", F.coalesce(F.col("upcoming"), F.lit(0)).cast("long")))
    return (joined.withColumn("daily_avg", F.round("daily_avg", 4))
            .withColumn("alert", F.col("upcoming") <= F.lit(ratio) * F.col("daily_avg")))


def alert_text(df: DataFrame, kind: str) -> DataFrame:
    """Human-readable alert line for low-volume or critical-lab rows."""
    if kind == "low_volume":
        text = F.format_string("Low volume: provider %s has %d appointments vs a daily average of %s",
                               F.col("provider").cast("string"), F.col("upcoming"),
                               F.round(F.col("daily_avg"), 1).cast("decimal(18,1)").cast("string"))
    elif kind == "critical":
        text = F.format_string("Critical %s for patient %s: %s (normal %s to %s)",
                               F.col("test"), F.col("patient_id").cast("string"),
                               *[F.col(c).cast("decimal(18,2)").cast("string") for c in ("value", "low", "high")])
    else:
        raise ValueError(f"unknown alert kind {kind!r}")
    return df.withColumn("alert_text", text)
