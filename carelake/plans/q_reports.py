"""Per-file / combined answers, monthly revenue and the year-end projection
over ``orders`` (a "file" is one order priority)."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import reports as R
from carelake.plans.registry import register
from carelake.plans.tables import table

# Files chosen for the combined answer.
COMBINED_FILES = ("1-URGENT", "2-HIGH")

_FILE_AGGS_SQL = """
  COUNT(*) AS n_rows,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total,
  MAX(o_totalprice) AS max_price"""


def _file_aggs():
    return [F.count(F.lit(1)).alias("n_rows"),
            F.sum(R.to_money("o_totalprice")).cast(R.MONEY).alias("total"),
            F.max("o_totalprice").alias("max_price")]


def monthly(spark, sf):
    orders = table(spark, sf, "orders")
    return R.monthly_revenue(orders, "o_orderdate", "o_totalprice")


_MONTHLY_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue, COUNT(*) AS n
FROM orders GROUP BY 1, 2"""


@register("monthly_revenue", _MONTHLY_SQL, headline=True)
def q_monthly_revenue(spark, sf):
    return monthly(spark, sf)


@register("project_year", f"""
WITH m AS ({_MONTHLY_SQL}),
y AS (
  SELECT year, COUNT(*) AS months_observed, MAX(month) AS last_month,
         CAST(SUM(revenue) AS DECIMAL(38,2)) AS observed_total,
         regr_slope(CAST(revenue AS DOUBLE), CAST(month AS DOUBLE)) AS b,
         regr_intercept(CAST(revenue AS DOUBLE), CAST(month AS DOUBLE)) AS a
  FROM m GROUP BY year)
SELECT year, months_observed, observed_total,
  CASE WHEN months_observed >= 2 THEN CAST(round(a * (12 - last_month)
       + b * (78.0 - last_month * (last_month + 1) / 2.0), 2) AS DECIMAL(38,2)) END AS projected_remaining,
  CASE WHEN months_observed >= 2 THEN CAST(CAST(observed_total AS DOUBLE) + round(a * (12 - last_month)
       + b * (78.0 - last_month * (last_month + 1) / 2.0), 2) AS DECIMAL(38,2)) END AS year_projection
FROM y""", headline=True)
def q_project_year(spark, sf):
    return R.project_year(monthly(spark, sf))


@register("per_file", f"""
SELECT o_orderpriority AS file, {_FILE_AGGS_SQL}
FROM orders GROUP BY o_orderpriority""")
def q_per_file(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "file")
    return R.per_file(orders, "file", _file_aggs())


@register("combined", f"""
SELECT {_FILE_AGGS_SQL} FROM orders
WHERE o_orderpriority IN {tuple(COMBINED_FILES)!r}""")
def q_combined(spark, sf):
    orders = table(spark, sf, "orders")
    files = [orders.where(F.col("o_orderpriority") == f) for f in COMBINED_FILES]
    return R.combined(files, _file_aggs())


@register("projection_months", f"""
WITH m AS ({_MONTHLY_SQL}),
y AS (
  SELECT year, COUNT(*) AS n, MAX(month) AS last_month,
         regr_slope(CAST(revenue AS DOUBLE), CAST(month AS DOUBLE)) AS b,
         regr_intercept(CAST(revenue AS DOUBLE), CAST(month AS DOUBLE)) AS a
  FROM m GROUP BY year)
SELECT year, CAST(month AS INTEGER) AS month, CAST(round(a + b * month, 2) AS DECIMAL(38,2)) AS projected
FROM y, LATERAL (SELECT unnest(generate_series(last_month + 1, 12)) AS month)
WHERE n >= 2 AND last_month < 12""")
def q_projection_months(spark, sf):
    """The fitted figure for each month after the last observed one."""
    return R.projection_months(monthly(spark, sf))
