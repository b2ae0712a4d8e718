"""Lab threshold questions (lineitem readings), patient maxima and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators import labs as L
from carelake.operators import reports as R
from carelake.plans.registry import register
from carelake.plans.tables import table

# Files of the threshold question: one lab report per return flag.
LAB_FILES = ("A", "N", "R")
# Threshold table (test, low, high).
THRESHOLDS = [("quantity", 2.0, 48.0), ("discount", 0.01, 0.09), ("tax", 0.01, 0.07)]
_TH_SQL = ("(SELECT test, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (VALUES ('quantity', 2.0, 48.0), "
           "('discount', 0.01, 0.09), ('tax', 0.01, 0.07)) AS v(test, low, high)) AS th")
MIN_AGE = 65


def _lab_file(li, flag):
    f = li.where(F.col("l_returnflag") == flag)
    cols = [F.lit(f"lab-{flag}").alias("source_key"), "l_orderkey", "l_linenumber",
            F.lit("quantity").alias("test"), F.col("l_quantity").alias("value")]
    if flag == "A":  # files need not share a layout
        cols.append("l_tax")
    return f.select(*cols)


@register("lab_filter", f"""
SELECT 'lab-' || l_returnflag AS source_key, l_orderkey, l_linenumber, 'quantity' AS test, l_quantity AS value,
  CASE WHEN l_returnflag = 'A' THEN l_tax END AS l_tax
FROM lineitem WHERE l_returnflag IN {LAB_FILES!r} AND l_quantity > 45""")
def q_lab_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    return L.lab_filter([_lab_file(li, f) for f in LAB_FILES], "quantity", ">", 45.0)


def _labs_long(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("patient_id"), "l_linenumber",
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["patient_id", "l_linenumber"], ["quantity", "discount", "tax"], "test", "value")


@register("critical_labs", f"""
SELECT patient_id, l_linenumber, test, value, low, high,
  'Critical ' || test || ' for patient ' || CAST(patient_id AS VARCHAR) || ': '
    || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' (normal ' || CAST(CAST(low AS DECIMAL(18,2)) AS VARCHAR)
    || ' to ' || CAST(CAST(high AS DECIMAL(18,2)) AS VARCHAR) || ')' AS alert_text
FROM (SELECT l_orderkey AS patient_id, l_linenumber, u.test, u.value, th.low, th.high
      FROM lineitem, LATERAL (VALUES ('quantity', l_quantity), ('discount', l_discount), ('tax', l_tax)) u(test, value)
      JOIN {_TH_SQL} ON th.test = u.test)
WHERE value < low OR value > high""")
def q_critical_labs(spark, sf):
    schema = T.StructType([T.StructField("test", T.StringType()), T.StructField("low", T.DoubleType()),
                           T.StructField("high", T.DoubleType())])
    th = spark.createDataFrame(THRESHOLDS, schema)
    return R.alert_text(L.critical_labs(_labs_long(spark, sf), th), "critical")


@register("critical_lab_bounds", """
SELECT patient_id, l_linenumber, u.test, value, lab, low, high
FROM (SELECT l_orderkey AS patient_id, l_linenumber, v.test, v.value FROM lineitem,
      LATERAL (VALUES ('price', l_extendedprice), ('quantity', l_quantity)) v(test, value)) u
JOIN (SELECT s_suppkey AS lab, t.test, CASE WHEN t.test = 'price' THEN 905.0::DOUBLE + s_suppkey % 10 END AS low,
        CASE WHEN t.test = 'price' THEN 104990.0::DOUBLE - s_suppkey % 7 ELSE 50.0::DOUBLE + s_suppkey % 3 END AS high
      FROM supplier, (VALUES ('price'), ('quantity')) t(test)) b
  ON b.test = u.test AND (value < low OR value > high)""")
def q_critical_lab_bounds(spark, sf):
    """Every lab (supplier) has its own, overlapping bounds on the same two tests."""
    readings = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("patient_id"), "l_linenumber", F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity")).unpivot(["patient_id", "l_linenumber"], ["price", "quantity"], "test", "value")
    key, price = F.col("lab"), F.col("test") == "price"
    bounds = (table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lab"), F.explode(F.array(F.lit("price"), F.lit("quantity"))).alias("test"))
              .withColumns({"low": F.when(price, F.lit(905.0) + key % 10),
                            "high": F.when(price, F.lit(104990.0) - key % 7).otherwise(F.lit(50.0) + key % 3)}))
    return L.critical_labs_ranged(readings, bounds)


@register("max_reading", f"""
SELECT o.o_custkey AS patient_id, CAST(20 + c.c_custkey % 70 AS BIGINT) AS age,
  max(l.l_extendedprice) AS max_reading, count(*) AS n_readings
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
WHERE 20 + c.c_custkey % 70 > {MIN_AGE}
GROUP BY o.o_custkey, c.c_custkey""", headline=True)
def q_max_reading(spark, sf):
    patients = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), (F.lit(20) + F.col("c_custkey") % 70).alias("age"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"))
    readings = (table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("reading"))
                .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("patient_id", "reading"))
    return L.max_reading(patients, readings, MIN_AGE)


def _appointments(spark, sf):
    """Events as appointments: provider = user, day = UTC date; the last day in
    the data is "tomorrow", earlier days are history."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("provider"), F.to_date("ts").alias("day"))
    last = e.select(F.max("day")).scalar()
    return e.where(F.col("day") == last), e.where(F.col("day") < last)


_LOW_SQL = """
WITH e AS (SELECT user_id AS provider, CAST(ts AS DATE) AS day FROM events),
lastday AS (SELECT max(day) AS d FROM e),
daily AS (SELECT provider, day, count(*) AS n FROM e WHERE day < (SELECT d FROM lastday) GROUP BY 1, 2),
av AS (SELECT provider, avg(n) AS a, count(*) AS history_days FROM daily GROUP BY 1),
nx AS (SELECT provider, count(*) AS upcoming FROM e WHERE day = (SELECT d FROM lastday) GROUP BY 1),
lv AS (SELECT av.provider, round(av.a, 4) AS daily_avg, av.history_days, coalesce(nx.upcoming, 0) AS upcoming,
         coalesce(nx.upcoming, 0) <= 0.5 * round(av.a, 4) AS alert
       FROM av LEFT JOIN nx USING (provider))"""


@register("low_volume", _LOW_SQL + " SELECT * FROM lv")
def q_low_volume(spark, sf):
    upcoming, history = _appointments(spark, sf)
    return R.low_volume(upcoming, history, ratio=0.5)


@register("alert_text", _LOW_SQL + """
SELECT provider, 'Low volume: provider ' || CAST(provider AS VARCHAR) || ' has ' || CAST(upcoming AS VARCHAR)
  || ' appointments vs a daily average of ' || CAST(CAST(round(daily_avg, 1) AS DECIMAL(18,1)) AS VARCHAR) AS alert_text
FROM lv WHERE alert""")
def q_alert_text(spark, sf):
    upcoming, history = _appointments(spark, sf)
    lv = R.low_volume(upcoming, history, ratio=0.5).where(F.col("alert"))
    return R.alert_text(lv, "low_volume").select("provider", "alert_text")
