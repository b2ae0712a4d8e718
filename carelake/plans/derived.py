"""Inputs the reference's operators expect, derived by Spark from the driver
tables (so their size grows with the tables), each with the equivalent SQL
used by the oracle.

* patients      <- customer   (one uploaded sheet per market segment)
* upload names  <- events     (a file per event; name/extension from the type)
* inbound SMS   <- events     (phone per user; body by event type)
* conversations <- conversations (one stored item per conversation)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.functions.history import HISTORY

from carelake.plans.tables import table

HISTORY_KEEP = 20  # messages kept in a stored conversation


def phone_of(id_col: Column) -> Column:
    """Fictional +1 602 555 xxxx number for an id; ids from 10,000 on count on from there, so each id has its own."""
    return F.concat(F.lit("+1602"), (id_col.cast("long") + 5550000).cast("string"))


PHONE_OF_SQL = "('+1602' || CAST(CAST({x} AS BIGINT) + 5550000 AS VARCHAR))"


# ---------------------------------------------------------------- patients --
def patients(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    # two patients share a number; the numbers grow with the table
    n = (F.floor(k / 2) + 5550000).cast("string")
    d = F.concat(F.substring(n, 1, 3), F.lit("-"), F.expr("substring(cast(floor(c_custkey / 2) + 5550000 as string), 4)"))
    shape = (F.when(k % 4 == 0, F.concat(F.lit("(602) "), d))
              .when(k % 4 == 1, F.concat(F.lit("1-602-"), d))
              .when(k % 4 == 2, F.concat(F.lit("2-602-"), d))
              .otherwise(d))
    dec = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    amount = (F.when(k % 10 == 3, F.lit(None).cast("string"))
               .when(k % 10 == 5, F.lit(""))
               .when(k % 10 == 9, F.lit(" n/a "))
               .when(k % 10 == 1, F.regexp_replace(dec, r"^(-?[0-9]+)([0-9]{3})\.", "$1,$2."))
               .otherwise(dec))
    return c.select(
        k.alias("row_index"),
        F.col("c_mktsegment").alias("file"),
        F.when(k % 9 == 4, F.lit(None).cast("string")).when(k % 9 == 5, F.lit("  "))
         .otherwise(F.concat(F.lit(" "), F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)))).alias("first_name"),
        F.when(k % 9 == 4, F.lit(None).cast("string")).when(k % 9 == 5, F.lit(None).cast("string"))
         .otherwise(F.concat(F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)), F.lit(" "))).alias("last_name"),
        amount.alias("amount_due"),
        F.when(k % 5 == 2, F.lit("")).otherwise(shape).alias("mobile_number"),
        F.when(k % 5 == 2, shape).alias("mobilenumber"),
        (k % 13 != 4).alias("sent"),
    )


PATIENTS_SQL = r"""
patients AS (
  SELECT c_custkey AS row_index, c_mktsegment AS file,
    CASE WHEN c_custkey % 9 = 4 THEN NULL WHEN c_custkey % 9 = 5 THEN '  '
         ELSE ' ' || split_part(c_name, '#', 1) END AS first_name,
    CASE WHEN c_custkey % 9 IN (4, 5) THEN NULL ELSE split_part(c_name, '#', 2) || ' ' END AS last_name,
    CASE c_custkey % 10 WHEN 3 THEN NULL WHEN 5 THEN '' WHEN 9 THEN ' n/a '
      WHEN 1 THEN regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '^(-?[0-9]+)([0-9]{3})\.', '\1,\2.')
      ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS amount_due,
    CASE WHEN c_custkey % 5 = 2 THEN '' ELSE shape END AS mobile_number,
    CASE WHEN c_custkey % 5 = 2 THEN shape END AS mobilenumber,
    c_custkey % 13 <> 4 AS sent
  FROM (SELECT *, CASE c_custkey % 4
          WHEN 0 THEN '(602) ' || d WHEN 1 THEN '1-602-' || d WHEN 2 THEN '2-602-' || d ELSE d END AS shape
        FROM (SELECT *, substr(n, 1, 3) || '-' || substr(n, 4) AS d
              FROM (SELECT *, CAST(c_custkey // 2 + 5550000 AS VARCHAR) AS n FROM customer))) c
)"""

# SQL pieces mirroring the column functions on plain (space-only) data.
MOBILE_SQL = "coalesce(nullif(mobile_number, ''), nullif(mobilenumber, ''), '')"
DIGITS_SQL = "regexp_replace({x}, '[^0-9]', '', 'g')"
PHONE_SQL = ("CASE WHEN length({d}) = 10 THEN '+1' || {d} "
             "WHEN length({d}) = 11 AND {d} LIKE '1%' THEN '+' || {d} END")
MONEY_SQL = (r"CASE WHEN {a} IS NULL OR {a} = '' THEN '0.00' "
             r"WHEN regexp_matches(replace({a}, ',', ''), '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$') "
             r"THEN CAST(CAST(trim(replace({a}, ',', '')) AS DECIMAL(18,2)) AS VARCHAR) ELSE trim({a}) END")
NAME_SQL = "trim(coalesce(trim(first_name), '') || ' ' || coalesce(trim(last_name), ''))"
MSG_NAME_SQL = f"coalesce(nullif({NAME_SQL}, ''), 'Patient')"


def phone_sql(x: str) -> str:
    d = DIGITS_SQL.format(x=x)
    return PHONE_SQL.format(d=d)


def money_sql(a: str) -> str:
    return MONEY_SQL.format(a=a)


# ------------------------------------------------------------ upload names --
_EXT_BY_TYPE = {"click": ".csv", "error": ".TXT", "purchase": ".xlsx", "signup": ".docx", "view": ""}


def upload_names(spark: SparkSession, sf: str) -> DataFrame:
    """One uploaded file per event: user, upload time, original file name."""
    e = table(spark, sf, "events")
    ext = F.lit("")
    for t, x in _EXT_BY_TYPE.items():
        ext = F.when(F.col("event_type") == t, F.lit(x)).otherwise(ext)
    name = F.concat(F.lit(" "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"),
                    F.lit(" ("), F.col("props"), F.lit(")"), ext)
    return e.select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts",
                    name.alias("file_name"), F.col("value"))


UPLOAD_NAMES_SQL = """
upload_names AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts, value,
    ' ' || event_type || ' ' || CAST(event_id AS VARCHAR) || ' (' || props || ')' ||
    CASE event_type WHEN 'click' THEN '.csv' WHEN 'error' THEN '.TXT' WHEN 'purchase' THEN '.xlsx'
                    WHEN 'signup' THEN '.docx' ELSE '' END AS file_name
  FROM events
)"""


# ------------------------------------------------------------- inbound SMS --
def inbound(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Inbound texts: signup -> START, error -> STOP, view -> HELP, others a question.

    ``reply`` (the generated answer) and ``sent`` (the send outcome) are input
    columns: the model call and the SMS delivery are outside this engine.
    """
    e = table(spark, sf, "events")
    t = F.col("event_type")
    body = (F.when(t == "signup", F.lit(" start "))
             .when(t == "error", F.lit("STOP"))
             .when(t == "view", F.lit("Help"))
             .when((t == "click") & (F.col("value") < 1), F.lit("  "))
             .when(t == "click", F.concat(F.lit("Is my balance due? ref "), F.col("props")))
             .otherwise(F.concat(F.lit("When are you open? "), F.col("event_id").cast("string"))))
    return e.select(
        F.col("event_id").alias("msg_id"), "ts", phone_of(F.col("user_id")).alias("phone"),
        body.alias("body"),
        F.concat(F.lit("Thanks, we will call you about "), F.col("event_id").cast("string")).alias("reply"),
        (F.col("event_id") % 17 != 5).alias("sent"),
        *keep,
    )


INBOUND_SQL = f"""
inbound AS (
  SELECT event_id AS msg_id, ts, {PHONE_OF_SQL.format(x='user_id')} AS phone,
    CASE WHEN event_type = 'signup' THEN ' start ' WHEN event_type = 'error' THEN 'STOP'
         WHEN event_type = 'view' THEN 'Help'
         WHEN event_type = 'click' AND value < 1 THEN '  '
         WHEN event_type = 'click' THEN 'Is my balance due? ref ' || props
         ELSE 'When are you open? ' || CAST(event_id AS VARCHAR) END AS body,
    'Thanks, we will call you about ' || CAST(event_id AS VARCHAR) AS reply,
    event_id % 17 <> 5 AS sent
  FROM events
)"""

COMMAND_SQL = """CASE WHEN trim(coalesce({p}, '')) = '' OR trim(coalesce({b}, '')) = '' THEN 'ignore'
  WHEN upper(trim({b})) IN ('STOP', 'STOPALL', 'UNSUBSCRIBE', 'CANCEL', 'END', 'QUIT') THEN 'stop'
  WHEN upper(trim({b})) = 'HELP' THEN 'help'
  WHEN upper(trim({b})) IN ('START', 'UNSTOP') THEN 'start' ELSE 'message' END"""


# ----------------------------------------------------- stored conversations --
def conversation_items(spark: SparkSession, sf: str) -> DataFrame:
    """One stored conversation item per ``conv_id``, history as JSON text.

    The stored history holds the last ``HISTORY_KEEP`` turns (the store's own
    cap), taken per conversation as a top-k before the shuffle, so a huge
    conversation never becomes one unbounded list.  Every 10th item
    (conv_id % 10 == 3) carries a malformed history.
    """
    cv = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = (cv.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= HISTORY_KEEP)
            .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t")))
    users = cv.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("_users"))
    grouped = tail.join(users, "conv_id")
    hist = F.transform(F.col("_t"), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    k = F.col("conv_id")
    return grouped.select(
        phone_of(k).alias("phone_number"),
        F.concat(F.lit("Patient "), k.cast("string")).alias("patient_name"),
        (k * F.lit(1.25)).cast("decimal(18,2)").cast("string").alias("amount_due"),
        F.when(k % 3 == 1, F.lit("balance")).when(k % 3 == 2, F.lit("wellness")).alias("message_type"),
        F.when(k % 10 == 3, F.lit("junk")).otherwise(F.to_json(hist.cast(HISTORY))).alias("conversation_history"),
        F.col("_users").cast("int").alias("reply_count"),
        (k % 7 == 0).alias("opt_out"),
        F.lit(None).cast("string").alias("last_inbound_message"),
    )


def conversation_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The stored items' keys and opt-out flags alone: one narrow aggregate, no history."""
    cv = table(spark, sf, "conversations").select("conv_id").distinct()
    return cv.select(phone_of(F.col("conv_id")).alias("phone_number"), (F.col("conv_id") % 7 == 0).alias("opt_out"))


# Stored items without the JSON text: the oracle works on the message rows.
CONV_ITEMS_SQL = f"""
conv_items AS (
  SELECT conv_id, {PHONE_OF_SQL.format(x='conv_id')} AS phone_number,
    'Patient ' || CAST(conv_id AS VARCHAR) AS patient_name,
    CAST(CAST(conv_id * 1.25 AS DECIMAL(18,2)) AS VARCHAR) AS amount_due,
    CASE conv_id % 3 WHEN 1 THEN 'balance' WHEN 2 THEN 'wellness' END AS message_type,
    CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS reply_count,
    conv_id % 7 = 0 AS opt_out
  FROM conversations GROUP BY conv_id
),
conv_msgs AS (
  SELECT conv_id, phone_number, turn, role, content,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, {PHONE_OF_SQL.format(x='conv_id')} AS phone_number, turn, role, text AS content,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
        FROM conversations WHERE conv_id % 10 <> 3)
  WHERE back <= 20
)"""
