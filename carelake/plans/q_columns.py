"""Scalar projections (COL-*), key derivation, format dispatch and the file
inventory, over derived inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import functions as C
from carelake.functions.envelope import envelope_json, parse_envelope
from carelake.plans import derived as D
from carelake.plans.registry import register
from carelake.plans.tables import table
from carelake.sources.files import inventory, placeholder_rows, with_format

P = D.PATIENTS_SQL
U = D.UPLOAD_NAMES_SQL
_NAME_OF_KEY = "CASE WHEN regexp_extract({k}, '[^/]*$') = '' THEN {k} ELSE regexp_extract({k}, '[^/]*$') END"
_SAFE_SQL = "regexp_replace(trim({x}), '[^a-zA-Z0-9.\\-_]', '_', 'g')"
_UPLOAD_KEY_SQL = ("'uploads/user_id=' || trim(user_id) || '/year=' || strftime(ts, '%Y') || "
                   "'/month=' || strftime(ts, '%m') || '/' || " + _SAFE_SQL.format(x="file_name"))


@register("normalize_phone", f"""
WITH {P}
SELECT row_index, {D.MOBILE_SQL} AS mobile, {D.phone_sql(D.MOBILE_SQL)} AS phone FROM patients""")
def q_normalize_phone(spark, sf):
    p = D.patients(spark, sf)
    mobile = C.first_filled("mobile_number", "mobilenumber")
    return p.select("row_index", mobile.alias("mobile"), C.normalize_phone(mobile).alias("phone"))


@register("money_text", f"""
WITH {P}
SELECT row_index, amount_due, {D.money_sql('amount_due')} AS amount_text FROM patients""")
def q_money_text(spark, sf):
    p = D.patients(spark, sf)
    return p.select("row_index", "amount_due", C.money_text("amount_due").alias("amount_text"))


@register("patient_name", f"""
WITH {P}
SELECT row_index, {D.NAME_SQL} AS patient_name, {D.MSG_NAME_SQL} AS message_name FROM patients""")
def q_patient_name(spark, sf):
    p = D.patients(spark, sf)
    return p.select("row_index", C.patient_name("first_name", "last_name").alias("patient_name"),
                    C.message_name("first_name", "last_name").alias("message_name"))


@register("balance_message", f"""
WITH {P}
SELECT row_index, 'Hi ' || {D.MSG_NAME_SQL} || ', you have an outstanding bill amount due of $'
  || {D.money_sql('amount_due')} || '. Call 555-0100 at your convenience. Reply STOP to opt out.' AS message
FROM patients""")
def q_balance_message(spark, sf):
    p = D.patients(spark, sf)
    name = C.message_name("first_name", "last_name")
    return p.select("row_index", C.build_message(name, F.col("amount_due"), F.lit("balance")).alias("message"))


@register("wellness_message", f"""
WITH {P}
SELECT row_index, 'Hi ' || {D.MSG_NAME_SQL} || ', this is a reminder to schedule your Annual Wellness Visit. '
  || 'Please call Example Clinic at 555-0100. Reply STOP to opt out.' AS message
FROM patients""")
def q_wellness_message(spark, sf):
    p = D.patients(spark, sf)
    name = C.message_name("first_name", "last_name")
    return p.select("row_index", C.build_message(name, F.col("amount_due"), F.lit("wellness")).alias("message"))


@register("email_name", """
SELECT c_custkey, lower(trim(' ' || upper(replace(c_name, '#', '.')) || '@Example.com ')) AS email,
  split_part(lower(trim(' ' || upper(replace(c_name, '#', '.')) || '@Example.com ')), '@', 1) AS display_name
FROM customer""")
def q_email_name(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit(" "), F.upper(F.regexp_replace("c_name", "#", ".")), F.lit("@Example.com "))
    email = C.normalize_email(raw)
    return c.select("c_custkey", email.alias("email"), C.display_name(email).alias("display_name"))


@register("basename_ext", f"""
SELECT page_id, name, regexp_extract(lower(name), '\\.([^.]*)$', 1) AS ext,
  CASE WHEN strpos(lower(name), '.') > 0 THEN regexp_extract(lower(name), '\\.([^.]*)$', 1)
       ELSE lower(name) END AS query_ext
FROM (SELECT page_id, {_NAME_OF_KEY.format(k='url')} AS name FROM pages)""")
def q_basename_ext(spark, sf):
    pg = table(spark, sf, "pages").select("page_id", C.basename("url").alias("name"))
    return pg.select("page_id", "name", C.extension("name").alias("ext"),
                     C.extension_or_name("name").alias("query_ext"))


@register("safe_filename", f"""
SELECT page_id, {_SAFE_SQL.format(x=_NAME_OF_KEY.format(k='url'))} AS safe_name FROM pages""")
def q_safe_filename(spark, sf):
    pg = table(spark, sf, "pages")
    return pg.select("page_id", C.safe_filename(C.basename("url")).alias("safe_name"))


@register("partitioned_key", f"""
WITH {U}
SELECT event_id, {_UPLOAD_KEY_SQL} AS key FROM upload_names""")
def q_partitioned_key(spark, sf):
    u = D.upload_names(spark, sf)
    return u.select("event_id", C.upload_key("user_id", "ts", "file_name").alias("key"))


@register("output_key", f"""
WITH {U}
SELECT event_id, key, 'parquet/' || regexp_replace(key, '^uploads/', '') || '.parquet' AS output_key
FROM (SELECT event_id, {_UPLOAD_KEY_SQL} AS key FROM upload_names)""")
def q_output_key(spark, sf):
    u = D.upload_names(spark, sf).select("event_id", C.upload_key("user_id", "ts", "file_name").alias("key"))
    return u.select("event_id", "key", C.output_key("key").alias("output_key"))


@register("format_dispatch", f"""
WITH {U}
SELECT event_id, ext,
  CASE WHEN ext IN ('csv', 'txt') THEN 'csv' WHEN ext IN ('xlsx', 'xls') THEN 'xlsx' ELSE 'binary' END AS format,
  CASE WHEN qext IN ('xlsx', 'xls') THEN 'sheets' WHEN qext = 'pdf' THEN 'pdf' WHEN qext = 'docx' THEN 'docx'
       ELSE 'text' END AS text_format
FROM (SELECT event_id, regexp_extract(lower(file_name), '\\.([^.]*)$', 1) AS ext,
        CASE WHEN strpos(file_name, '.') > 0 THEN regexp_extract(lower(file_name), '\\.([^.]*)$', 1)
             ELSE lower(file_name) END AS qext
      FROM upload_names)""")
def q_format_dispatch(spark, sf):
    u = with_format(D.upload_names(spark, sf), "file_name")
    return u.select("event_id", "ext", "format", "text_format")


@register("placeholder_rows", f"""
WITH {U}
SELECT file_name AS filename, '[non-tabular file — text extraction done at query time]' AS content
FROM upload_names
WHERE regexp_extract(lower(file_name), '\\.([^.]*)$', 1) NOT IN ('csv', 'txt', 'xlsx', 'xls')""")
def q_placeholder_rows(spark, sf):
    u = with_format(D.upload_names(spark, sf), "file_name")
    return placeholder_rows(u.where(F.col("format") == "binary"), "file_name")


@register("file_inventory_sql", f"""
WITH {U}
SELECT key, {_NAME_OF_KEY.format(k='key')} AS name, size, last_modified FROM (
  SELECT {_UPLOAD_KEY_SQL} AS key, CAST(round(value * 100) AS BIGINT) AS size,
         strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS last_modified
  FROM upload_names)
ORDER BY last_modified DESC, key""")
def q_file_inventory(spark, sf):
    u = D.upload_names(spark, sf)
    listing = u.select(C.upload_key("user_id", "ts", "file_name").alias("key"), "ts",
                       F.round(F.col("value") * 100).cast("long").alias("size"))
    return inventory(listing, key="key", ts="ts", size="size")


@register("classify_command", f"""
WITH {D.INBOUND_SQL}
SELECT msg_id, {D.COMMAND_SQL.format(p='phone', b='body')} AS command FROM inbound""")
def q_classify_command(spark, sf):
    ib = D.inbound(spark, sf)
    return ib.select("msg_id", C.classify_command("phone", "body").alias("command"))


@register("parse_envelope", f"""
WITH {D.INBOUND_SQL}
SELECT i.msg_id, r.rec AS rec,
  CASE WHEN e.event_type = 'signup' THEN '' ELSE i.phone END AS phone,
  CASE WHEN e.event_type = 'signup' THEN '' WHEN r.rec = 2 THEN 'second ' || trim(i.body)
       ELSE trim(i.body) END AS body
FROM inbound i JOIN events e ON e.event_id = i.msg_id
JOIN (SELECT 1 AS rec UNION ALL SELECT 2) r ON r.rec = 1 OR e.event_type = 'error'""")
def q_parse_envelope(spark, sf):
    ib = D.inbound(spark, sf, keep=("event_type",))
    raw = ib.select("msg_id", envelope_json("event_type", "phone", "body").alias("raw"))
    return parse_envelope(raw, id_cols=["msg_id"])
