"""Login-code audit over events: signup = code issued, click = code entered."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import audit as A
from carelake.plans.registry import register
from carelake.plans.tables import table

# Code life used for the event log (its events are hours apart; the handler's
# own constant is ``A.CODE_LIFE_S`` = 300 s).
LIFE_S = 43200


def logs(spark, sf, life_s: int = LIFE_S):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    email = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    code = F.sha2((k % 3).cast("string"), 256)
    # attempts as typed: padded, in capitals, or no e-mail at all
    typed = (F.when(F.col("event_id") % 41 == 0, F.lit("  ")).when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), F.upper(email), F.lit("\t")))
             .otherwise(email))
    issues = e.where(F.col("event_type") == "signup").select(
        email.alias("email"), code.alias("code_hash"),
        F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("user_sub"),
        secs.alias("issued_s"), (secs + F.lit(life_s)).alias("expiry_s"), F.col("event_id").alias("issue_id"))
    attempts = e.where(F.col("event_type") == "click").select(
        typed.alias("email"), F.when(F.col("value") < 1, F.lit("")).otherwise(code).alias("code_hash"),
        secs.alias("attempt_s"), F.col("event_id").alias("attempt_id"))
    return issues, attempts


_AUDIT_SQL = f"""
WITH ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 AS code,
                  CAST(floor(epoch(ts)) AS BIGINT) AS s, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email
            FROM events),
iss AS (SELECT email, code, 'sub-' || CAST(user_id AS VARCHAR) AS user_sub, s AS issued_s, s + {LIFE_S} AS expiry_s,
          event_id AS issue_id FROM ev WHERE event_type = 'signup'),
att AS (SELECT CASE WHEN event_id % 41 = 0 THEN '' ELSE email END AS email,
               CASE WHEN value < 1 OR event_id % 41 = 0 THEN NULL ELSE code END AS code, s AS attempt_s, event_id AS attempt_id
        FROM ev WHERE event_type = 'click'),
tl AS (SELECT email, issued_s AS t, 0 AS kind, issue_id AS id, issue_id AS iid FROM iss
       UNION ALL SELECT email, attempt_s, 1, attempt_id, NULL FROM att WHERE code IS NOT NULL),
cur AS (SELECT *, last_value(iid IGNORE NULLS) OVER (PARTITION BY email ORDER BY t, kind, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_iid FROM tl),
lk AS (
  SELECT a.attempt_id, a.email, a.attempt_s, i.issue_id, i.user_sub,
    CASE WHEN i.issue_id IS NULL THEN 'no_session' WHEN a.attempt_s > i.expiry_s THEN 'expired'
         WHEN a.code <> i.code THEN 'incorrect' ELSE 'success' END AS raw
  FROM att a JOIN cur c ON c.kind = 1 AND c.id = a.attempt_id LEFT JOIN iss i ON i.issue_id = c.cur_iid
  WHERE a.code IS NOT NULL),
fc AS (SELECT issue_id, attempt_s AS fs, attempt_id AS fid FROM (
         SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY attempt_s, attempt_id) AS r
         FROM lk WHERE raw IN ('success', 'expired') AND issue_id IS NOT NULL) WHERE r = 1),
audit AS (
  SELECT lk.attempt_id, lk.email, lk.attempt_s, lk.issue_id, lk.user_sub,
    CASE WHEN fc.issue_id IS NOT NULL AND (lk.attempt_s > fc.fs OR (lk.attempt_s = fc.fs AND lk.attempt_id > fc.fid))
         THEN 'no_session' ELSE raw END AS status
  FROM lk LEFT JOIN fc ON fc.issue_id = lk.issue_id
  UNION ALL
  SELECT attempt_id, email, attempt_s, NULL, NULL, 'bad_request' FROM att WHERE code IS NULL)"""


@register("login_audit", _AUDIT_SQL + " SELECT * FROM audit", headline=True)
def q_login_audit(spark, sf):
    issues, attempts = logs(spark, sf)
    return A.audit_logins(issues, attempts)


@register("login_outcomes", _AUDIT_SQL + """
SELECT email, CAST(make_timestamp(attempt_s * 1000000) AS DATE) AS day,
  count(*) FILTER (WHERE status = 'success') AS success,
  count(*) FILTER (WHERE status = 'incorrect') AS incorrect,
  count(*) FILTER (WHERE status = 'expired') AS expired,
  count(*) FILTER (WHERE status = 'no_session') AS no_session,
  count(*) FILTER (WHERE status = 'bad_request') AS bad_request
FROM audit GROUP BY 1, 2""")
def q_login_outcomes(spark, sf):
    issues, attempts = logs(spark, sf)
    return A.login_outcomes(A.audit_logins(issues, attempts))
