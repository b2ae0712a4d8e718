"""One-time-code login audit over issue and attempt logs.

Rules (the verify handler's order): blank e-mail or code -> ``bad_request``;
the code in force is the last one issued at or before the attempt; none, or
already consumed -> ``no_session``; attempt later than expiry (strict) ->
``expired`` (consumes); wrong code -> ``incorrect`` (keeps); else ``success``
(consumes).  A new issue replaces the old.  Codes are compared as hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.text import normalize_email
from carelake.operators.scan import DENSE_ROWS, carry_last, dense_buckets
from carelake.session import checkpoint_root

CODE_LIFE_S = 300
STATUSES = ("success", "incorrect", "expired", "no_session", "bad_request")


def audit_logins(issues: DataFrame, attempts: DataFrame, bucket_s: int = 3600,
                 materialize: bool = True, most: int | None = DENSE_ROWS) -> DataFrame:
    """issues: (email, code_hash, user_sub, issued_s, expiry_s, issue_id);
    attempts: (email, code_hash, attempt_s, attempt_id).  One row per attempt.
    E-mails are stripped and lower-cased in both logs.

    Issues and attempts form one timeline per e-mail; the code in force at each
    attempt is a bucketed as-of scan (see :mod:`carelake.operators.scan`), and
    "already consumed" compares with the first consuming attempt of that code
    (a partial aggregate).  Attempts with a blank e-mail or code stay in the
    timeline, answer ``bad_request`` and never touch a code.  The per-attempt
    lookups feed both the consumption aggregate and its join; with
    ``materialize`` they are checkpointed once (shared checkpoint folder)
    instead of re-scanning the logs for each.
    """
    email = normalize_email(F.coalesce(F.col("email"), F.lit("")))
    issues, attempts = issues.withColumn("email", email), attempts.withColumn("email", email)
    bad = (F.col("email") == "") | (F.coalesce(F.col("code_hash"), F.lit("")) == "")
    issue_type = "struct<issue_id:bigint,code_hash:string,expiry_s:bigint,user_sub:string>"
    timeline = (issues.select("email", F.col("issued_s").alias("t"), F.lit(0).alias("kind"),
                              F.col("issue_id").alias("id"),
                              F.struct("issue_id", "code_hash", "expiry_s", "user_sub").alias("_issue"),
                              F.lit(None).cast("string").alias("code_hash"), F.lit(False).alias("_bad"))
                .unionByName(attempts.select("email", F.col("attempt_s").alias("t"), F.lit(1).alias("kind"),
                                             F.col("attempt_id").alias("id"),
                                             F.lit(None).cast(issue_type).alias("_issue"), "code_hash",
                                             bad.alias("_bad")))
                .withColumn("_h", F.floor(F.col("t") / F.lit(bucket_s)).cast("long")))
    # an e-mail with more than ``most`` rows in a bucket is cut finer
    timeline = dense_buckets(timeline, ["email"], "_h", ["t", "id"], "_b", most).drop("_h")
    scanned = carry_last(timeline, ["email"], ["t", "kind", "id"], "_b", "_issue", "_cur", inclusive=True)
    cur = F.when(~F.col("_bad"), F.col("_cur"))
    looked = (scanned.where(F.col("kind") == 1)
              .select("email", F.col("t").alias("attempt_s"), F.col("id").alias("attempt_id"),
                      cur["issue_id"].alias("issue_id"), cur["user_sub"].alias("user_sub"),
                      F.when(F.col("_bad"), F.lit("bad_request"))
                       .when(F.col("_cur").isNull(), F.lit("no_session"))
                       .when(F.col("t") > F.col("_cur.expiry_s"), F.lit("expired"))
                       .when(F.col("code_hash") != F.col("_cur.code_hash"), F.lit("incorrect"))
                       .otherwise(F.lit("success")).alias("_raw")))
    if materialize:
        checkpoint_root(looked.sparkSession)
        looked = looked.checkpoint(eager=True)
    consumes = F.col("_raw").isin("success", "expired")
    first = (looked.where(consumes)
             .groupBy("email", "issue_id")
             .agg(F.min(F.struct("attempt_s", "attempt_id")).alias("_first")))
    res = looked.join(first, on=["email", "issue_id"], how="left")
    after = F.struct("attempt_s", "attempt_id") > F.col("_first")
    status = F.when(F.coalesce(after, F.lit(False)), F.lit("no_session")).otherwise(F.col("_raw"))
    return res.select("attempt_id", "email", "attempt_s", "issue_id", "user_sub", status.alias("status"))


def login_outcomes(audit: DataFrame) -> DataFrame:
    """Attempt outcomes per e-mail and UTC day (fixed pivot values: no extra pass)."""
    day = F.to_date(F.timestamp_seconds(F.col("attempt_s")))
    p = (audit.withColumn("day", day).groupBy("email", "day").pivot("status", list(STATUSES))
         .agg(F.count(F.lit(1))))
    return p.select("email", "day", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in STATUSES])
