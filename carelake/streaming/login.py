"""Login-code stream: per e-mail the code in force is keyed state; each attempt
yields its outcome with the rules of :mod:`carelake.operators.audit`.

A timer drops the state of an e-mail that has been idle for ``grace_s`` seconds.
Its clock, and the watermark, follow the rows' arrival (as a store's
time-to-live would), so no row is ever behind the watermark and dropped.  Outcomes are decided by the strict ``attempt >
expiry`` comparison, never by the timer.  Attempts without e-mail or code never
reach the keyed step.

With ``lateness`` everything goes by event time: the state of an e-mail is its
code as of the watermark and the events since then; a late event has them decided again,
and attempts whose outcome changes come out again with a higher ``revision``.
The timer then drops what has been idle for ``grace_s`` seconds of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.text import normalize_email
from carelake.streaming.common import with_event_clock
from carelake.streaming.keyed import fold_keys

OUTPUT_SCHEMA = "attempt_id long, email string, attempt_s long, issue_id long, user_sub string, status string"


def login_events(issues: DataFrame, attempts: DataFrame) -> DataFrame:
    """One stream of issue (kind 0) and attempt (kind 1) rows with event time."""
    i = issues.select("email", F.col("issued_s").alias("t"), F.lit(0).alias("kind"), F.col("issue_id").alias("id"),
                      "code_hash", "expiry_s", "user_sub")
    a = attempts.select("email", F.col("attempt_s").alias("t"), F.lit(1).alias("kind"),
                        F.col("attempt_id").alias("id"), "code_hash",
                        F.lit(None).cast("long").alias("expiry_s"), F.lit(None).cast("string").alias("user_sub"))
    return i.unionByName(a).withColumn("event_time", F.timestamp_seconds("t"))


def _make_fold(grace_s: int):
    def fold(email: str, rows: list[dict], cur, _watermark_ms, timed_out: bool) -> tuple[list[tuple], object, int | None]:
        if timed_out:
            return [], None, None
        out = []
        rows.sort(key=lambda r: ("t" not in r, r.get("t", 0), r["kind"], r["id"]))
        for r in rows:
            cur, decided = _decide(cur, _event(r))
            if r["kind"] == 1:
                out.append((r["id"], email, r["t"], *decided))
        return out, cur, max(r["arrived_ms"] for r in rows) + grace_s * 1000
    return fold


def _event(r: dict) -> tuple:
    return r["t"], r["kind"], r["id"], r.get("code_hash"), r.get("expiry_s"), r.get("user_sub")


def _decide(code: Sequence | None, e: Sequence) -> tuple[Sequence | None, tuple]:
    """(code in force after the event, (issue_id, user_sub, status) of an attempt)."""
    t, kind, id_, code_hash, expiry_s, user_sub = e
    if kind == 0:
        return (id_, code_hash, expiry_s, user_sub, False), (None, None, None)
    if code is None:
        return code, (None, None, "no_session")
    issue, right, expiry, sub, consumed = code
    status = "no_session" if consumed else "expired" if t > expiry else "incorrect" if code_hash != right else "success"
    return (issue, right, expiry, sub, consumed or status in ("expired", "success")), (issue, sub, status)


def _make_event_time_fold(grace_s: int):
    def fold(email: str, rows: list[dict], known, watermark_ms: int, timed_out: bool) -> tuple[list[tuple], object, int | None]:
        sealed, last_t, revision, seen = known or (None, None, 0, ())
        events = []
        for e, decided in seen:   # in order
            if e[0] * 1000 < watermark_ms:
                sealed = _decide(sealed, e)[0]   # nothing older is waited for
            else:
                events.append((tuple(e), tuple(decided)))
        for e in map(_event, rows):
            events.append((e, None))
            last_t = e[0] if last_t is None else max(last_t, e[0])
        if timed_out and watermark_ms > (last_t + grace_s) * 1000:
            return [], None, None
        events.sort(key=lambda x: x[0][:3])
        out, recent, now = [], [], sealed
        for e, before in events:
            now, decided = _decide(now, e)
            if e[1] == 1 and decided != before:
                out.append((e[2], email, e[0], *decided, revision + 1))
            if e[0] * 1000 < watermark_ms:
                sealed = now
            else:
                recent.append((e, decided))
        due = recent[0][0][0] if recent else last_t + grace_s
        return out, (sealed, last_t, revision + 1, recent), max(watermark_ms, due * 1000) + 1
    return fold


def login_stream(events: DataFrame, attempts: DataFrame | None = None, grace_s: int = 86400, lateness: str | None = None) -> DataFrame:
    """Attempt outcomes from a stream of :func:`login_events`, or from an
    issue stream and an attempt stream (``login_stream(issues, attempts)``).
    With ``lateness`` (an interval) in event time: of an attempt's rows that of the highest ``revision`` counts."""
    if attempts is not None:
        events = login_events(events, attempts)
    events = events.withColumn("email", normalize_email(F.coalesce(F.col("email"), F.lit(""))))
    if lateness is None:
        events = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "1 minute")
    blank = (F.col("email") == "") | (F.coalesce(F.col("code_hash"), F.lit("")) == "")
    bad = events.where(blank & (F.col("kind") == 1)).select(
        F.col("id").alias("attempt_id"), "email", F.col("t").alias("attempt_s"), F.lit(None).cast("long").alias("issue_id"),
        F.lit(None).cast("string").alias("user_sub"), F.lit("bad_request").alias("status"))
    if lateness is not None:
        timed = events.where(~blank | ((F.col("kind") == 0) & (F.col("email") != ""))).fillna({"expiry_s": 0})
        timed = with_event_clock(timed, "event_time", lateness).drop("event_time")
        late = fold_keys(timed, "email", _make_event_time_fold(grace_s), OUTPUT_SCHEMA + ", revision long", "_arrived")
        return late.unionByName(bad.withColumn("revision", F.lit(1).cast("long")))
    coded = events.where(~blank | ((F.col("kind") == 0) & (F.col("email") != ""))).withColumn("arrived_ms", F.unix_millis("_arrived"))
    known = fold_keys(coded.drop("event_time"), "email", _make_fold(grace_s), OUTPUT_SCHEMA, "_arrived")
    return known.unionByName(bad)
