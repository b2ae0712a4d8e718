"""Operators on small hand-made inputs: the expected results of FIXTURES.md."""

import datetime as dt
import json

from pyspark.sql import functions as F

from carelake.operators import audit as A
from carelake.operators import context as X
from carelake.operators import conversations as V
from carelake.operators import labs as L
from carelake.operators import reports as R
from carelake.operators.scan import carry_last, prefix_sum

T0 = dt.datetime(2026, 6, 1, 12, 0, 0)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_projection(spark):
    m = spark.createDataFrame([(2026, 1, 10.0), (2026, 2, 20.0), (2026, 3, 30.0), (2025, 5, 7.0)],
                              "year int, month int, revenue double")
    rows = {r.year: r for r in R.project_year(m).collect()}
    assert float(rows[2026].year_projection) == 780.0
    assert rows[2025].year_projection is None
    months = {(r.year, r.month): float(r.projected) for r in R.projection_months(m).collect()}
    assert months[(2026, 4)] == 40.0 and (2025, 6) not in months


def test_low_volume(spark):
    hist = spark.createDataFrame([("p1", 1)] * 30 + [("p1", 2)] * 30 + [("p2", 1)] * 30 + [("p3", 1)] * 30,
                                 "provider string, day int")
    up = spark.createDataFrame([("p1", 9)] * 15 + [("p2", 9)] * 16, "provider string, day int")
    rows = {r.provider: (r.upcoming, r.alert) for r in R.low_volume(up, hist).collect()}
    assert rows == {"p1": (15, True), "p2": (16, False), "p3": (0, True)}


def test_critical_labs(spark):
    labs = spark.createDataFrame([(1, "hba1c", 13.0), (2, "hba1c", 14.75), (3, "hba1c", 4.0)],
                                 "patient_id int, test string, value double")
    th = spark.createDataFrame([("hba1c", 4.0, 13.0)], "test string, low double, high double")
    got = [r.patient_id for r in L.critical_labs(labs, th).collect()]
    assert got == [2]


def test_lab_filter_aligns_files(spark):
    a = spark.createDataFrame([(1, "hba1c", 14.0, 7)], "pid int, test string, value double, extra int")
    b = spark.createDataFrame([(2, "hba1c", 12.0), (3, "hba1c", 13.5)], "pid int, test string, value double")
    got = sorted((r.pid, r.extra) for r in L.lab_filter([a, b], "hba1c", ">", 13).collect())
    assert got == [(1, 7), (3, None)]


def test_combined_context_limits(spark):
    docs = spark.createDataFrame([(f"k{i}", "x" * 20000) for i in range(20)], "key string, text string")

    def run(n, final_limit=None):
        req = spark.createDataFrame([(1, i, f"k{i}") for i in range(n)], "request_id int, ord int, key string")
        return X.combined_context(req, docs, final_limit=final_limit).first()

    one = run(1)
    assert one.context.endswith("x" * 20000) and "truncated" not in one.context
    fifteen = run(15)
    assert fifteen.context.count("x" * 8000 + X.COMBINED_MARKER) == 15
    twenty = run(20)
    assert twenty.context.count("x" * 8000 + X.COMBINED_MARKER) == 20
    cut = run(20, final_limit=60000)
    assert len(cut.context) == 60000 + len(X.SINGLE_MARKER) and cut.context.endswith(X.SINGLE_MARKER)
    assert cut.context[:60000] == twenty.context[:60000]


def test_combined_context_missing_key_and_order(spark):
    docs = spark.createDataFrame([("b", "B"), ("a", "A")], "key string, text string")
    req = spark.createDataFrame([(7, 2, "a"), (7, 1, "b"), (7, 3, "gone")], "request_id int, ord int, key string")
    ctx = X.combined_context(req, docs).first().context
    rule = "=" * 60
    assert ctx == (f"{rule}\nFILE: b\n{rule}\nB\n\n{rule}\nFILE: a\n{rule}\nA\n\n"
                   f"{rule}\nFILE: gone\n{rule}\n[Could not read this file]")


def test_file_context(spark):
    d = spark.createDataFrame([("a" * 60000,), ("a" * 60001,)], "text string")
    got = [r.context for r in X.file_context(d).collect()]
    assert got[0] == "a" * 60000 and got[1] == "a" * 60000 + X.SINGLE_MARKER


def test_sheets_to_text(spark):
    cells = spark.createDataFrame([("w", "S1", 0, 1, ["a", None, "c"]), ("w", "S1", 0, 2, ["d"]),
                                   ("w", "S2", 1, 1, ["e"])],
                                  "workbook string, sheet string, sheet_idx int, row_index long, cells array<string>")
    assert X.sheets_to_text(cells).first().text == "=== Sheet: S1 ===\na\t\tc\nd\n=== Sheet: S2 ===\ne"


def _convs(spark, rows):
    return spark.createDataFrame(rows, "phone_number string, patient_name string, amount_due string, "
                                       "message_type string, conversation_history string, reply_count int, "
                                       "opt_out boolean, last_inbound_message string")


def test_optout_sequence(spark):
    convs = _convs(spark, [])
    msgs = ["stop", "hello", "help", "start", "hello again"]
    inbound = spark.createDataFrame([(i, ts(i), "+16025550100", b, f"r{i}", True) for i, b in enumerate(msgs)],
                                    "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")
    acts = [r.action for r in V.inbound_actions(inbound, convs).orderBy("msg_id").collect()]
    assert acts == ["opt_out", "suppressed", "help", "resubscribe", "reply"]
    folded = V.fold_conversations(convs, V.inbound_actions(inbound, convs)).first()
    assert folded.opt_out is False and folded.reply_count == 1
    assert json.loads(folded.conversation_history) == [{"role": "user", "content": "hello again"},
                                                       {"role": "assistant", "content": "r4"}]


def test_optout_across_hours_uses_carry(spark):
    convs = _convs(spark, [("+1", "P", "", None, None, 0, True, None)])
    inbound = spark.createDataFrame(
        [(1, ts(0), "+1", "hi", "r", True), (2, ts(7200), "+1", "START", "r", True),
         (3, ts(4 * 3600), "+1", "hi", "r", True), (4, ts(9 * 3600), "+1", "STOP", "r", True),
         (5, ts(30 * 3600), "+1", "hi", "r", True)],
        "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")
    acts = [r.action for r in V.inbound_actions(inbound, convs).orderBy("msg_id").collect()]
    assert acts == ["suppressed", "resubscribe", "reply", "opt_out", "suppressed"]


def test_fold_keeps_last_20_and_failed_send(spark):
    hist = json.dumps([{"role": "assistant", "content": f"s{i}"} for i in range(15)])
    convs = _convs(spark, [("+1", "P", "5", "balance", hist, 3, False, None)])
    inbound = spark.createDataFrame(
        [(i, ts(i * 60), "+1", f"m{i}", f"r{i}", i != 4) for i in range(6)],
        "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")
    f = V.fold_conversations(convs, V.inbound_actions(inbound, convs)).first()
    h = json.loads(f.conversation_history)
    assert len(h) == 20 and f.reply_count == 8 and f.last_inbound_message == "m5"
    assert [m["content"] for m in h][-2:] == ["m5", "r5"] and "m4" not in [m["content"] for m in h]


def _patients(spark, rows):
    return spark.createDataFrame(rows, "row_index long, file string, first_name string, last_name string, "
                                       "amount_due string, mobile_number string, mobilenumber string, sent boolean")


def test_campaign_duplicates_and_opt_out(spark):
    pts = _patients(spark, [(1, "f", "A", "One", "10", "602-555-0101", None, True),
                            (2, "f", "B", "Two", "20", "(602) 555-0101", None, True),
                            (3, "f", "C", "Three", "30", "", "602-555-0102", True),
                            (4, "f", "D", "Four", "40", "555-01", None, True),
                            (5, "f", "E", "Five", "50", "602-555-0103", None, False)])
    convs = _convs(spark, [("+16025550102", "C", "", "balance", "[]", 2, True, None)])
    att, new = V.run_campaign(pts, convs)
    out = {r.row_index: r.outcome for r in att.collect()}
    assert out == {1: "sent", 2: "sent", 3: "suppressed", 4: "skipped", 5: "failed"}
    items = {r.phone_number: r for r in new.collect()}
    assert items["+16025550101"].patient_name == "B Two"
    assert items["+16025550102"].opt_out is True and "+16025550103" not in items
    att2, new2 = V.run_campaign(pts, convs, respect_opt_out=False)
    assert {r.row_index: r.outcome for r in att2.collect()}[3] == "sent"
    assert {r.phone_number: r.opt_out for r in new2.collect()}["+16025550102"] is False
    s = V.campaign_summary(att).first()
    assert (s.sent, s.skipped, s.suppressed, s.failed) == (2, 1, 1, 1)
    assert s.summary == "SMS sent to 2 patient(s). 1 skipped (no mobile number)."


def _audit(spark, issues, attempts):
    i = spark.createDataFrame(issues, "email string, code_hash string, user_sub string, issued_s long, "
                                      "expiry_s long, issue_id long")
    a = spark.createDataFrame(attempts, "email string, code_hash string, attempt_s long, attempt_id long")
    return [r.status for r in A.audit_logins(i, a).orderBy("attempt_id").collect()]


def test_login_audit_rules(spark):
    e = "a@example.com"
    iss = [(e, "h1", "s", 1000, 1300, 1)]
    assert _audit(spark, iss, [(e, "h1", 1300, 10)]) == ["success"]
    assert _audit(spark, iss, [(e, "h1", 1301, 10), (e, "h1", 1302, 11)]) == ["expired", "no_session"]
    assert _audit(spark, iss, [(e, "xx", 1100, 10), (e, "h1", 1200, 11)]) == ["incorrect", "success"]
    assert _audit(spark, iss, [(e, "h1", 1100, 10), (e, "h1", 1200, 11)]) == ["success", "no_session"]
    reissue = iss + [(e, "h2", "s", 1150, 1450, 2)]
    assert _audit(spark, reissue, [(e, "h1", 1200, 10), (e, "h2", 1201, 11)]) == ["incorrect", "success"]
    assert _audit(spark, iss, [(e, "h1", 900, 10), ("", "h1", 1100, 11), (e, "", 1100, 12)]) == \
        ["no_session", "bad_request", "bad_request"]
    # an issue many hours before the attempt is still found (bucketed carry)
    assert _audit(spark, [(e, "h1", "s", 0, 10**6, 1)], [(e, "h1", 86400, 10)]) == ["success"]
    outcomes = A.login_outcomes(A.audit_logins(
        spark.createDataFrame(iss, "email string, code_hash string, user_sub string, issued_s long, "
                                   "expiry_s long, issue_id long"),
        spark.createDataFrame([(e, "h1", 1100, 10), (e, "h1", 1200, 11)],
                              "email string, code_hash string, attempt_s long, attempt_id long"))).first()
    assert (outcomes.success, outcomes.no_session, outcomes.incorrect) == (1, 1, 0)


def test_scans_match_plain_windows(spark):
    from pyspark.sql import Window
    rows = [(k, i, i * 1000, (i * 7919) % 5 if i % 3 else None) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, t long, v long").withColumn("b", F.floor(F.col("t") / 7000))
    w = Window.partitionBy("k").orderBy("t", "i")
    ref = df.withColumns({
        "ln": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "ps": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    got = prefix_sum(carry_last(df, ["k"], ["t", "i"], "b", "v", "ln", inclusive=False),
                     ["k"], ["t", "i"], "b", "v", "ps")
    a = {(r.k, r.i): (r.ln, r.ps) for r in ref.collect()}
    b = {(r.k, r.i): (r.ln, r.ps) for r in got.collect()}
    assert a == b


def test_latest_per_phone(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 3, "c"), ("p", 2, "b"), ("q", 1, "z")],
                               "phone string, row_index long, v string")
    got = sorted(tuple(r) for r in V.latest_per_phone(df).collect())
    assert got == [("p", 3, "c"), ("q", 1, "z")]


def test_upsert_replace_and_merge(spark):
    from carelake.sinks.conversations import upsert
    cur = spark.createDataFrame([("p1", "Ann", 2, False), ("p2", "Bo", 5, True)],
                                "phone_number string, patient_name string, reply_count int, opt_out boolean")
    chg = spark.createDataFrame([("p2", None, 6, None), ("p3", "Cy", 1, None)],
                                "phone_number string, patient_name string, reply_count int, opt_out boolean")
    merged = {r.phone_number: tuple(r)[1:] for r in upsert(cur, chg, mode="merge").collect()}
    assert merged == {"p1": ("Ann", 2, False), "p2": ("Bo", 6, True), "p3": ("Cy", 1, None)}
    replaced = {r.phone_number: tuple(r)[1:] for r in upsert(cur, chg, mode="replace").collect()}
    assert replaced == {"p1": ("Ann", 2, False), "p2": (None, 6, None), "p3": ("Cy", 1, None)}


def test_append_pair_and_json_round_trip(spark):
    from carelake import functions as C
    df = spark.createDataFrame([('[{"role":"assistant","content":"hi"}]', "q", "a")], "h string, u string, r string")
    out = df.select(C.history_json(C.append_pair(C.parse_history("h"), F.col("u"), F.col("r")))).first()[0]
    assert json.loads(out) == [{"role": "assistant", "content": "hi"}, {"role": "user", "content": "q"},
                               {"role": "assistant", "content": "a"}]


def test_conversation_overview_defaults(spark):
    convs = _convs(spark, [("+1", "Ann", "5", None, '[{"role":"user","content":"x"},{"role":"assistant","content":"y"}]',
                            None, None, None),
                           ("+2", "Bo", "", "wellness", "junk", 4, True, None)])
    rows = [tuple(r) for r in V.conversation_overview(convs).collect()]
    assert rows == [("+2", "Bo", "", "wellness", 4, True, None), ("+1", "Ann", "5", "balance", 0, False, "x")]


def test_outbound_messages(spark):
    convs = _convs(spark, [])
    long = "x" * 2000
    inbound = spark.createDataFrame(
        [(1, ts(0), "+1", "help", "r1", True), (2, ts(1), "+1", "start", "r2", True),
         (3, ts(2), "+1", "hi", long, True), (4, ts(3), "+1", "stop", "r4", True)],
        "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")
    out = {r.msg_id: r.sms_body for r in V.outbound_messages(V.inbound_actions(inbound, convs)).collect()}
    assert out[1] == "For billing help call 555-0100. Reply STOP to opt out."
    assert out[2] == "You have been re-subscribed. Call 555-0100 for help."
    assert out[3] == "x" * 1600 and 4 not in out
