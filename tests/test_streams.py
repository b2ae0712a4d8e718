"""Stream twins: the stream over file drops equals the batch operator on the
same rows, whether the rows arrive in 1, 2 or 5 files."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from carelake.operators import audit as A
from carelake.operators import conversations as V
from carelake.streaming import inbound as SI
from carelake.streaming import login as SL
from carelake.streaming.common import run_available_now, stream_parquet, write_time_chunks

T0 = dt.datetime(2026, 6, 1)


def _inbound(spark):
    bodies = ["hi", "STOP", "hi", "help", "start", "hi", "", "hello", "stop", "x"]
    rows = [(i, T0 + dt.timedelta(minutes=37 * i), f"+1602555010{i % 3}", bodies[i % len(bodies)], f"r{i}", i % 7 != 3)
            for i in range(60)]
    rows += [rows[7], rows[30]]   # redelivered messages
    return spark.createDataFrame(rows, "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")


@pytest.mark.parametrize("chunks", [1, 2, 5])
def test_inbound_stream_twin(spark, chunks):
    root = tempfile.mkdtemp(prefix="carelake-stream-")
    inbound = _inbound(spark)
    convs = spark.createDataFrame([("+16025550101", "P", "5", "balance", "[]", 0, True, None)],
                                  "phone_number string, patient_name string, amount_due string, message_type string, "
                                  "conversation_history string, reply_count int, opt_out boolean, "
                                  "last_inbound_message string")
    write_time_chunks(inbound, "ts", f"{root}/in", chunks)
    out = SI.inbound_stream(stream_parquet(spark, f"{root}/in", inbound.schema), convs, dedupe_delay="1 day")
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck")
    got = {r.msg_id: r.action for r in spark.read.schema(SI.OUTPUT_SCHEMA).parquet(f"{root}/out").collect()}
    want = {r.msg_id: r.action for r in V.inbound_actions(inbound, convs, dedupe=True).collect()}
    assert got == want
    final = {r.phone_number: r.reply_count for r in V.fold_conversations(convs, V.inbound_actions(inbound, convs, dedupe=True))
             .collect()}
    last = (spark.read.schema(SI.OUTPUT_SCHEMA).parquet(f"{root}/out")
            .groupBy("phone").agg(F.max_by("reply_count", "msg_id").alias("rc")).collect())
    assert {r.phone: r.rc for r in last if r.phone} == {k: v for k, v in final.items() if k in {r.phone for r in last}}


@pytest.mark.parametrize("chunks", [1, 3])
def test_login_stream_twin(spark, chunks):
    root = tempfile.mkdtemp(prefix="carelake-login-")
    e1, e2 = "a@example.com", "b@example.com"
    issues = spark.createDataFrame([(e1, "h1", "s1", 1000, 1300, 1), (e2, "h2", "s2", 1000, 1300, 2),
                                    (e1, "h3", "s1", 5000, 5300, 3)],
                                   "email string, code_hash string, user_sub string, issued_s long, expiry_s long, "
                                   "issue_id long")
    attempts = spark.createDataFrame([(e1, "zz", 1100, 10), (e1, "h1", 1200, 11), (e1, "h1", 1250, 12),
                                      (e2, "h2", 1400, 13), (e2, "h2", 1500, 14), (e1, "", 1600, 15),
                                      (e1, "h3", 5100, 16), (e2, "h2", 900, 17)],
                                     "email string, code_hash string, attempt_s long, attempt_id long")
    ev = SL.login_events(issues, attempts)
    write_time_chunks(ev, "t", f"{root}/in", chunks, files_per_chunk=1)
    out = SL.login_stream(stream_parquet(spark, f"{root}/in", ev.schema, files_per_trigger=1))
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck")
    got = {r.attempt_id: r.status for r in spark.read.schema(SL.OUTPUT_SCHEMA).parquet(f"{root}/out").collect()}
    want = {r.attempt_id: r.status for r in A.audit_logins(issues, attempts).collect()}
    assert got == want
    assert got[11] == "success" and got[12] == "no_session" and got[14] == "no_session" and got[15] == "bad_request"
