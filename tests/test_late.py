"""Streams in event time against their batch twins, however late the rows come; the store of items."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from carelake.operators import audit as A
from carelake.operators import conversations as V
from carelake.sinks.conversations import ItemStore
from carelake.streaming import inbound as SI
from carelake.streaming import login as SL
from carelake.streaming.common import latest, run_available_now, stream_parquet

T0 = dt.datetime(2026, 6, 1)
MESSAGES = "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean"
STORED = ("phone_number string, patient_name string, amount_due string, message_type string, last_outbound_message string, last_message_id string, "
          "conversation_history string, reply_count int, opt_out boolean, last_inbound_message string")


def replay(spark, root, batches, schema):
    """Each list of rows is a file, hence a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def message(i, day, body, phone="+1", sent=True):
    return (i, None if day is None else T0 + dt.timedelta(days=day), phone, body, f"r{i}", sent)


def stored(spark):
    return spark.createDataFrame([("+1", "P", "5", "balance", "hello", "m1", '[{"role":"assistant","content":"hi"}]', 2, False, None),
                                  ("+9", "Q", None, None, None, None, "junk", None, True, "old")], STORED)


def run(spark, root, convs, lateness, fail_at=None):
    store = ItemStore(spark, f"{root}/items", most=3)
    store.start(convs.select(*V.CONV_COLUMNS))

    def sink(df, batch_id):
        df = df.persist()
        items = latest(SI.item_rows(df), ["phone_number"]).drop("revision")
        store.merge(items.select(*V.CONV_COLUMNS), batch_id)
        if batch_id == fail_at:
            raise RuntimeError("killed after the items' commit")
        SI.message_rows(df).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        df.unpersist()
    src = stream_parquet(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    run_available_now(SI.inbound_changes(src, convs, lateness).writeStream.foreachBatch(sink), f"{root}/ck", spark, 2)
    return latest(spark.read.parquet(f"{root}/out").drop("batch"), ["msg_id", "rec"]), store


def check_twin(spark, got, store, inbound, convs):
    actions = V.inbound_actions(inbound, convs).persist()
    want = {r.msg_id: (r.phone, r.command, r.action) for r in actions.collect()}
    assert {r.msg_id: (r.phone, r.command, r.action) for r in got.collect()} == want
    cols = V.CONV_COLUMNS
    folded = sorted((tuple(r) for r in V.fold_conversations(convs, actions).select(*cols).collect()), key=str)
    assert sorted((tuple(r) for r in store.read().select(*cols).collect()), key=str) == folded


LATE = [[message(1, 9, "hi"), message(2, 9.5, "hello", "+2")],
        [message(3, 6, "STOP"), message(4, None, "STOP", "+2"), message(5, 1, "x", " ")],   # three days late, and without a time
        [message(6, 10, "hi again"), message(7, 6.5, "start"), message(8, 6.2, "in between"), message(9, 3, "help", "+3"), message(10, 3, "hi", "+9")],
        [message(11, 11, "bye", sent=False), message(12, 2, "a", "+2"), message(13, 12, "b", "+2")]]


def test_late_messages_give_the_batch_twins_rows(spark):
    root = tempfile.mkdtemp(prefix="carelake-late-")
    replay(spark, root, LATE, MESSAGES)
    convs = stored(spark)
    got, store = run(spark, root, convs, "30 days")
    check_twin(spark, got, store, spark.read.parquet(f"{root}/in"), convs)
    assert got.where("msg_id = 1").first().action == "reply" and got.where("msg_id = 8").first().action == "suppressed"
    assert got.where("msg_id = 1").first().revision > 1


def test_random_arrivals_give_the_batch_twins_rows(spark):
    rng, root = random.Random(5), tempfile.mkdtemp(prefix="carelake-late-")
    rows = [message(i, i / 50, rng.choice(["hi", "STOP", "start", "help", "", "what"]), f"+{rng.randint(1, 4)}", rng.random() < 0.8) for i in range(240)]
    arrived = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() + rng.choice([0, 0, 0, 86400 * 0.9]))
    replay(spark, root, [arrived[i:i + 40] for i in range(0, 240, 40)], MESSAGES)
    convs = stored(spark)
    got, store = run(spark, root, convs, "1 day")   # so that much is taken in on the way
    check_twin(spark, got, store, spark.read.parquet(f"{root}/in"), convs)
    assert len(store.folders()) <= 3


def test_no_message_is_dropped_however_late(spark):
    root = tempfile.mkdtemp(prefix="carelake-late-")
    replay(spark, root, [[message(1, 50, "hi")], [message(2, 60, "hi")], [message(3, 70, "x")], [message(4, 1, "STOP")], [message(5, 71, "y")]], MESSAGES)
    got, _ = run(spark, root, spark.createDataFrame([], STORED), "1 day")
    assert {r.msg_id: r.action for r in got.collect()} == {1: "reply", 2: "reply", 3: "suppressed", 4: "opt_out", 5: "suppressed"}


def test_a_batch_that_died_is_merged_once(spark):
    root = tempfile.mkdtemp(prefix="carelake-late-")
    replay(spark, root, LATE, MESSAGES)
    convs = stored(spark)
    with pytest.raises(Exception):
        run(spark, root, convs, "30 days", fail_at=1)
    got, store = run(spark, root, convs, "30 days")
    check_twin(spark, got, store, spark.read.parquet(f"{root}/in"), convs)
    assert store.sweep() > 0 and store.sweep() == 0
    check_twin(spark, got, store, spark.read.parquet(f"{root}/in"), convs)


def logins(spark, root, batches, grace_s, lateness):
    issues = [(e, h, f"s{i}", t, t + 300, i) for e, h, t, i in [x[1:] for b in batches for x in b if x[0] == "issue"]]
    attempts = [(e, h, t, i) for e, h, t, i in [x[1:] for b in batches for x in b if x[0] == "attempt"]]
    issues = spark.createDataFrame(issues, "email string, code_hash string, user_sub string, issued_s long, expiry_s long, issue_id long")
    attempts = spark.createDataFrame(attempts, "email string, code_hash string, attempt_s long, attempt_id long")
    events = SL.login_events(issues, attempts)
    for b in batches:
        part = events.where(F.struct("kind", "id").isin([F.struct(F.lit(int(x[0] == "attempt")), F.lit(x[4]).cast("long")) for x in b]))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    out = SL.login_stream(stream_parquet(spark, f"{root}/in", events.schema), grace_s=grace_s, lateness=lateness)
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck", spark, 2)
    got = latest(spark.read.parquet(f"{root}/out"), ["attempt_id"])
    return ({r.attempt_id: (r.status, r.issue_id, r.user_sub) for r in got.collect()},
            {r.attempt_id: (r.status, r.issue_id, r.user_sub) for r in A.audit_logins(issues, attempts).collect()})


def test_late_login_events_give_the_batch_twins_rows(spark):
    a = "a@example.com"
    got, want = logins(spark, tempfile.mkdtemp(prefix="carelake-late-"), [
        [("attempt", a, "h1", 1100, 1), ("attempt", a, "h2", 90_000, 2)],
        [("issue", a, "h1", 1000, 1), ("issue", " A@example.com", "h2", 89_900, 2), ("attempt", a, "", 1200, 3)],
        [("attempt", a, "zz", 1050, 4), ("attempt", a, "h1", 1090, 5), ("attempt", "b@example.com", "h", 5, 6)],
        [("attempt", a, "h2", 90_300, 7), ("issue", a, "h3", 90_001, 8)]], 10 ** 9, "3 days")
    assert got == want and got[1][0] == "no_session" and got[5][0] == "success" and got[2][0] == "success"


def test_a_code_is_dropped_in_event_time(spark):
    a, b = "a@example.com", "b@example.com"
    got, want = logins(spark, tempfile.mkdtemp(prefix="carelake-late-"), [
        [("issue", a, "h1", 1000, 1)], [("attempt", b, "x", 100_000, 2)], [("attempt", b, "x", 200_000, 3)], [("attempt", b, "x", 200_001, 4)],
        [("attempt", a, "h1", 200_002, 5)]], 3600, "1 hour")
    assert want[5][0] == "expired" and got[5][0] == "no_session"   # idle for 3600 s by the events' own clock
    assert all(got[i] == want[i] for i in (2, 3, 4))
