"""Keys that are dense in time, contexts of any length, and the fold's pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelake import functions as C
from carelake.operators import audit as A
from carelake.operators import context as X
from carelake.operators import conversations as V
from carelake.operators.scan import carry_last, dense_buckets

T0 = dt.datetime(2026, 6, 1)


def busy(spark, n=4000):
    """One key with most rows in one hour, a third of them at one time; and a quiet key."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=1234 if i % 3 == 0 else rng.randint(0, 3599), microseconds=0 if i % 3 == 0 else rng.randint(0, 999_999))
        rows.append(("hot", at, i, rng.choice([None, None, True, False])))
    rows += [("quiet", T0 + dt.timedelta(hours=i), n + i, i % 2 == 0) for i in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp, id long, v boolean").withColumn("hour", F.floor(F.unix_micros("ts") / 3_600_000_000))


def test_a_dense_hour_is_spread_and_carries_like_a_window(spark):
    df = busy(spark)
    cut = dense_buckets(df, ["k"], "hour", ["ts", "id"], "b", most=100)
    sizes = {(r.k, r.b): r["count"] for r in cut.groupBy("k", "b").count().collect()}
    assert max(sizes.values()) <= 150 and len([k for k, _ in sizes if k == "hot"]) > 40
    assert all(b.cell == 0 and b.tie == 0 for k, b in sizes if k == "quiet")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: r.p for r in df.withColumn("p", F.last("v", ignorenulls=True).over(w)).collect()}
    got = {r.id: r.p for r in carry_last(cut, ["k"], ["ts", "id"], "b", "v", "p", inclusive=False).collect()}
    assert got == want
    assert dense_buckets(df, ["k"], "hour", ["ts", "id"], "b", most=None).select("b.cell").distinct().count() == 1


@pytest.mark.parametrize("most", [None, 50])
def test_timelines_and_audits_do_not_depend_on_the_cut(spark, most):
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randint(0, 40)), rng.choice(["+1", "+1", "+1", "+2", " "]), rng.choice(["STOP", "start", "hi", "help"]), "r", True)
            for i in range(900)] + [(900, None, "+3", "hi", "r", True), (901, None, "+1", "STOP", "r", True)]
    inbound = spark.createDataFrame(rows, "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")
    convs = spark.createDataFrame([("+3", True), ("+2", False)], "phone_number string, opt_out boolean")
    got = {r.msg_id: r.opted_out_before for r in V.optout_timeline(inbound, convs, most=most).collect()}
    state, want = {"+3": True}, {}
    for i, _, phone, body, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[0])):
        want[i] = state.get(phone, False)
        if phone.strip() and body in ("STOP", "start"):
            state[phone] = body == "STOP"
    assert got == want and got[900] is True
    issues = spark.createDataFrame([("a@x", f"h{i % 3}", "s", 1000 + i // 9, 1300, i) for i in range(300)], "email string, code_hash string, user_sub string, issued_s long, expiry_s long, issue_id long")
    attempts = spark.createDataFrame([("a@x", f"h{i % 4}", 1000 + i // 20, i) for i in range(600)], "email string, code_hash string, attempt_s long, attempt_id long")
    base = sorted(map(tuple, A.audit_logins(issues, attempts, most=None).collect()), key=str)
    assert sorted(map(tuple, A.audit_logins(issues, attempts, most=most).collect()), key=str) == base


def test_parts_put_together_are_the_whole_context(spark):
    docs = spark.createDataFrame([(f"k{i}", "x" * (i * 37 % 900)) for i in range(400)], "key string, text string")
    requests = spark.createDataFrame([(i % 2, i, f"k{i}") for i in range(420)] + [(9, 0, "k5")], "request_id int, ord int, key string")
    whole = {r.request_id: r.context for r in X.combined_context(requests, docs, final_limit=None).collect()}
    parts = X.combined_context_parts(requests, docs, part_chars=2000, bucket_size=16).orderBy("request_id", "part").collect()
    for r, text in whole.items():
        mine = [p for p in parts if p.request_id == r]
        assert "".join(p.context for p in mine) == text
        assert [p.start for p in mine] == [sum(len(q.context) for q in mine[:i]) for i in range(len(mine))]
        assert max(len(p.context) for p in mine) <= 2000 + 1200 and (len(mine) > 20 or r == 9)


def test_a_pair_is_appended(spark):
    df = spark.createDataFrame([('[{"role":"user","content":"a"}]', "q", "r"), (None, "q", None)], "h string, u string, a string")
    got = [[(m.role, m.content) for m in r[0]] for r in df.select(C.append_pair(C.parse_history("h"), F.col("u"), F.col("a"))).collect()]
    assert got == [[("user", "a"), ("user", "q"), ("assistant", "r")], [("user", "q"), ("assistant", None)]]
