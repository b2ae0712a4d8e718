"""Inputs that once lost rows or killed a job."""

import datetime as dt
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from carelake import session
from carelake.functions.envelope import parse_envelope
from carelake.operators import audit as A
from carelake.operators import conversations as V
from carelake.plans import derived as D
from carelake.sinks.lake import register_uploads, to_uploads, write_lake
from carelake.sinks.versions import current_files, read_current, read_current_uploads
from carelake.sources.extract import UNREADABLE_TEXT, extract_text
from carelake.sources.files import file_inventory
from carelake.sources.xlsx import build_xlsx, read_xlsx
from carelake.streaming import inbound as SI
from carelake.streaming import login as SL
from carelake.streaming.common import run_available_now, stream_parquet
from carelake.streaming.ingest import backfill

T0 = dt.datetime(2026, 6, 1)
NO_CONVS = ("phone_number string, patient_name string, amount_due string, message_type string, conversation_history string, "
            "reply_count int, opt_out boolean, last_inbound_message string")


def test_every_id_has_its_own_phone(spark):
    ids = spark.createDataFrame([(i,) for i in (7, 999, 1234, 9999, 10000, 12345, 123456, 1234567)], "i long")
    assert ids.select(D.phone_of(F.col("i"))).distinct().count() == 8
    assert ids.where("i = 7").select(D.phone_of(F.col("i"))).first()[0] == "+16025550007"


def test_all_records_of_an_envelope_act(spark):
    raw = ('{"Records": [{"Sns": {"Message": "{\\"originationNumber\\": \\"+1\\", \\"messageBody\\": \\"STOP\\"}"}}, '
           '{"Sns": {"Message": "{\\"originationNumber\\": \\"+1\\", \\"messageBody\\": \\"hello\\"}"}}]}')
    rows = spark.createDataFrame([(1, T0, raw), (1, T0, raw), (None, T0, raw), (None, T0, raw)], "msg_id long, ts timestamp, raw string")
    rec = parse_envelope(rows, id_cols=["msg_id", "ts"])
    convs = spark.createDataFrame([], NO_CONVS)
    assert V.inbound_actions(rec, convs).count() == 8
    once = V.inbound_actions(rec, convs, dedupe=True)
    assert once.count() == 6 and [r.action for r in once.where("msg_id = 1").orderBy("rec").collect()] == ["opt_out", "suppressed"]


def test_late_messages_are_not_lost(spark):
    root = tempfile.mkdtemp(prefix="carelake-late-")
    schema = "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean"
    for rows in ([(1, T0 + dt.timedelta(days=9), "+1", "hi", "r", True)], [(2, T0, "+1", "STOP", "r", True), (3, T0, " ", "x", "r", True)],
                 [(4, T0 + dt.timedelta(days=10), "+1", "hi", "r", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    src = spark.read.parquet(f"{root}/in")
    out = SI.inbound_stream(stream_parquet(spark, f"{root}/in", src.schema), spark.createDataFrame([], NO_CONVS))
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck")
    got = {r.msg_id: r.action for r in spark.read.schema(SI.OUTPUT_SCHEMA).parquet(f"{root}/out").collect()}
    assert got == {1: "reply", 2: "opt_out", 3: "ignore", 4: "suppressed"}


def test_prompts_see_the_replies_before_them(spark, monkeypatch):
    monkeypatch.setattr(V, "REPLY_BLOCK", 4)   # many blocks
    stored = '[{"role": "user", "content": "s1"}, {"role": "assistant", "content": "s2"}]'
    convs = spark.createDataFrame([("+1", "P", "5", "balance", stored, 0, False, None), ("+9", "Q", None, None, "junk", 0, True, None)], NO_CONVS)
    rows = []
    for i in range(40):
        body = {7: "STOP", 12: "START"}.get(i, f"q{i}")
        rows.append((i, T0 + dt.timedelta(minutes=25 * (i // 2)), "+1", body, f"a{i}", i % 3 != 1))
    rows += [(100, None, "+2", "x", "y", None), (101, T0, "+9", "x", "y", True), (102, None, "+2", "z", "w", True), (103, T0, "+2", "v", None, True)]
    inbound = spark.createDataFrame(rows, "msg_id long, ts timestamp, phone string, body string, reply string, sent boolean")
    got = {r.msg_id: [m.content for m in r.messages][1:] for r in
           V.sms_prompts_in_order(V.inbound_actions(inbound, convs), convs, n=7).collect()}
    past, want = {"+1": ["s1", "s2"], "+2": []}, {}
    for i, _, _, body, reply, sent in rows[:40]:
        if 7 <= i <= 12:
            continue
        want[i] = past["+1"][-7:] + [body]
        past["+1"] += [body, reply] if sent else []
    assert got == want | {100: ["x"], 102: ["z"], 103: ["z", "w", "v"]}


def test_records_of_an_envelope_keep_their_order(spark):
    rows = [(1, T0, r, "+1", b, f"to {b}", True) for r, b in ((3, "a"), (1, "c"), (2, "b"))]
    inbound = spark.createDataFrame(rows, "msg_id long, ts timestamp, rec int, phone string, body string, reply string, sent boolean")
    convs = spark.createDataFrame([], NO_CONVS)
    item = V.fold_conversations(convs, V.inbound_actions(inbound, convs)).first()
    assert item.last_inbound_message == "a" and item.reply_count == 3
    assert [item.conversation_history.index(f'"{b}"') for b in "cba"] == sorted(item.conversation_history.index(f'"{b}"') for b in "cba")


def _logs(spark):
    issues = spark.createDataFrame([("a@example.com", "h", "s", 1000, 1300, 1)],
                                   "email string, code_hash string, user_sub string, issued_s long, expiry_s long, issue_id long")
    attempts = spark.createDataFrame([(" A@Example.com ", "h", 1100, 10), ("  ", "h", 1150, 11), ("a@example.com", "h", 1200, 12), (None, "h", 1, 13)],
                                     "email string, code_hash string, attempt_s long, attempt_id long")
    return issues, attempts


WANT = {10: "success", 11: "bad_request", 12: "no_session", 13: "bad_request"}


def test_emails_are_normalised_in_the_audit(spark):
    assert {r.attempt_id: r.status for r in A.audit_logins(*_logs(spark)).collect()} == WANT


def test_emails_and_late_attempts_in_the_login_stream(spark):
    root = tempfile.mkdtemp(prefix="carelake-late-login-")
    ev = SL.login_events(*_logs(spark))
    ev.where("id <> 13").coalesce(1).write.parquet(f"{root}/in")
    ev.where("id = 13").coalesce(1).write.mode("append").parquet(f"{root}/in")   # t = 1: far behind
    out = SL.login_stream(stream_parquet(spark, f"{root}/in", ev.schema))
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck")
    assert {r.attempt_id: r.status for r in spark.read.schema(SL.OUTPUT_SCHEMA).parquet(f"{root}/out").collect()} == WANT


def test_campaign_meets_a_phone_stored_twice(spark):
    convs = spark.createDataFrame([("+16025550001", "P", "5", "balance", "[]", 0, True, None)] * 2, NO_CONVS)
    patients = spark.createDataFrame([(1, "f", "A", "B", "5", "602-555-0001", None, True)],
                                     "row_index long, file string, first_name string, last_name string, amount_due string, mobile_number string, mobilenumber string, sent boolean")
    attempts, _ = V.run_campaign(patients, convs)
    assert [r.outcome for r in attempts.collect()] == ["suppressed"]


def _put(root, name, data):
    path = os.path.join(root, "user_id=u1/year=2026/month=06", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_ingest_isolates_bad_files_and_replaces_reuploads(spark, tmp_path):
    up, lake = str(tmp_path / "uploads"), str(tmp_path / "lake")
    _put(up, "a.csv", b"id,v\n1,2\n3,4\n")
    _put(up, "head.csv", b"id,v\n")
    bad, old = _put(up, "bad.xlsx", b"not a zip"), _put(up, "old.xls", b"\xd0\xcf\x11\xe0 legacy")
    backfill(spark, up, lake)
    rows = lambda: sorted((r.id, str(r.v)) for r in read_current(spark, lake, "csv").select("id", "v").collect())
    assert rows() == [(1, "2"), (3, "4")]
    manifest = {r.key.split("/")[-1]: r.status for r in current_files(spark, lake).collect()}
    assert manifest == {"a.csv": "converted", "head.csv": "converted", "bad.xlsx": "placeholder", "old.xls": "placeholder"}
    assert backfill(spark, up, lake) == 0   # nothing stays pending
    _put(up, "a.csv", b"id,v\n1,text\n")
    backfill(spark, up, lake, force=True)
    assert [r.v for r in read_current(spark, lake, "csv").where("_filename = 'a.csv'").collect()] == ["text"]
    assert read_xlsx(spark, [bad, old]).collect() == []
    files = spark.read.format("binaryFile").load([bad])
    assert [r.text for r in extract_text(files).collect()] == [UNREADABLE_TEXT]


def test_ingest_fills_the_uploads_table(spark, tmp_path):
    up, lake, table = (str(tmp_path / n) for n in ("uploads", "lake", "table"))
    _put(up, "a.csv", b"\n  \nid,v\n1,2\n3,4\n")
    _put(up, "b.csv", b"id,v\n5,6\n")
    _put(up, "c.csv", b"id,v\n7,8\n")
    _put(up, "old.xls", b"legacy")
    _put(up, "two words.csv", b"id,w\n9,0\n")
    for again in range(2):
        backfill(spark, up, lake, force=True, uploads_root=table, chunk_files=2)
        got = sorted((r.filename, r.row_index, r.content) for r in read_current_uploads(spark, table, lake).collect())
        want = [("a.csv", 1, '{"id":1,"v":2}'), ("a.csv", 2, '{"id":3,"v":4}'), ("b.csv", 1, '{"id":5,"v":6}'), ("c.csv", 1, '{"id":7,"v":8}')]
        assert got[:len(want)] == want and [g[0] for g in got[len(want):]] == ["old.xls", "two words.csv"]
    assert all(r.uploaded_at is not None for r in read_current_uploads(spark, table, lake).collect())
    _put(up, "a.csv", b"id,v\n")   # header only: its rows go
    _put(up, "b.csv", b"id,v\nx,6\n")
    backfill(spark, up, lake, force=True, uploads_root=table)
    got = sorted((r.filename, r.content) for r in read_current_uploads(spark, table, lake).collect())
    assert got[:2] == [("b.csv", '{"id":"x","v":6}'), ("c.csv", '{"id":"7","v":8}')]


def test_names_that_spark_skips_are_listed_and_converted(spark, tmp_path):
    up, lake, table = (str(tmp_path / n) for n in ("uploads", "lake", "table"))
    _put(up, "_1_.csv", b"id,v\n1,2\n")
    _put(up, ".x y.csv", b"id,v\n3,4\n")
    _put(up, "plain.csv", b"id,v\n5,6\n")
    _put(up, "_book.xlsx", build_xlsx([("S", [["h"], ["c"]])]))
    want = ["_1_.csv", ".x y.csv", "plain.csv", "_book.xlsx"]
    for user in (None, "u1"):
        names = [r.name for r in file_inventory(spark, str(tmp_path), user).collect()]
        assert sorted(names) == sorted(want)
    backfill(spark, up, lake, uploads_root=table)
    assert sorted((r.id, r.v) for r in read_current(spark, lake, "csv").collect()) == [(1, 2), (3, 4), (5, 6)]
    assert sorted(r.filename for r in read_current_uploads(spark, table, lake).collect()) == sorted(want)
    keys = {r.key for r in current_files(spark, lake).where("status = 'converted'").collect()}
    assert keys == {f"user_id=u1/year=2026/month=06/{n}" for n in want}
    assert backfill(spark, up, lake) == 0


def test_uploads_of_one_month_stand_side_by_side(spark, tmp_path):
    root = str(tmp_path / "it's")
    for name, n in (("f1.csv", 25), ("f2.csv", 25), ("f1.csv", 3)):
        path = str(tmp_path / f"in-{n}-{name}")
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(path)
        src = spark.read.parquet(path).withColumns({"_source_key": F.lit(f"k/{name}"), "_filename": F.lit(name), "user_id": F.lit("u"), "year": F.lit("2026"), "month": F.lit("06")})
        write_lake(to_uploads(src, uploaded_at=F.lit("2026-06-01 00:00:00")), root)
    t = register_uploads(spark, root, table="uploads_side")
    assert {r.filename: r["count"] for r in t.groupBy("filename").count().collect()} == {"f1.csv": 3, "f2.csv": 25}
    spark.sql("DROP TABLE uploads_side")


def test_a_machine_local_folder_is_refused_off_local_mode():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as E; from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local-cluster[1,1,1024]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[2])"
            ".getOrCreate(); print('ROWS', E.queries()['docx_text'](s, '/root/testdata/sf0.001').count())")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    work = tmp_path / "home"   # executors log below Spark's home
    import pyspark
    work.mkdir()
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            os.symlink(os.path.join(os.path.dirname(pyspark.__file__), name), work / name)
    env["SPARK_HOME"] = str(work)
    r = subprocess.run([sys.executable, "-c", code, repo, str(tmp_path / "ck")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
