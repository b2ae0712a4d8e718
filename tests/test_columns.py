"""Column functions against the edge rows of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from carelake import functions as C


def one(spark, col, rows, schema="x string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_normalize_phone(spark):
    got = one(spark, C.normalize_phone("x"),
              [("(602) 555-0100",), ("1-602-555-0100",), ("2-602-555-0100",), ("555-0100",), (None,)])
    assert got == ["+16025550100", "+16025550100", None, None, None]


def test_phone_output_shape(spark):
    import re
    rows = [(f"{i:010d}",) for i in range(0, 10**10, 10**8 + 7)] + [("1" + "2" * 10,), ("abc",)]
    for v in one(spark, C.normalize_phone("x"), rows):
        assert v is None or re.fullmatch(r"\+1\d{10}", v)


def test_money_text(spark):
    got = one(spark, C.money_text("x"),
              [(None,), ("",), ("0",), ("1,234.5",), (" n/a ",), ("$5",), ("-3",), ("12.34",)])
    assert got == ["0.00", "0.00", "0.00", "1234.50", "n/a", "$5", "-3.00", "12.34"]


def test_money_in_message_keeps_dollar(spark):
    df = spark.createDataFrame([("Ann", "$5")], "n string, a string")
    msg = df.select(C.build_message(F.col("n"), F.col("a"), F.lit("balance"))).first()[0]
    assert "$$5." in msg


def test_patient_name(spark):
    df = spark.createDataFrame([(" ", None), (" Ann ", " Lee "), (None, "Lee")], "f string, l string")
    rows = df.select(C.patient_name("f", "l"), C.message_name("f", "l")).collect()
    assert [tuple(r) for r in rows] == [("", "Patient"), ("Ann Lee", "Ann Lee"), ("Lee", "Lee")]


def test_messages_by_type(spark):
    df = spark.createDataFrame([("Ann", "10", "balance"), ("Ann", "10", "wellness"), ("Ann", "10", None)],
                               "n string, a string, t string")
    got = [r[0] for r in df.select(C.build_message(F.col("n"), F.col("a"), F.col("t"))).collect()]
    assert got[0].startswith("Hi Ann, you have an outstanding bill amount due of $10.00.")
    assert "Annual Wellness Visit" in got[1] and "Annual Wellness Visit" in got[2]


def test_safe_filename_idempotent(spark):
    got = one(spark, C.safe_filename("x"), [("a b(1).csv",), (" ok-name_1.CSV ",)])
    assert got == ["a_b_1_.csv", "ok-name_1.CSV"]
    again = one(spark, C.safe_filename("x"), [(g,) for g in got])
    assert again == got


def test_output_and_upload_key(spark):
    got = one(spark, C.output_key("x"), [("uploads/user_id=a/year=2026/month=06/d.csv",)])
    assert got == ["parquet/user_id=a/year=2026/month=06/d.csv.parquet"]
    df = spark.createDataFrame([("u1", "2026-06-03 10:00:00", "my file.csv")], "u string, t string, n string")
    k = df.select(C.upload_key("u", F.to_timestamp("t"), "n")).first()[0]
    assert k == "uploads/user_id=u1/year=2026/month=06/my_file.csv"


def test_basename_extension(spark):
    df = spark.createDataFrame([("a/b/c.CSV",), ("a/b/",), ("noext",), ("x.tar.gz",)], "k string")
    rows = df.select(C.basename("k").alias("b")).select(
        "b", C.extension("b"), C.extension_or_name("b")).collect()
    assert [tuple(r) for r in rows] == [("c.CSV", "csv", "csv"), ("a/b/", "", "a/b/"),
                                        ("noext", "", "noext"), ("x.tar.gz", "gz", "gz")]


@pytest.mark.parametrize("body,cmd", [(" stop ", "stop"), ("Stop please", "message"), ("unstop", "start"),
                                      ("help", "help"), ("  ", "ignore"), ("QUIT", "stop"), ("\tSTART\n", "start")])
def test_classify_command(spark, body, cmd):
    df = spark.createDataFrame([("+16025550100", body)], "p string, b string")
    assert df.select(C.classify_command("p", "b")).first()[0] == cmd


def test_classify_blank_phone(spark):
    df = spark.createDataFrame([("", "hello")], "p string, b string")
    assert df.select(C.classify_command("p", "b")).first()[0] == "ignore"


def test_pystrip_matches_python(spark):
    vals = ["\t a \n", " b　", "c", ""]
    assert one(spark, C.pystrip("x"), [(v,) for v in vals]) == [v.strip() for v in vals]


def test_history_helpers(spark):
    import json
    h21 = json.dumps([{"role": "user" if i % 2 else "assistant", "content": str(i)} for i in range(21)])
    h3 = json.dumps([{"role": "assistant", "content": "a"}, {"role": "user", "content": "u1"},
                     {"role": "assistant", "content": "b"}])
    df = spark.createDataFrame([(None,), ("",), ("junk",), (h21,), (h3,)], "h string")
    h = C.parse_history("h")
    rows = df.select(F.size(h), F.size(C.last_n(h, 20)), F.size(C.last_n(h, 10)), C.last_user_message(h)).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, None), (0, 0, 0, None), (0, 0, 0, None),
                                        (21, 20, 10, "19"), (3, 3, 3, "u1")]
    first_kept = df.where(F.col("h") == h21).select(C.last_n(h, 20)[0]["content"]).first()[0]
    assert first_kept == "1"


def test_truncate_text(spark):
    df = spark.createDataFrame([("abcde",), ("abcdef",)], "t string")
    got = [r[0] for r in df.select(C.truncate_text("t", 5, "+")).collect()]
    assert got == ["abcde", "abcde+"]


def test_email(spark):
    df = spark.createDataFrame([(" Ann.Lee@Example.COM ",)], "e string")
    e = C.normalize_email("e")
    assert tuple(df.select(e, C.display_name(e)).first()) == ("ann.lee@example.com", "ann.lee")


def test_utf8_replacement(spark):
    raw = bytes.fromhex("61E28241FF62F09F98")
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert df.select(C.make_valid_text("b")).first()[0] == raw.decode("utf-8", errors="replace")


def test_normalize_headers(spark):
    df = spark.createDataFrame([([" First Name ", None, "MOBILE number"],)], "c array<string>")
    assert df.select(C.normalize_headers("c")).first()[0] == ["first name", "", "mobile number"]


def test_parse_envelope_shapes(spark):
    import json
    from carelake.functions.envelope import parse_envelope
    msg = lambda p, b: json.dumps({"originationNumber": p, "messageBody": b})
    rows = [
        (1, json.dumps({"Records": [{"Sns": {"Message": msg("+1", " hi ")}},
                                    {"Sns": {"Message": msg("", "x")}}]})),
        (2, json.dumps({"Records": []})),
        (3, json.dumps({"Records": [{"Sns": {"Message": "not json"}}]})),
        (4, "garbage"),
        (5, json.dumps({"destinationIdentity": " +2 ", "messageBody": "STOP"})),
    ]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = sorted(tuple(r) for r in parse_envelope(df, id_cols=["id"]).collect())
    assert got == [(1, 1, "+1", "hi"), (1, 2, "", "x"), (2, 1, "", ""), (3, 1, "", ""), (4, 1, "", ""),
                   (5, 1, "+2", "STOP")]
