"""Laws from the test strategy, on the driver data, plus property tests and
tables of cases for the column functions."""

import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from carelake import functions as C
from carelake.operators import reports as R
from carelake.plans.tables import table
from conftest import SF_SMALL

Q = E.queries()
PROP = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def test_per_file_sums_add_up_to_combined(spark):
    o = table(spark, SF_SMALL, "orders")
    files = [r[0] for r in o.select("o_orderpriority").distinct().collect()]
    per = R.per_file(o, "o_orderpriority", [F.sum(R.to_money("o_totalprice")).alias("t"), F.count(F.lit(1)).alias("n")])
    comb = R.combined([o.where(F.col("o_orderpriority") == f) for f in files],
                      [F.sum(R.to_money("o_totalprice")).alias("t"), F.count(F.lit(1)).alias("n")]).first()
    tot = per.agg(F.sum("t"), F.sum("n")).first()
    assert (tot[0], tot[1]) == (comb.t, comb.n)


def test_at_most_one_success_per_issue(spark):
    a = Q["login_audit"](spark, SF_SMALL)
    worst = a.where(F.col("issue_id").isNotNull()).groupBy("issue_id") \
        .agg(F.count_if(F.col("status") == "success").alias("s")).agg(F.max("s")).first()[0]
    assert worst <= 1


def test_history_never_exceeds_20(spark):
    f = Q["fold_conversations"](spark, SF_SMALL)
    assert f.agg(F.max("history_size")).first()[0] <= 20


def test_phones_are_e164_or_null(spark):
    p = Q["normalize_phone"](spark, SF_SMALL)
    bad = p.where(F.col("phone").isNotNull() & ~F.col("phone").rlike(r"^\+1[0-9]{10}$")).count()
    assert bad == 0


def test_stream_equals_batch_on_driver_data(spark):
    s = {r.msg_id: r.action for r in Q["stream_inbound"](spark, SF_SMALL).collect()}
    b = {r.msg_id: r.action for r in Q["inbound_actions"](spark, SF_SMALL).collect()}
    assert s == b


# ------------------------------------------------------------ properties --
def _eval(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", col_fn(F.col("x"))).orderBy("i").collect()]


def money_model(raw):
    if raw is None or raw == "":
        return "0.00"
    cleaned = raw.replace(",", "")
    if re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*", cleaned):
        try:
            return str(Decimal(cleaned.strip()).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        except InvalidOperation:
            pass
    return raw.strip()


phone_text = st.text(alphabet="0123456789 ()-+.x1", max_size=16)
money_str = st.one_of(st.decimals(min_value=-10**9, max_value=10**9, places=2).map(str),
                      st.integers(-10**6, 10**6).map(lambda n: f"{n:,}"),
                      st.text(alphabet="0123456789.,-$ n/a", max_size=10))


@PROP
@given(st.lists(st.one_of(st.none(), phone_text), min_size=20, max_size=60))
def test_phone_shape_and_digits(spark, values):
    """A result has the E.164 shape, ends in the input's last ten digits, survives a second pass, and ignores punctuation."""
    got = _eval(spark, C.normalize_phone, values)
    for raw, phone in zip(values, got):
        digits = [c for c in raw or "" if c.isdigit()]
        assert (phone is not None) == ("".join(digits[:-10]) in ("", "1") and len(digits) >= 10)
        if phone is not None:
            assert phone[:2] == "+1" and list(phone[2:]) == digits[-10:]
    assert _eval(spark, C.normalize_phone, got) == got
    spaced = [None if v is None else " ".join(v) for v in values]
    assert _eval(spark, C.normalize_phone, spaced) == got


@PROP
@given(st.lists(st.one_of(st.none(), money_str), min_size=20, max_size=60))
def test_money_property(spark, values):
    assert _eval(spark, C.money_text, values) == [money_model(v) for v in values]


@PROP
@given(st.lists(st.text(max_size=12), min_size=20, max_size=60))
def test_strip_property(spark, values):
    assert _eval(spark, C.pystrip, values) == [v.strip() for v in values]


@PROP
@given(st.lists(st.text(max_size=30), min_size=20, max_size=60), st.integers(0, 20))
def test_truncate_property(spark, values, n):
    got = _eval(spark, lambda c: C.truncate_text(c, n, "~"), values)
    assert got == [v if len(v) <= n else v[:n] + "~" for v in values]


@PROP
@given(st.lists(st.text(alphabet="ab c.(1)/é_-", max_size=12), min_size=20, max_size=60))
def test_safe_filename_property(spark, values):
    got = _eval(spark, C.safe_filename, values)
    assert got == [re.sub(r"[^a-zA-Z0-9.\-_]", "_", v.strip()) for v in values]
    assert _eval(spark, C.safe_filename, got) == got


COMMANDS = {"stop": ["STOP", "STOPALL", "UNSUBSCRIBE", "CANCEL", "END", "QUIT"], "help": ["HELP"], "start": ["START", "UNSTOP"],
            "message": ["stop please", "helper", "yes", "start!"], "ignore": ["", "  ", "\t"]}


def test_commands_in_any_case_and_padding(spark):
    rows = [(v, want) for want, words in COMMANDS.items() for w in words for v in (w, w.lower(), w.title(), f" {w}\n")]
    df = spark.createDataFrame(rows, "b string, want string").withColumn("got", C.classify_command(F.lit("+16025550100"), "b"))
    assert df.where("got <> want").collect() == []


@pytest.mark.parametrize("phone", ["", "  ", None])
def test_messages_without_a_sender_are_ignored(spark, phone):
    df = spark.createDataFrame([(phone, w) for ws in COMMANDS.values() for w in ws], "p string, b string")
    assert {r[0] for r in df.select(C.classify_command("p", "b")).collect()} == {"ignore"}


@PROP
@given(st.lists(st.tuples(st.text(alphabet="ab/.", max_size=6), st.text(alphabet="abXY_", min_size=1, max_size=6), st.text(alphabet="abXY", max_size=4)),
                min_size=20, max_size=60))
def test_names_come_apart_as_they_were_joined(spark, parts):
    keys = [f"{folder}/{stem}.{ext}" for folder, stem, ext in parts]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string").orderBy("i")
    b = C.basename("k")
    for (_, stem, ext), r in zip(parts, df.select(b.alias("b"), C.extension(b).alias("e"), C.extension_or_name(b).alias("n")).collect()):
        assert (r.b, r.e, r.n) == (f"{stem}.{ext}", ext.lower(), ext.lower())


def test_names_without_an_extension(spark):
    got = spark.createDataFrame([("a/README",), ("x/",), ("Plain",)], "k string").select(
        C.basename("k").alias("b"), C.extension(C.basename("k")).alias("e"), C.extension_or_name(C.basename("k")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("README", "", "readme"), ("x/", "", "x/"), ("Plain", "", "plain")]
