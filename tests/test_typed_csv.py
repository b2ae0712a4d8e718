"""CSV types from one read."""

import datetime as dt
import math
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import carelake.streaming.ingest as ingest
from carelake.sinks.versions import current_files
from carelake.sources.typed_csv import TYPES, fits, narrowest, read_csv_once


def _types(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return narrowest(df.agg(F.bit_and(fits(F.col("t")))).first()[0])


@pytest.mark.parametrize("texts,kind", [
    (["1", "-2", "+3", "", None], "int"),
    (["1", "3000000000"], "bigint"),
    (["1", "12345678901234567890"], "decimal(38,0)"),
    (["1,000", "12"], "decimal(38,0)"),
    (["12345678901234567890", "1.5"], "double"),
    (["1,000", "1.5"], "string"),           # neither a decimal of whole numbers nor a double holds both
    (["1e3", ".5", "NaN", "-Inf"], "double"),
    (["1d", "2"], "string"),
    (["2024-01-31", "2024-02-29"], "date"),
    (["2024-01-31", "2023-02-29"], "string"),   # no such day
    (["2024-01-31", "2024-02-01 10:11:12.5"], "timestamp"),
    (["2024-01-31T00:00:00.000Z"], "timestamp"),
    (["2024-01-31", "7"], "string"),
    (["true", "FALSE"], "boolean"),
    (["true", "1"], "string"),
    ([" 1", "2"], "string"),
    (["9" * 39], "double"),
    (["", None], "string"),
])
def test_lattice(spark, texts, kind):
    assert _types(spark, texts) == kind
    assert _types(spark, texts[::-1]) == kind


def test_meet_is_the_same_however_values_are_grouped(spark):
    texts = ["1", "3000000000", "1.5", "2024-01-01", "true", "x", "1,000", ""]
    masks = dict(spark.createDataFrame([(t,) for t in texts], "t string").select("t", fits(F.col("t"))).collect())
    assert masks[""] is None and masks["x"] == 0
    assert all(masks[t] for t in texts if t not in ("", "x"))
    assert len(TYPES) <= 31


def _put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(data)
    return path


def test_values(spark, tmp_path):
    p = _put(str(tmp_path / "a.csv"), 'n,x,d,t,b,s,none,big\n1,1.5,2024-01-31,2024-01-31 01:02:03,true,"a, b",,12345678901234567890\n'
             '2,Inf,,2024-02-01,false,"",,"1,000"\n,,,,,,,\n3\n')
    with read_csv_once(spark, [p], {"k": F.lit(7)}) as (df, names):
        assert names == ["n", "x", "d", "t", "b", "s", "none", "big"]
        assert [f.dataType.simpleString() for f in df.schema] == ["int", "double", "date", "timestamp", "boolean", "string", "string", "decimal(38,0)", "int"]
        rows = [tuple(r) for r in df.collect()]
    one = (1, 1.5, dt.date(2024, 1, 31), dt.datetime(2024, 1, 31, 1, 2, 3), True, 'a, b', None, Decimal("12345678901234567890"), 7)
    assert one in rows
    two = next(r for r in rows if r[0] == 2)
    assert math.isinf(two[1]) and two[2] is None and two[7] == Decimal(1000)
    assert len(rows) == 4 and sum(r[0] == 3 for r in rows) == 1


def test_names_beside_kept_columns(spark, tmp_path):
    """A file's own columns stay, whatever they are called."""
    p = _put(str(tmp_path / "a.csv"), "k,K_2,c0,a.b,a b\n1,2,3,4,5\n")
    with read_csv_once(spark, [p], {"k": F.lit("kept")}) as (df, names):
        assert sorted(map(str, df.first())) == ["1", "2", "3", "4", "5", "kept"]
        assert df.select("k").first()[0] == "kept" and len({n.lower() for n in df.columns}) == 6


def test_scratch_files_go(spark, tmp_path):
    p = _put(str(tmp_path / "a.csv"), "a\n1\n")
    with read_csv_once(spark, [p]) as (df, _):
        folder = os.path.dirname(df.inputFiles()[0].replace("file://", "").replace("file:", ""))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_ingest_reads_a_csv_once(spark, tmp_path, monkeypatch):
    """Neither lake rows nor ``uploads`` rows are read from the CSV files again; a file without rows converts too."""
    root, seen = str(tmp_path), []
    folder = f"{root}/uploads/user_id=u1/year=2024/month=01"
    _put(f"{folder}/a.csv", "a,b\n" + "".join(f"{i},{i / 2}\n" for i in range(50)))
    _put(f"{folder}/b.csv", "a,b\n9,x\n")
    _put(f"{folder}/only_header.csv", "p,q\n")
    plain = ingest.write_version

    def watched(df, *args):
        seen.extend(df.inputFiles())
        return plain(df, *args)
    monkeypatch.setattr(ingest, "write_version", watched)
    assert ingest.backfill(spark, f"{root}/uploads", f"{root}/lake", uploads_root=f"{root}/long") == 51
    assert seen and not any("/uploads/" in f or f.endswith(".csv") for f in seen)
    assert {r.key.rsplit("/", 1)[1]: r.status for r in current_files(spark, f"{root}/lake").collect()} == {
        n: "converted" for n in ("a.csv", "b.csv", "only_header.csv")}
    long = spark.read.parquet(f"{root}/long")
    assert long.count() == 51
    assert [r.row_index for r in long.where("filename = 'a.csv'").orderBy("row_index").collect()] == list(range(1, 51))
    assert long.where("filename = 'a.csv' AND row_index = 4").first().content == '{"a":3,"b":"1.5"}'


def test_own_columns_named_like_partitions(spark, tmp_path):
    """A file's own ``month`` stays beside the folder's."""
    root = str(tmp_path)
    _put(f"{root}/uploads/user_id=u1/year=2024/month=01/a.csv", "month,amount\nMay,3\n")
    assert ingest.backfill(spark, f"{root}/uploads", f"{root}/lake", uploads_root=f"{root}/long") == 1
    assert '"May"' in spark.read.parquet(f"{root}/long").first().content


def test_masks_of_odd_texts_are_those_of_every_type_tried_in_turn(spark):
    """One form decides which types a text is held against; that must never hide a type that fits."""
    from carelake.sources.typed_csv import as_type, fits_each
    texts = ["1", "+7", "007", "2147483648", "9223372036854775808", "9" * 39, "1" * 400, "1,234", "1,23", "0,123", "1.5", ".5", "5.", "1e400", "NaN",
             "-Inf", "nan", "2020-01-01", "2020-02-30", "2020-01-01 10:00", "2020-01-01T25:00", "true", "FALSE", "t", "1d", " 1", "1 ", "1\n", "1\x85",
             "1 ", "true\n", "1,234\n", "+", "-", ".", "١٢", "1-URGENT", ""]
    t = F.col("t")
    every = F.lit(0)
    for i, (kind, form) in enumerate(TYPES):
        every = every.bitwiseOR(F.when(t.rlike(f"^({form})$") & as_type(t, kind).isNotNull(), 1 << i).otherwise(0))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = df.select("t", F.when(t != "", every).alias("want"), fits_each([F.lit("x"), t])[1].alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_masks_of_wide_files_stay_short_enough_to_compile(spark):
    """The generated code doesn't hold the masks' conditions once a column."""
    from carelake.sources.typed_csv import fits_each
    df = spark.createDataFrame([tuple("abcdefgh")], ", ".join(f"c{i} string" for i in range(8)))
    plan = df.select(fits_each([F.col(c) for c in df.columns]).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") < 16
