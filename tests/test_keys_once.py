"""The ingest's cost a row: keys come from files, and most texts are held against one form."""

import os
import random

from pyspark.sql import functions as F

import carelake.streaming.ingest as ingest
from carelake.sinks.versions import read_current
from carelake.sources.typed_csv import TYPES, as_type, fits_each


def _put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(data)


def test_keys_are_derived_once_a_file(spark, tmp_path, monkeypatch):
    root, plans = str(tmp_path), []
    names = ["a b%20+.csv", "é#1.csv", "_(1).csv"]
    for i, n in enumerate(names):
        _put(f"{root}/uploads/user_id=u{i}/year=2024/month=0{i + 1}/{n}", "path,key,_key,_filename\n" + f"{i},x,y,z\n" * 20)
    write = ingest.write_version

    def spy(rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, *args)
    monkeypatch.setattr(ingest, "write_version", spy)
    assert ingest.backfill(spark, f"{root}/uploads", f"{root}/lake", uploads_root=f"{root}/long") == 60
    assert plans and not any("regexp_" in p or "url_decode" in p for p in plans)
    rows = read_current(spark, f"{root}/lake", "csv").select("_source_key", "user_id", "month", "_filename", F.col("path").cast("int"), "key", "_key").distinct()
    assert {tuple(r) for r in rows.collect()} == {(f"user_id=u{i}/year=2024/month=0{i + 1}/{n}", f"u{i}", f"0{i + 1}", n, i, "x", "y")
                                                  for i, n in enumerate(names)}


def test_masks_are_those_of_every_type_tried_in_turn(spark):
    rng = random.Random(3)
    parts = ["1", "0", "42", "2024", "-", "-01", "-31", "2024-02-29", "T10:11:12", " 10:11", ".5", ".", ",", ",123", "e", "E5", "e-3", "+", "Inf", "NaN",
             "true", "FALSE", ":", "Z", "+01:00", " ", "x", "é", "\n", " ", "999999999", "2147483648", "123456789012345678"]
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(6000)} | {"2147483647", "0002147483648", "9" * 18, "9" * 19})
    every, t = F.lit(0), F.col("t")
    for i, (kind, form) in enumerate(TYPES):
        every = every.bitwiseOR(F.when(t.rlike(f"^({form})$") & as_type(t, kind).isNotNull(), 1 << i).otherwise(0))
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(8)
    got = df.select("t", every.alias("want"), fits_each([t])[0].alias("got")).where("got IS DISTINCT FROM want").collect()
    assert got == []
