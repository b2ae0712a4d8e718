"""The uploads source, versions and the ingest over every upload."""

import io
import os

import pytest
from pyspark.sql import functions as F

from carelake.sinks import versions as V
from carelake.sources.uploads import list_uploads, stream_uploads
from carelake.streaming import ingest as I
from carelake.streaming.ingest import backfill, convert_key, header_signature, ingest_stream


def put(root, key, data=b""):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


FOLDER = "user_id=u1/year=2026/month=06"
TREE = {f"{FOLDER}/_1_.csv": b"id,v\n1,2\n", f"{FOLDER}/.x.csv": b"id,v\n3,4\n", f"{FOLDER}/plain.csv": b"id,v\n5,6\n", f"{FOLDER}/_void.csv": b"",
        f"{FOLDER}/blank.txt": b"\n \n", "user_id=u 2/year=2025/month=12/a%20b.csv": b"id,v\n7,8\n", "user_id=u3/year=2026/month=01/.hid.pdf": b"%PDF"}


@pytest.fixture
def tree(tmp_path):
    for k, v in TREE.items():
        put(str(tmp_path / "uploads"), k, v)
    put(str(tmp_path / "uploads"), "user_id=u1/stray.csv", b"not in a month\n")
    return str(tmp_path)


def test_every_file_is_listed(spark, tree):
    got = {r.path.split("/uploads/")[1]: (r.length, bytes(r.content)) for r in list_uploads(spark, f"{tree}/uploads", content=True).collect()}
    assert got == {k: (len(v), v) for k, v in TREE.items()}
    assert {r.path.split("/")[-1] for r in list_uploads(spark, f"file:{tree}/uploads/", "u1").collect()} == {k.split("/")[-1] for k in TREE if "u1" in k}
    assert list_uploads(spark, f"{tree}/nothing").collect() == []
    assert list_uploads(spark, f"{tree}/uploads", "nobody").collect() == []


def test_the_stream_gives_every_file_once_and_changed_ones_again(spark, tree):
    seen = []

    def run(fail=False):
        def batch(df, _id):
            rows = [(r.path.split("/")[-1], r.length) for r in df.collect()]
            if fail:
                raise RuntimeError("killed")
            seen.extend(rows)
        q = (stream_uploads(spark, f"{tree}/uploads", f"{tree}/log", max_files=2).writeStream.foreachBatch(batch)
             .option("checkpointLocation", f"{tree}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    with pytest.raises(Exception):
        run(fail=True)
    put(f"{tree}/uploads", f"{FOLDER}/late.csv", b"x")
    os.utime(f"{tree}/uploads/{FOLDER}/late.csv", (0, 0))   # older than all that have been seen
    assert I.unfinished(spark, f"{tree}/ck")
    run()   # repeats the batch that died
    assert not I.unfinished(spark, f"{tree}/ck")
    run()
    assert sorted(seen) == sorted([(k.split("/")[-1], len(v)) for k, v in TREE.items()] + [("late.csv", 1)])
    run()
    assert len(seen) == len(TREE) + 1
    put(f"{tree}/uploads", f"{FOLDER}/plain.csv", b"id,v\n5,66\n")
    run()
    assert seen[len(TREE) + 1:] == [("plain.csv", 10)]


def lake_rows(spark, lake):
    return sorted((r.id, r.v, r._source_key) for r in V.read_current(spark, lake, "csv").select("id", "v", "_source_key").collect())


def test_stream_and_backfill_convert_the_same(spark, tree):
    ingest_stream(spark, f"{tree}/uploads", f"{tree}/s", f"{tree}/ck", max_files=2)
    backfill(spark, f"{tree}/uploads", f"{tree}/b", chunk_files=2)
    want = sorted((int(v[5:6]), int(v[7:8]), k) for k, v in TREE.items() if v.startswith(b"id"))
    for lake in (f"{tree}/s", f"{tree}/b"):
        assert lake_rows(spark, lake) == want
        status = {r.key: r.status for r in V.current_files(spark, lake).collect()}
        assert status == {k: "converted" if v.startswith(b"id") else "placeholder" for k, v in TREE.items() if not k.endswith("pdf")}
    put(f"{tree}/uploads", f"{FOLDER}/plain.csv", b"id,v\n50,60\n")
    ingest_stream(spark, f"{tree}/uploads", f"{tree}/s", f"{tree}/ck")
    assert (50, 60, f"{FOLDER}/plain.csv") in lake_rows(spark, f"{tree}/s") and len(lake_rows(spark, f"{tree}/s")) == len(want)


def test_readers_see_old_or_new_rows_and_a_killed_batch_runs_again(spark, tmp_path, monkeypatch):
    up, lake, table = (str(tmp_path / n) for n in ("uploads", "lake", "table"))
    put(up, f"{FOLDER}/a.csv", b"id,v\n1,1\n2,2\n")
    put(up, f"{FOLDER}/b.csv", b"id,v\n3,3\n")
    backfill(spark, up, lake, uploads_root=table)
    reader = V.read_current(spark, lake, "csv").select("id", "v")
    old = [(1, 1), (2, 2), (3, 3)]
    put(up, f"{FOLDER}/a.csv", b"id,v\nx,9\n")   # other types, so another root
    seen = []
    commit = I.commit

    def looking(*args):
        seen.append(sorted((r.id, r.v) for r in V.read_current(spark, lake, "csv").collect()))
        seen.append(sorted(r.content for r in V.read_current_uploads(spark, table, lake).collect()))
        raise RuntimeError("killed before the commit")
    monkeypatch.setattr(I, "commit", looking)
    with pytest.raises(RuntimeError):
        backfill(spark, up, lake, force=True, uploads_root=table)
    assert seen == [old, ['{"id":1,"v":1}', '{"id":2,"v":2}', '{"id":3,"v":3}']]
    assert sorted(tuple(r) for r in V.read_current(spark, lake, "csv").select("id", "v").collect()) == old
    monkeypatch.setattr(I, "commit", commit)
    backfill(spark, up, lake, force=True, uploads_root=table)
    new = [("3", 3), ("x", 9)]
    assert sorted(tuple(r) for r in reader.collect()) == old   # begun before, not swept yet
    assert sorted((str(r.id), r.v) for r in V.read_current(spark, lake, "csv").collect()) == new
    assert sorted(r.content for r in V.read_current_uploads(spark, table, lake).collect()) == ['{"id":"3","v":3}', '{"id":"x","v":9}']
    folders = sum(len([d for d in ds if d.startswith("_filename=")]) for top in (lake, table) for _, ds, _ in os.walk(top))
    assert folders == 12                       # three attempts of two files, in the lake and in the table
    assert V.sweep(spark, lake, table, older_s=3600) == 0
    assert V.sweep(spark, lake, table, older_s=-1) == 4 + 2   # the replaced files' folders, and the killed attempt's two
    left = [d for top in (lake, table) for _, ds, _ in os.walk(top) for d in ds if d.startswith("_filename=")]
    assert sorted(left) == ["_filename=a.csv"] * 2 + ["_filename=b.csv"] * 2
    assert sorted((str(r.id), r.v) for r in V.read_current(spark, lake, "csv").collect()) == new
    assert V.sweep(spark, lake, table, older_s=-1) == 0


def test_a_batch_without_the_table_leaves_the_tables_rows(spark, tmp_path):
    up, lake, table = (str(tmp_path / n) for n in ("uploads", "lake", "table"))
    put(up, f"{FOLDER}/a.csv", b"id,v\n1,1\n")
    backfill(spark, up, lake, uploads_root=table)
    backfill(spark, up, lake, force=True)
    assert [r.content for r in V.read_current_uploads(spark, table, lake).collect()] == ['{"id":1,"v":1}']
    put(up, f"{FOLDER}/a.csv", b"id,v\n2,2\n")
    assert convert_key(spark, f"{FOLDER}/a.csv", up, lake, table) == 1
    assert [r.content for r in V.read_current_uploads(spark, table, lake).collect()] == ['{"id":2,"v":2}']
    V.register_current_uploads(spark, table, lake, "uploads_now")
    assert spark.sql("SELECT count(*) FROM uploads_now WHERE year >= '2026'").first()[0] == 1


def test_folder_names_are_those_that_spark_writes(spark, tmp_path):
    names = ["a b.csv", "a%20b.csv", "x=y:z.csv", "q?*[1]{2}^.csv", "it's#.csv", "é.csv"]
    spark.createDataFrame([(n, 1) for n in names], "_filename string, v int").write.partitionBy("_filename").parquet(str(tmp_path / "p"))
    assert {d for d in os.listdir(tmp_path / "p") if d.startswith("_filename")} == {V.partition_folder(_filename=n) for n in names}


@pytest.mark.parametrize("text, line", [
    (b"", None), (b"\n \r\n\t", None), (b"a,b\n1,2", b"a,b"), (b"\n\n a,b\r\n1", b" a,b"), (b"x" * 200_000, b"x" * 200_000),
    (b"\n" * 3_000_000 + b"a,b\n", b"a,b"), (b" " * 2_000_000 + b"a\nb", b" " * 2_000_000 + b"a"), (b"a\rb", b"a")])
def test_headers_are_found_wherever_they_are(text, line):
    import hashlib
    assert header_signature(io.BytesIO(text)) == (None if line is None else hashlib.sha256(line).hexdigest()[:16])


def test_rows_below_a_late_header_are_kept(spark, tmp_path):
    up, lake = str(tmp_path / "uploads"), str(tmp_path / "lake")
    put(up, f"{FOLDER}/late.csv", b"\n" * 1_200_000 + b"id,v\n1,2\n")
    put(up, f"{FOLDER}/wide.csv", b"a" * 1_100_000 + b",v\n1,2\n")
    put(up, f"{FOLDER}/wider.csv", b"a" * 1_100_001 + b",v\n1,2\n")
    backfill(spark, up, lake)
    assert V.current_files(spark, lake).where("status = 'converted'").count() == 3
    assert V.read_current(spark, lake, "csv").where("v = 2").count() == 3
