"""The query over every upload: its input is grouped before texts are made, headers are read by few tasks, and its two lakes
are filled side by side."""

import threading

import pytest

import carelake.plans.q_streams as Q
import carelake.streaming.ingest as ingest

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def test_names_are_made_once_a_file(spark, monkeypatch):
    def put(files):
        raise Seen(files._jdf.queryExecution().optimizedPlan().toString(), files.select("path").distinct().count(), files.count())
    monkeypatch.setattr(Q, "put_files", put)
    with pytest.raises(Seen) as e:
        Q.q_ingest_every_upload(spark, SF)
    plan, paths, files = e.value.args
    assert paths == files > 0
    # what stands below an aggregate is done once a row of orders
    rows = [part.split("Project", 1)[-1] for part in plan.split("Aggregate") if "Relation" in part]
    assert rows and not any("date_format" in part for part in rows)


def test_headers_are_read_by_few_tasks(spark, tmp_path):
    paths = []
    for i in range(200):
        (tmp_path / f"{i}.csv").write_text(f"{'id' if i % 2 else 'key'},n\n{i},1\n")
        paths.append(f"file:{tmp_path}/{i}.csv")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    try:
        groups = ingest.csv_header_groups(spark, paths)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("headers") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= max(8, sc.defaultParallelism)
    assert sorted(len(g) for g in groups.values()) == [100, 100] and sorted(p for g in groups.values() for p in g) == sorted(paths)


def test_stream_and_backfill_run_side_by_side(spark, monkeypatch):
    met = threading.Barrier(2)

    def wait(*_):
        met.wait(timeout=20)
    monkeypatch.setattr(Q, "put_files", lambda files: None)
    monkeypatch.setattr(Q, "ingest_stream", wait)
    monkeypatch.setattr(Q, "backfill", wait)

    def read(*_):
        raise Seen("both are done")
    monkeypatch.setattr(Q, "read_current", read)
    with pytest.raises(Seen):
        Q.q_ingest_every_upload(spark, SF)
