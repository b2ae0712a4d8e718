"""Many small files are listed and read by few tasks, not by a task each or a task for every few of them."""

from __future__ import annotations

from carelake.sources.files import read_csv, read_text_docs


def _tasks_of_jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return out, max((s.numTasks for s in stages if s), default=0)


def test_csv_files_of_a_folder_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.csv").write_text(f"id,n\n{i},{i * 2}\n")
    df, most = _tasks_of_jobs(spark, "small-csv", lambda: read_csv(spark, str(tmp_path)))
    assert most <= 64
    assert sorted(map(tuple, df.collect())) == [(i, i * 2) for i in range(200)]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i}.txt").write_text(str(i))
    df = read_text_docs(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= 16   # with Spark's own cost of opening a file: 32
    assert sorted(int(r.text) for r in df.collect()) == list(range(1000))


def test_folders_of_many_small_files_are_written_by_several_tasks(spark, tmp_path):
    """Few bytes, but a folder a file: the rows of a version aren't left to one task."""
    import re

    from pyspark.sql import functions as F

    from carelake.sinks.versions import write_version
    name = F.concat(F.lit("f"), (F.col("id") % 64).cast("string"))
    rows = spark.range(8000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit("u").alias("user_id"), F.lit("2026").alias("year"),
                                      F.lit("06").alias("month"), name.alias("_filename"))
    assert write_version(rows, str(tmp_path), "v1") == 8000
    parts = {re.match(r"part-(\d+)", p.name)[1] for p in tmp_path.rglob("part-*")}
    assert len(parts) > 1


def test_documents_and_workbooks_are_built_without_a_frame_a_group(spark):
    from carelake.plans import q_sources as Q
    for files in (Q._docx_files(spark, "/root/testdata/sf0.001"), Q._xlsx_files(spark, "/root/testdata/sf0.001")):
        plan = files._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
