"""Replacing uploads without a gap: versioned folders and committed pointers.

A batch writes its files' rows into folders of a version of its own, below each
root it needs, then commits with one pointer file in ``commits/``: a line per
file says which root and version hold its rows.  A file's latest line counts.  So

* a reader sees a file's old rows until the commit and its new ones after it;
* a batch that dies leaves folders that nothing points to, and is run again;
* nothing is overwritten, and no folder is looked at or deleted while writing.

``sweep`` deletes what no pointer needs any more, some time later.

    lake/csv/sig=../types=../version=../user_id=../year=../month=../_filename=../part-*
    lake/commits/000000000017-v5f..e1.json
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carelake.functions.text import named
from carelake.session import path_exists
from carelake.sinks.lake import FILE_PARTITIONS
from carelake.sources.lake import key_parts, read_lake
from carelake.sources.uploads import on_fs

#: ``root`` is below the lake; ``in_uploads``: the version's rows are in the ``uploads`` table too
ENTRY = "key string, format string, status string, root string, version string, in_uploads boolean"
# Characters that Spark escapes in the name of a partition's folder.
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def new_version() -> str:
    return f"v{uuid.uuid4().hex}"   # never read as a number


def write_version(df: DataFrame, root: str, version: str, partition_cols: Sequence[str] = FILE_PARTITIONS) -> int:
    """Add the rows to folder ``version=`` below ``root``, a folder per file; returns their number (a metric of the same job)."""
    obs = Observation("write_version")
    staged = df.observe(obs, F.count(F.lit(1)).alias("rows")).hint("rebalance", *partition_cols)
    staged.write.mode("append").partitionBy(*partition_cols).parquet(f"{root}/version={version}")
    return int(obs.get["rows"])


def commit(spark: SparkSession, lake_root: str, entries: Sequence[dict]) -> str | None:
    """Make one batch's files current: the pointer file appears whole, by a rename.  The number in its name orders
    commits; of two that race for a number the greater version counts."""
    if not entries:
        return None
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    folder = path(f"{lake_root}/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    last = max((int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(folder) if s.getPath().getName()[0].isdigit()), default=0)
    name = f"{last + 1:012d}-{entries[0]['version']}.json"
    staged = path(folder, f".{name}")
    out = fs.create(staged, True)
    out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
    out.close()
    if not fs.rename(staged, path(folder, name)):
        raise OSError(f"could not commit {name}")
    return name


def entries(spark: SparkSession, lake_root: str) -> DataFrame:
    """Every line of every commit, with ``seq`` (their order) and ``at`` (the time of the commit)."""
    if not path_exists(spark, f"{lake_root}/commits"):
        return spark.createDataFrame([], f"{ENTRY}, seq string, at timestamp")
    rows = spark.read.schema(ENTRY).json(f"{lake_root}/commits")
    return rows.select("*", F.col("_metadata.file_name").alias("seq"), F.col("_metadata.file_modification_time").alias("at"))


def current_files(spark: SparkSession, lake_root: str, uploads: bool = False) -> DataFrame:
    """(key, format, status, root, version, seq): each file's latest line (of those that fill the ``uploads`` table)."""
    rows = entries(spark, lake_root)
    if uploads:
        rows = rows.where("in_uploads")
    return rows.groupBy("key").agg(F.max_by(F.struct("format", "status", "root", "version", "seq"), "seq").alias("e")).select("key", "e.*")


def stale_files(spark: SparkSession, lake_root: str, uploads: bool = False) -> DataFrame:
    """Lines that a later commit has replaced, with ``replaced_at``, the time of the latest one."""
    rows = entries(spark, lake_root)
    if uploads:
        rows = rows.where("in_uploads")
    last = rows.groupBy("key").agg(F.max("seq").alias("last"), F.max_by("at", "seq").alias("replaced_at"))
    return rows.join(last, "key").where("seq < last")


def _file_columns(key: str = "key") -> list[Column]:
    return [part.alias(name) for name, part in key_parts(F.col(key)).items()]


def _visible(spark: SparkSession, data: DataFrame, lake_root: str, uploads: bool) -> DataFrame:
    """Rows of committed versions without the files that were replaced: both sides of the filter are as small as what
    was written since the last sweep, the rows are never shuffled for it."""
    committed = entries(spark, lake_root)
    committed = (committed.where("in_uploads") if uploads else committed).select("version").distinct()
    stale = stale_files(spark, lake_root, uploads).select("version", *_file_columns()).distinct()
    same = [F.coalesce(data[c], F.lit("")) == F.coalesce(stale[c], F.lit("")) for c in ("version", *FILE_PARTITIONS)]
    rows = data.join(stale, on=same, how="left_anti")
    return rows.join(committed, "version", "left_semi").select(*[named(c) for c in data.columns])


def read_current(spark: SparkSession, lake_root: str, kind: str) -> DataFrame:
    """The current rows of every file of a kind (csv, xlsx, placeholder), partition columns as text.

    Each root holds one header and one set of types, and is read with its own
    schema; columns that differ in type between roots become text, and those a
    root doesn't have are null.
    """
    roots = sorted(r[0] for r in current_files(spark, lake_root).where(F.col("root").startswith(kind)).select("root").distinct().collect())
    parts = []
    for root in roots:
        if not path_exists(spark, f"{lake_root}/{root}"):
            continue   # files without rows leave no folder
        df = read_lake(spark, f"{lake_root}/{root}")
        df = df.withColumns({k: F.lit(v) for k, _, v in (p.partition("=") for p in root.split("/")[1:])})
        parts.append(_visible(spark, df, lake_root, False))
    if not parts:
        return spark.createDataFrame([], "_source_key string, version string, user_id string, year string, month string, _filename string")
    types: dict[str, set] = {}
    for df in parts:
        for f in df.schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    parts = [df.select(*[named(c).cast("string").alias(c) if len(types[c]) > 1 else named(c) for c in df.columns]) for df in parts]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_current_uploads(spark: SparkSession, uploads_root: str, lake_root: str) -> DataFrame:
    """The current rows of the ``uploads`` table."""
    return _visible(spark, read_lake(spark, uploads_root), lake_root, True).drop("version")


def register_current_uploads(spark: SparkSession, uploads_root: str, lake_root: str, table: str = "uploads") -> DataFrame:
    """The same as a view that SQL can name."""
    df = read_current_uploads(spark, uploads_root, lake_root)
    df.createOrReplaceTempView(table)
    return df


def partition_folder(**parts: str) -> str:
    """The folder names that Spark gives to partition values."""
    def name(v: str | None) -> str:
        return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__"
    return "/".join(f"{k}={name(v)}" for k, v in parts.items())


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone = 0
        for row in b.to_pylist():
            folder = partition_folder(**{c: row[c] for c in ("version", *FILE_PARTITIONS)})
            fs, path, _ = on_fs(f"{row['base']}/{folder}")
            if fs.get_file_info(path).type.name == "Directory":
                fs.delete_dir(path)
                gone += 1
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], ["gone"])


def sweep(spark: SparkSession, lake_root: str, uploads_root: str | None = None, older_s: int = 86_400) -> int:
    """Delete the folders of files that were replaced more than ``older_s`` seconds ago (readers that began earlier are
    done by then) and versions that old that were never committed; returns the number of folders.  Tasks delete
    files' folders; the driver only looks at versions."""
    old = F.col("replaced_at") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(older_s))
    stale = stale_files(spark, lake_root).where(old)
    jobs = [stale.select(F.concat(F.lit(f"{lake_root}/"), "root").alias("base"), "version", *_file_columns())]
    if uploads_root:
        jobs.append(stale_files(spark, lake_root, True).where(old).select(F.lit(uploads_root).alias("base"), "version", *_file_columns()))
    gone = 0
    for rows in jobs:
        gone += rows.distinct().repartition("version", "_filename").mapInArrow(_delete, "gone long").agg(F.sum("gone")).first()[0] or 0
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path
    fs = pattern(lake_root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = {r[0] for r in entries(spark, lake_root).select("version").distinct().collect()}
    before = jvm.java.lang.System.currentTimeMillis() - older_s * 1000
    for glob in [f"{lake_root}/*/version=*", f"{lake_root}/*/*/*/version=*"] + ([f"{uploads_root}/version=*"] if uploads_root else []):
        for s in fs.globStatus(pattern(glob)) or []:
            if s.getPath().getName().partition("=")[2] not in known and s.getModificationTime() < before:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone
