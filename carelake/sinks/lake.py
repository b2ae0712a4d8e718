"""Parquet lake writes (per-file overwrite) and the ``uploads`` catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carelake.functions.text import named
from carelake.sources.lake import LAKE_PARTITIONS, scan_position, with_row_index

UPLOADS_COLUMNS = "row_index BIGINT, content STRING, filename STRING, uploaded_at TIMESTAMP"
FILE_PARTITIONS = (*LAKE_PARTITIONS, "_filename")


def write_lake(df: DataFrame, root: str, partition_cols=FILE_PARTITIONS) -> int:
    """Write ``df`` below ``root`` partitioned by ``partition_cols`` and return
    the number of rows written.

    Dynamic partition overwrite: re-ingesting a file replaces only that file's
    folder.  The ``REBALANCE`` hint shuffles on the partition columns and lets
    AQE merge small folders into few tasks and split a hot folder (one upload
    holding a third of the rows) into several tasks/files.  The count is an
    observed metric of the same job (no second scan).
    """
    obs = Observation("write_lake")
    staged = df.observe(obs, F.count(F.lit(1)).alias("rows")).hint("rebalance", *partition_cols)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(root))
    return int(obs.get["rows"])


def to_uploads(df: DataFrame, uploaded_at=None, file_col: str = "_source_key") -> DataFrame:
    """Long form of ingested rows: one JSON ``content`` per row with its
    position in the file, the file name, upload time and partition keys.  The
    file is a partition too: writing one never replaces its neighbours."""
    data_cols = [c for c in df.columns if c not in (*LAKE_PARTITIONS, "_source_key", "_filename", "_blk", "_mid", "_modified")]
    ts = uploaded_at if uploaded_at is not None else F.current_timestamp()
    placed = df if {"_blk", "_mid"} <= set(df.columns) else df.withColumns(scan_position())
    # one text a row is numbered, so that no name of the helpers meets a column of the file
    rows = placed.select(F.to_json(F.struct(*[named(c) for c in data_cols])).alias("content"), ts.alias("_uploaded_at"),
                         *dict.fromkeys((file_col, *FILE_PARTITIONS, "_blk", "_mid")))
    numbered = with_row_index(rows, file_col=file_col)
    return numbered.select(
        "row_index", "content", F.col("_filename").alias("filename"),
        F.col("_uploaded_at").cast("timestamp").alias("uploaded_at"), *FILE_PARTITIONS)


def register_uploads(spark: SparkSession, root: str, table: str = "uploads") -> DataFrame:
    """Catalog table over the long-form folder; partitions are discovered with
    ``MSCK REPAIR TABLE`` (rows are invisible before it)."""
    quoted = root.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({UPLOADS_COLUMNS}, user_id STRING, year STRING, month STRING, _filename STRING) "
              f"USING parquet PARTITIONED BY (user_id, year, month, _filename) LOCATION '{quoted}'")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)
