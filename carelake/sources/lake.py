"""The partitioned Parquet lake and the provenance columns of ingested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.text import basename
from carelake.operators.scan import prefix_sum

LAKE_PARTITIONS = ("user_id", "year", "month")


def key_parts(key: Column) -> dict[str, Column]:
    """user_id / year / month (strings, leading zeros kept) and file name of a key."""
    return {
        "user_id": F.regexp_extract(key, r"(?:^|/)user_id=([^/]*)", 1),
        "year": F.regexp_extract(key, r"(?:^|/)year=([^/]*)", 1),
        "month": F.regexp_extract(key, r"(?:^|/)month=([^/]*)", 1),
        "_filename": basename(key),
    }


def source_key(path: Column, root: str | None = None, encoded: bool = True) -> Column:
    """Object key of a scanned file: the path below ``root`` (or from
    ``uploads/`` on when no root is given).  A scan's ``_metadata.file_path``
    is URI-encoded and is decoded; the path of a listing isn't (``encoded=False``)."""
    raw = F.regexp_replace(path, "^file:(//(?=/))?", "")
    # Only %XX escapes are decoded: a literal "+" stays "+", a stray "%" keeps the raw path.
    p = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw) if encoded else raw
    if root:
        r = root.replace("file://", "").replace("file:", "").rstrip("/") + "/"
        return F.when(F.startswith(p, F.lit(r)), F.substring(p, len(r) + 1, 1 << 30)).otherwise(p)
    found = F.regexp_extract(p, r"(uploads/.*)$", 1)
    return F.when(found != "", found).otherwise(p)


def with_provenance(df: DataFrame, root: str | None = None) -> DataFrame:
    """``_source_key`` and ``_filename`` from the scan's file metadata
    (overwriting same-named input columns)."""
    key = source_key(F.col("_metadata.file_path"), root)
    return df.withColumns({"_source_key": key, "_filename": basename(key)})


def scan_position() -> dict[str, Column]:
    """Columns of a scan that order a file's rows (split start, scan order), for ``with_row_index``."""
    return {"_blk": F.col("_metadata.file_block_start"), "_mid": F.monotonically_increasing_id()}


def with_row_index(df: DataFrame, file_col: str = "_source_key", out: str = "row_index") -> DataFrame:
    """1-based position of each row inside its file, in file order.

    ``df`` is a scan, or rows written with ``scan_position`` at the scan.  The running count is
    bucketed by split, so one enormous file is numbered by many tasks.
    """
    staged = df if {"_blk", "_mid"} <= set(df.columns) else df.withColumns(scan_position())
    numbered = prefix_sum(staged.withColumn("_one", F.lit(1)), [file_col], ["_blk", "_mid"], "_blk", "_one", out, inclusive=True)
    return numbered.withColumn(out, F.col(out).cast("long")).drop("_blk", "_mid", "_one")


def read_lake(spark: SparkSession, root: str, data_schema: T.StructType | None = None) -> DataFrame:
    """Read the lake with ``user_id/year/month`` (and ``_filename``) kept as
    strings.  With a data schema the partition types come from it; without
    one, partition type inference is switched off for this read only."""
    parts = [T.StructField(c, T.StringType()) for c in (*LAKE_PARTITIONS, "_filename")]
    if data_schema is not None:
        schema = T.StructType([f for f in data_schema.fields if f.name not in {p.name for p in parts}] + parts)
        return spark.read.schema(schema).parquet(root)
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        df = spark.read.parquet(root)
        df.schema  # resolve the file index while inference is off
    finally:
        spark.conf.set(key, old)
    return df
