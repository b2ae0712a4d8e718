"""File listing, format dispatch, CSV/text scans and the non-tabular placeholder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.text import basename, extension, extension_or_name, make_valid_text, utc_minute_text
from carelake.sources.uploads import list_uploads, open_path  # noqa: F401

# Fixed value: text stored for a file that is not tabular.
PLACEHOLDER_TEXT = "[non-tabular file — text extraction done at query time]"

# Extensions the ingest job converts (case-insensitive).
TABULAR_EXTENSIONS = ("csv", "txt", "xlsx", "xls")

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_format(df: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Add ``ext`` and the ingest ``format`` (csv | xlsx | binary), plus the
    question-time ``text_format`` (sheets | pdf | docx | text)."""
    name = _c(name_col)
    ext = extension(name)
    qext = extension_or_name(name)
    return df.withColumns({
        "ext": ext,
        "format": (F.when(ext.isin("csv", "txt"), F.lit("csv"))
                    .when(ext.isin("xlsx", "xls"), F.lit("xlsx"))
                    .otherwise(F.lit("binary"))),
        "text_format": (F.when(qext.isin("xlsx", "xls"), F.lit("sheets"))
                         .when(qext == "pdf", F.lit("pdf"))
                         .when(qext == "docx", F.lit("docx"))
                         .otherwise(F.lit("text"))),
    })


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Metadata of every file below ``root``; ``content`` is never selected, so
    the scan reads no bytes (ReadSchema has no content column)."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(root)
            .select("path", "modificationTime", "length"))


def relative_key(path: Column, root: str) -> Column:
    """Object key relative to the bucket/root prefix."""
    prefix = root.rstrip("/") + "/"
    p = F.regexp_replace(path, "^file:(?=/)", "")
    p2 = F.regexp_replace(F.lit(prefix), "^file:(?=/)", "")
    return F.when(F.startswith(p, p2), F.substring(p, F.length(p2) + 1, 1 << 30)).otherwise(p)


def inventory(listing: DataFrame, key: str = "key", ts: str = "modificationTime",
              size: str = "length") -> DataFrame:
    """File listing record: key, name, size, minute-resolution UTC time,
    newest first (key ascending among equal minutes)."""
    return (listing.select(
                F.col(key).alias("key"),
                basename(F.col(key)).alias("name"),
                F.col(size).cast("long").alias("size"),
                utc_minute_text(F.col(ts)).alias("last_modified"))
            .orderBy(F.col("last_modified").desc(), F.col("key").asc()))


def file_inventory(spark: SparkSession, root: str, user_id: str | None = None) -> DataFrame:
    """All uploads below ``root`` (``root/uploads/...``), or one user's folder; hidden names and empty files count."""
    listing = list_uploads(spark, f"{root.rstrip('/')}/uploads", user_id or None)
    return inventory(listing.withColumn("key", relative_key(F.col("path"), root)))


def pending_files(listing: DataFrame, done: DataFrame, key: str = "key",
                  force: bool = False) -> DataFrame:
    """Tabular uploads that have no converted output yet (``force`` re-converts all)."""
    tab = listing.where(extension(basename(F.col(key))).isin(*TABULAR_EXTENSIONS))
    if force:
        return tab
    return tab.join(done.select(F.col(key)).distinct(), on=key, how="left_anti")


def read_csv(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType | None = None, recursive: bool = False) -> DataFrame:
    """Header row, inferred types (or a given schema); ``.txt`` is read as CSV."""
    reader = spark.read.option("header", "true").option("multiLine", "false").option("recursiveFileLookup", str(recursive).lower())
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    return reader.csv(list(paths) if not isinstance(paths, str) else paths)


def read_text_docs(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Whole files as UTF-8 text (malformed bytes replaced)."""
    df = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return df.select("path", make_valid_text(F.col("content")).alias("text"))


def placeholder_rows(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """One ``(filename, content)`` row per non-tabular file; no bytes read."""
    return files.select(F.col(name_col).alias("filename"), F.lit(PLACEHOLDER_TEXT).alias("content"))
