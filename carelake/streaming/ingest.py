"""Upload ingest, as a stream and as a batch: every new tabular upload is
converted into the lake once, with its rows, provenance and, if wanted, its
rows in the ``uploads`` table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions.text import basename, named
from carelake.session import checkpoint_root, scratch_dir
from carelake.sinks.lake import FILE_PARTITIONS, to_uploads
from carelake.sinks.versions import commit, current_files, new_version, write_version
from carelake.sources.files import PLACEHOLDER_TEXT, TABULAR_EXTENSIONS, pending_files, with_format
from carelake.sources.lake import key_parts, scan_position, source_key
from carelake.sources.typed_csv import read_csv_once
from carelake.sources.typed_xlsx import read_sheets_once, signature
from carelake.sources.uploads import is_hidden, list_uploads, open_path, stream_uploads

MAX_FILES_PER_TRIGGER = 1000
CHUNKS_AT_ONCE = 4     # chunks of a batch that are converted side by side
STAGED = "hidden-uploads"
HEADER_PIECE = 1 << 16
HEADERS_A_TASK = 64    # files whose headers one task reads
#: what Spark's CSV reader trims from a line to see whether it is blank (fixed values)
BLANK = bytes(range(0x21))


def header_signature(stream) -> str | None:
    """Hash of the first line that isn't blank, wherever it begins and however long it is; None without one."""
    seen, blank = hashlib.sha256(), True
    while data := stream.read(HEADER_PIECE):
        if blank:
            rest = data.lstrip(BLANK)
            lead = data[:len(data) - len(rest)]
            line = max(lead.rfind(b"\n"), lead.rfind(b"\r")) + 1
            if line:
                seen = hashlib.sha256()
            seen.update(lead[line:])
            data, blank = rest, not rest
        if not blank:
            ends = [i for i in (data.find(b"\n"), data.find(b"\r")) if i >= 0]
            seen.update(data[:min(ends, default=len(data))])
            if ends:
                break
    return None if blank else seen.hexdigest()[:16]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for path in b.column("path").to_pylist():
            fs, name = open_path(path)
            with fs.open_input_stream(name, compression=None) as f:
                found.append(header_signature(f))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.string())], ["path", "sig"])


def csv_header_groups(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files grouped by their header line, so each group is read with one
    consistent schema (files with another header are never mixed in).  Tasks read the beginning
    of each file, up to its header; a file without any text is in no group."""
    groups: dict[str, list[str]] = {}
    if paths:
        rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(-(-len(paths) // HEADERS_A_TASK))
        for r in rows.mapInArrow(_signatures, "path string, sig string").collect():
            if r.sig is not None:
                groups.setdefault(r.sig, []).append(r.path)
    return {sig: sorted(group) for sig, group in sorted(groups.items())}


class Batch:
    """One version of some files: where their rows went, committed together."""

    def __init__(self, spark: SparkSession, upload_root: str, lake_root: str, uploads_root: str | None):
        self.spark, self.upload_root, self.lake_root, self.uploads_root = spark, upload_root, lake_root, uploads_root
        self.version, self.written, self.root_of = new_version(), 0, {}

    def key(self, path, encoded: bool = False):
        return _key(path, self.upload_root, encoded)

    def placed(self, rows: DataFrame, encoded: bool = False) -> DataFrame:
        """Rows with their file's key in place of its path (``_source_key``), and the key's parts.  The key is derived once a
        file, not once a row; the driver gets the batch's paths."""
        files = rows.select("_source_key").distinct().withColumn("_key", self.key(F.col("_source_key"), encoded))
        files = files.select("_source_key", F.struct(F.col("_key").alias("key"), *[c.alias(n) for n, c in key_parts(F.col("_key")).items()]).alias("_filename"))
        joined = rows.join(F.broadcast(self.spark.createDataFrame(files.toArrow())), "_source_key")
        return joined.select(*[F.col("_filename.key").alias(c) if c == "_source_key" else named(c) for c in rows.columns],
                             *[F.col(f"_filename.{c}").alias(c) for c in FILE_PARTITIONS])

    def write(self, rows: DataFrame, root: str, paths: list[str], long: DataFrame | None = None) -> None:
        """``rows`` of the files ``paths`` below ``root`` of the lake; ``long``: the same in the ``uploads`` form.
        Files without rows leave no folder."""
        self.root_of.update(dict.fromkeys(paths, root))
        if rows.isEmpty():
            return
        self.written += write_version(rows, f"{self.lake_root}/{root}", self.version)
        if self.uploads_root and long is not None:
            write_version(long, self.uploads_root, self.version)

    def csv(self, paths: list[str]) -> None:
        """Header and inferred types; the files of a header signature are read once, and their types, lake rows and
        ``uploads`` rows all come from that read."""
        for sig, group in csv_header_groups(self.spark, paths).items():
            keep = {"_source_key": F.col("_metadata.file_path")}
            if self.uploads_root:
                keep |= {"_modified": F.col("_metadata.file_modification_time"), **scan_position()}
            with read_csv_once(self.spark, group, keep, [*FILE_PARTITIONS, "_modified", "_blk", "_mid"]) as (df, names):
                # One root per (header, inferred types): a later batch that infers other
                # types for the same header never mixes conflicting Parquet files.
                types = hashlib.sha256(df.select(*[named(n) for n in names]).schema.simpleString().encode()).hexdigest()[:8]
                df = self.placed(df, encoded=True)
                long = to_uploads(df, uploaded_at=F.col("_modified")) if self.uploads_root else None
                self.write(df.drop("_modified", "_blk", "_mid"), f"csv/sig={sig}/types={types}", group, long)

    def xlsx(self, paths: list[str]) -> None:
        """First sheet of each workbook, first row as header, types from the cells; one wide root per header
        and types.  Each workbook is parsed once.  Only one header row per file reaches the driver."""
        if not paths:
            return
        with read_sheets_once(self.spark, paths, ["_source_key", *FILE_PARTITIONS]) as groups:
            for g in groups:
                own = [named(n) for n in g.names]
                types = signature([f.dataType.simpleString() for f in g.rows.select(*own).schema])[:8]
                rows = self.placed(g.rows.withColumn("_source_key", F.col("_path")))
                long = _long(rows, F.col("_row"), F.to_json(F.struct(*own)))
                self.write(rows.drop("_path", "_row"), f"xlsx/sig={signature(g.names)}/types={types}", g.paths, long)

    def placeholders(self, files: list) -> None:
        if not files:
            return
        ph = self.spark.createDataFrame([(r.file_name, r._source_key) for r in files], "filename string, _source_key string")
        parts = key_parts(F.col("_source_key"))
        ph = ph.select("filename", F.lit(PLACEHOLDER_TEXT).alias("content"), "_source_key", *[parts[k].alias(k) for k in FILE_PARTITIONS])
        self.write(ph, "placeholder", [r.path for r in files], _long(ph, F.lit(1), F.to_json(F.struct("filename", "content"))))


def _long(rows: DataFrame, row_index, content) -> DataFrame:
    """Rows that carry their file's key parts, in the ``uploads`` form."""
    return rows.select(row_index.cast("long").alias("row_index"), content.alias("content"), F.col("_filename").alias("filename"),
                       F.current_timestamp().alias("uploaded_at"), *FILE_PARTITIONS)


def _key(path, upload_root: str, encoded: bool = False):
    """The object key of an upload, also where a staged copy of it is read."""
    key = source_key(path, upload_root, encoded)
    staged = F.regexp_extract(key, f"/{STAGED}-[0-9a-f]+/(.*)$", 1)
    return F.when(staged != "", F.regexp_replace(staged, "(^|/)u([^/]*)$", "$1$2")).otherwise(key)


def _copy_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for source, target in zip(b.column("source").to_pylist(), b.column("path").to_pylist()):
            (a, src), (z, dst) = open_path(source), open_path(target)
            z.create_dir(dst.rsplit("/", 1)[0], recursive=True)
            with a.open_input_stream(src, compression=None) as i, z.open_output_stream(dst, compression=None) as o:
                while data := i.read(1 << 20):
                    o.write(data)
        yield b.select(["path", "key"])


def stage_hidden(spark: SparkSession, hidden: DataFrame) -> DataFrame:
    """(path, key) of copies that Spark's readers see, below the shared scratch
    folder; the executors copy the files."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, STAGED))
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    target = F.concat(F.lit(root + "/"), F.regexp_replace("key", "(^|/)([^/]+)$", "$1u$2"))
    checkpoint_root(spark)
    return (hidden.select(F.col("path").alias("source"), target.alias("path"), "key").repartition("source")
            .mapInArrow(_copy_files, "path string, key string").checkpoint())


def convert_batch(spark: SparkSession, batch: DataFrame, upload_root: str, lake_root: str,
                  uploads_root: str | None = None) -> int:
    """Convert the files of one batch (``path``) and commit them together.

    CSV/TXT uploads and the first sheets of workbooks are read with header and
    inferred types; other files, files without a header and workbooks that can't be read
    get a placeholder row.  With ``uploads_root`` the rows also go to the
    ``uploads`` table's folder.  What a file had before counts until the commit.
    Only the batch's file list (bounded by the chunk size) reaches the driver.
    Returns the rows written.
    """
    files = (with_format(batch.select("path")
                         .withColumn("_source_key", _key(F.col("path"), upload_root))
                         .withColumn("file_name", F.element_at(F.split("_source_key", "/"), -1)), "file_name")
             .select("path", "format", "_source_key", "file_name").collect())
    b = Batch(spark, upload_root, lake_root, uploads_root)
    b.csv([r.path for r in files if r.format == "csv"])
    b.xlsx([r.path for r in files if r.format == "xlsx"])
    converted = set(b.root_of)
    b.placeholders([r for r in files if r.path not in converted])
    commit(spark, lake_root, [{"key": r._source_key, "format": r.format, "status": "converted" if r.path in converted else "placeholder",
                               "root": b.root_of[r.path], "version": b.version, "in_uploads": uploads_root is not None} for r in files])
    return b.written


def convert_files(spark: SparkSession, files: DataFrame, upload_root: str, lake_root: str, uploads_root: str | None = None,
                  chunk_files: int = MAX_FILES_PER_TRIGGER) -> int:
    """Convert any number of uploads (``path``): hidden ones from copies that Spark's readers see, in chunks of about
    ``chunk_files`` files, some of them side by side, each with a commit of its own.  Returns the rows written."""
    checkpoint_root(spark)
    todo = files.select("path", source_key(F.col("path"), upload_root, encoded=False).alias("key")).checkpoint()
    hidden = is_hidden(basename(F.col("key")))
    if not todo.where(hidden).isEmpty():
        todo = todo.where(~hidden).unionByName(stage_hidden(spark, todo.where(hidden)))
    n_files = todo.count()
    chunks = -(-n_files // chunk_files)
    todo = todo.withColumn("_chunk", F.pmod(F.xxhash64("key"), F.lit(max(1, chunks))))

    def one(c: int) -> int:
        return convert_batch(spark, todo.where(F.col("_chunk") == c).select("path"), upload_root, lake_root, uploads_root)
    if chunks <= 1:
        return one(0) if chunks else 0
    with ThreadPoolExecutor(CHUNKS_AT_ONCE) as pool:
        return sum(pool.map(inheritable_thread_target(spark)(one), range(chunks)))


def ingest_stream(spark: SparkSession, upload_root: str, lake_root: str, checkpoint: str, max_files: int = MAX_FILES_PER_TRIGGER,
                  uploads_root: str | None = None):
    """Convert every tabular upload that is new or has changed since the last run (``availableNow``), as the backfill
    would; returns the finished query.  Its source's log lies beside the checkpoint.  After a batch that died, a run
    repeats that one and a second run takes what has come since."""
    def convert(files: DataFrame, _id: int) -> None:
        name = F.lower(F.element_at(F.split("path", "/"), -1))
        tabular = files.where(F.element_at(F.split(name, r"\."), -1).isin(*TABULAR_EXTENSIONS) & name.contains("."))
        convert_files(spark, tabular, upload_root, lake_root, uploads_root, max_files)
    for _ in range(2 if unfinished(spark, checkpoint) else 1):
        src = stream_uploads(spark, upload_root, f"{checkpoint}-files", max_files=max_files)
        q = src.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def unfinished(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the stream has a batch that was begun and not committed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(checkpoint).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(folder: str) -> int:
        found = fs.globStatus(path(f"{checkpoint}/{folder}/[0-9]*")) or []
        return max((int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit()), default=-1)
    return last("offsets") > last("commits")


def converted_keys(spark: SparkSession, lake_root: str) -> DataFrame:
    """Source keys that have been converted (empty when nothing is there), however many rows a file gave."""
    return current_files(spark, lake_root).select("key")


def convert_key(spark: SparkSession, key: str, upload_root: str, lake_root: str, uploads_root: str | None = None) -> int:
    """Convert one upload, given by its key below ``upload_root``, again if it has been converted before."""
    path = spark.createDataFrame([(f"{upload_root.rstrip('/')}/{key}",)], "path string")
    return convert_files(spark, path, upload_root, lake_root, uploads_root)


def backfill(spark: SparkSession, upload_root: str, lake_root: str, force: bool = False,
             chunk_files: int = MAX_FILES_PER_TRIGGER, uploads_root: str | None = None) -> int:
    """Batch conversion of every tabular upload that has no lake output yet (``force``: of all).

    Listing by tasks (hidden names and empty files too) -> anti-join with the
    keys already in the lake -> conversion in chunks.  Returns the rows written.
    """
    listing = list_uploads(spark, upload_root).withColumn("key", source_key(F.col("path"), upload_root, encoded=False))
    todo = pending_files(listing, converted_keys(spark, lake_root), key="key", force=force)
    return convert_files(spark, todo, upload_root, lake_root, uploads_root, chunk_files)
