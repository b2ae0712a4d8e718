"""File source over the uploads folder (Spark's Python Data Source API), batch and stream.

Spark's own file sources skip names that begin with ``_`` or ``.`` and files
without bytes; an upload called ``(1).csv`` is stored as ``_1_.csv``.  This
source lists ``user_id=/year=/month=`` folders itself, one task per group of user
folders, and gives every file below them: metadata, and with ``content=true``
its bytes.

    spark.read.format("uploads").option("root", path).load()
    spark.readStream.format("uploads").option("root", path).option("log", log).load()

The stream keeps a log beside its checkpoint: entry n names the files that
were new when it was written, and an offset is a number of entries.  A file is new if no
entry has its path, time and size, so neither late files nor re-uploads
are missed, whatever their times are.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "uploads"
LISTING = "path string, modificationTime timestamp, length long"
USERS_A_TASK = 16    # user folders listed by one task
FILES_A_TASK = 64    # files of a stream's entry read by one task
BATCH_BYTES = 16 << 20
LISTERS = 16         # threads of the stream's own listing
FOLDERS = ("user_id=", "year=", "month=")


def open_path(path: str):
    """(file system, path on it) of a full path, for tasks that open files themselves."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest or "/" in scheme:
        local = rest if scheme == "file" else path
        return pafs.LocalFileSystem(), "/" + local.lstrip("/")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    host, _, name = rest.lstrip("/").partition("/")
    fs, base = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    return fs, f"{base.rstrip('/')}/{name}"


def on_fs(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path on it, what stands before such a path in a full one)."""
    fs, name = open_path(path)
    scheme, _, rest = path.partition(":")
    if isinstance(fs, pafs.LocalFileSystem):
        return fs, name.rstrip("/"), "file:"
    host = rest.lstrip("/").partition("/")[0]
    # stores of objects have the bucket in their paths, file systems have not
    return fs, name.rstrip("/"), f"{scheme}://" + ("" if name.startswith(host) else host)


@dataclass
class Found:
    path: str      # on the file system
    micros: int    # time of the last change, since the epoch
    length: int

    @property
    def key(self) -> bytes:
        return hashlib.blake2b(f"{self.path}\x00{self.micros}\x00{self.length}".encode(), digest_size=16).digest()


def children(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


def user_folders(fs: pafs.FileSystem, root: str, user_id: str | None = None) -> list[str]:
    if user_id is not None:
        return [f"{root}/{FOLDERS[0]}{user_id}"]
    return sorted(i.path for i in children(fs, root) if i.type == pafs.FileType.Directory and i.base_name.startswith(FOLDERS[0]))


def files_below(fs: pafs.FileSystem, folder: str, depth: int = 1) -> Iterator[Found]:
    """The uploads of a user's folder: files of its ``year=/month=`` folders, whatever their names."""
    for i in sorted(children(fs, folder), key=lambda i: i.path):
        if depth < len(FOLDERS):
            if i.type == pafs.FileType.Directory and i.base_name.startswith(FOLDERS[depth]):
                yield from files_below(fs, i.path, depth + 1)
        elif i.type == pafs.FileType.File:
            yield Found(i.path, (i.mtime_ns or 0) // 1000, i.size)


def _batches(fs: pafs.FileSystem, before: str, files: Iterator[Found], content: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the files, a bounded number of bytes at a time."""
    schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())]
                       + [("content", pa.binary())] * content)
    rows: list[list] = [[] for _ in schema]
    held = 0

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
        for c in rows:
            c.clear()
        return batch
    for f in files:
        values = [before + f.path, f.micros, f.length]
        if content:
            with fs.open_input_stream(f.path, compression=None) as s:
                values.append(s.read())
        for c, v in zip(rows, values):
            c.append(v)
        held += 100 + (f.length if content else 0)
        if held >= BATCH_BYTES:
            yield flush()
            held = 0
    if rows[0]:
        yield flush()


class Folders(InputPartition):
    def __init__(self, folders: list[str]):
        super().__init__(0)
        self.folders = folders


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(0)
        self.files = files


class UploadsReader(DataSourceReader):
    def __init__(self, root: str, user_id: str | None, content: bool):
        self.root, self.user_id, self.content = root, user_id, content

    def partitions(self) -> list[Folders]:
        fs, root, _ = on_fs(self.root)
        users = user_folders(fs, root, self.user_id)
        return [Folders(users[i:i + USERS_A_TASK]) for i in range(0, len(users), USERS_A_TASK)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, _, before = on_fs(self.root)
        return _batches(fs, before, (f for u in partition.folders for f in files_below(fs, u)), self.content)


class UploadsStream(DataSourceStreamReader):
    """Offsets are numbers of log entries; entry n is the file ``n.json`` of the log folder, written once."""

    def __init__(self, root: str, user_id: str | None, content: bool, log: str, files_an_entry: int):
        self.root, self.user_id, self.content = root, user_id, content
        self.log, self.files_an_entry = log, files_an_entry
        self.seen: set[bytes] = set()  # 16 bytes a file; the driver's Python process holds them
        self.read_entries = 0

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        """Everything that is there now; new files are entered in the log first."""
        fs, log, _ = on_fs(self.log)
        while self._exists(fs, log, self.read_entries):
            self.seen.update(f.key for f in self._entry(fs, log, self.read_entries))
            self.read_entries += 1
        new = [f for f in self._list() if f.key not in self.seen]
        for at in range(0, len(new), self.files_an_entry):
            part = new[at:at + self.files_an_entry]
            fs.create_dir(log, recursive=True)
            whole = f"{log}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(whole, compression=None) as out:
                out.write("\n".join(json.dumps([f.path, f.micros, f.length]) for f in part).encode())
            fs.move(whole, f"{log}/{self.read_entries}.json")  # an entry is there as a whole or not at all
            self.seen.update(f.key for f in part)
            self.read_entries += 1
        return {"entries": self.read_entries}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        fs, log, _ = on_fs(self.log)
        out = []
        for n in range(start["entries"], end["entries"]):
            files = [(f.path, f.micros, f.length) for f in self._entry(fs, log, n)]
            out += [Files(files[i:i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _, before = on_fs(self.root)
        return _batches(fs, before, (Found(*f) for f in partition.files), self.content)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the log says which files have been seen."""

    def _list(self) -> list[Found]:
        fs, root, _ = on_fs(self.root)
        with ThreadPoolExecutor(LISTERS) as pool:
            return [f for found in pool.map(lambda u: list(files_below(fs, u)), user_folders(fs, root, self.user_id)) for f in found]

    @staticmethod
    def _exists(fs: pafs.FileSystem, log: str, n: int) -> bool:
        return fs.get_file_info(f"{log}/{n}.json").type == pafs.FileType.File

    @staticmethod
    def _entry(fs: pafs.FileSystem, log: str, n: int) -> list[Found]:
        with fs.open_input_stream(f"{log}/{n}.json", compression=None) as f:
            return [Found(*json.loads(line)) for line in f.read().splitlines()]


class UploadsSource(DataSource):
    """Options: ``root`` (the folder of ``user_id=`` folders), ``user_id`` (one user's uploads), ``content`` (true: the
    bytes too), and for a stream ``log`` (a folder) and ``maxFilesPerEntry``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTING + (", content binary" if self._content() else "")

    def _content(self) -> bool:
        return str(self.options.get("content", "false")).lower() == "true"

    def _common(self) -> tuple[str, str | None, bool]:
        if not self.options.get("root"):
            raise ValueError("option root names the uploads folder")
        return self.options["root"], self.options.get("user_id"), self._content()

    def reader(self, schema) -> UploadsReader:
        return UploadsReader(*self._common())

    def streamReader(self, schema) -> UploadsStream:
        if not self.options.get("log"):
            raise ValueError("option log names the folder of the stream's log")
        return UploadsStream(*self._common(), self.options["log"], int(self.options.get("maxFilesPerEntry", 1000)))


def register_source(spark: SparkSession) -> None:
    """The source is sent as code, for processes that don't have this package (its only imports are the libraries')."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(UploadsSource)


def list_uploads(spark: SparkSession, root: str, user_id: str | None = None, content: bool = False) -> DataFrame:
    """Every upload below ``root`` (``user_id=/year=/month=`` folders), hidden and empty ones too: path, modificationTime,
    length, and with ``content`` the bytes."""
    register_source(spark)
    reader = spark.read.format(NAME).option("root", root).option("content", str(content).lower())
    if user_id is not None:
        reader = reader.option("user_id", user_id)
    return reader.load()


def stream_uploads(spark: SparkSession, root: str, log: str, content: bool = False, max_files: int = 1000) -> DataFrame:
    """The same rows as a stream; ``log`` belongs to one stream, as its checkpoint does."""
    register_source(spark)
    return (spark.readStream.format(NAME).option("root", root).option("log", log).option("content", str(content).lower())
            .option("maxFilesPerEntry", max_files).load())


def is_hidden(name: Column) -> Column:
    """Names that Spark's own file sources skip."""
    return name.rlike("^[_.]")
