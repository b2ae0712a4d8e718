"""WARC archives: writer, monolithic-gzip normaliser with sidecar offset index, indexed reader.

Many archives are compressed as one gzip stream, so no record can be reached
without inflating all before it.  The normaliser inflates such a stream once,
writes every record as a gzip member of its own and, beside the archive, an
index of the members' offsets; readers then seek to any record.

Archives live in a folder that driver and executors share.  File names are
unique for each attempt and only the manifest of finished tasks is used, so a
lost executor costs a repeated task and leaves at most a file nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import cut

CHUNK = 1 << 20
ROLL = 256 << 20     # payload bytes after which a task begins another archive
HEAD = 600           # bytes that a record's headers count as
LEVEL = 6
LEAST_REVISIT = 1000  # payload bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2025-01-01T00:00:00Z"
_SPACE = uuid.UUID("5f0c7f5e-0d3c-4d1a-9b0a-6f1f6b1f4a11")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(old, new, 1)
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    """The same for the same page in every run."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, str(page_id) if page_id is not None else f'{digest} {url}')}"


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or (payload null) a revisit record of ``refers_to``."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(page_id, digest, url)}>"), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(size)),
            ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", json.dumps(url)[1:-1]))  # no line break can get into a header
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest, None)}>"), ("X-Refers-To-Page-Id", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to); payload is null for a revisit.

    Null html is an empty payload.  Of payloads of one digest and size, of at
    least ``LEAST_REVISIT`` bytes, the largest page_id responds and rows with
    another id (or none) revisit it; a repeated row of that id responds as
    well.  Only groups of two ids or more are joined back, by broadcast while they
    are few, so payloads are usually not shuffled; else by a join that Spark
    splits where a group is hot.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", body.alias("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    groups = (p.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size")
              .agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("_least"), F.count("*").alias("_n"), F.count("page_id").alias("_ids"))
              .where("keeper is not null and (_least < keeper or _ids < _n)").select("digest", "size", "keeper"))
    groups = cut(groups)
    p = p.join(F.broadcast(groups) if groups.count() <= 500_000 else groups, ["digest", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return p.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_monoliths(records: DataFrame, folder: str, level: int = LEVEL, roll: int = ROLL) -> DataFrame:
    """Write ``payloads`` rows as archives of one gzip stream each; -> manifest (archive, records)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        done, out, gz, held, count = [], None, None, 0, 0

        def finish():
            nonlocal out
            out.write(gz.flush())
            out.close()
            done.append((name, count))
            out = None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, size, digest, refers = (batch.column(c)[i].as_py() for c in range(6))
                if out is None:
                    name, gz, held, count = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                out.write(gz.compress(make_record(page_id, url, payload, size, digest, refers)))
                held, count = held + size + HEAD, count + 1
                if held >= roll:
                    finish()
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["archive", "records"])
    return cut(records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "archive string, records long"))


class Inflater:
    """Bytes of a gzip stream of one or many members, read once, a bounded buffer at a time."""

    def __init__(self, stream):
        self.stream, self.buffer = stream, bytearray()
        self.z, self.tail, self.open = zlib.decompressobj(31), b"", False  # open: within a member

    def fill(self) -> bool:
        while True:
            data = self.tail or self.stream.read(CHUNK)
            if not data and not self.open:
                return False
            self.open = True
            got = self.z.decompress(data, CHUNK)
            if self.z.eof:
                self.tail, self.z, self.open = self.z.unused_data, zlib.decompressobj(31), False
            else:
                self.tail = self.z.unconsumed_tail
                if not data and not got:
                    raise ValueError("the gzip stream is cut off")
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("a record is cut off")
                return None
        got = bytes(self.buffer[:at + len(mark)])
        del self.buffer[:at + len(mark)]
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("a record is cut off")
            got = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(got)
            yield got


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every archive of ``manifest`` member by member; -> (archive, index, records).

    The index beside an archive has a JSON line for each record: offset, length
    of the member, type, id, uri.  Memory is bounded by a buffer, not by a record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                fs, path = open_fs(source)
                to, top = open_fs(folder)
                to.create_dir(top, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(path, compression=None) as f, to.open_output_stream(f"{top}/{name}", compression=None) as out, \
                        to.open_output_stream(f"{top}/{name}.idx", compression=None) as index:
                    stream, offset, count = Inflater(f), 0, 0
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        fields = parse_head(head)
                        gz, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        for piece in chain([head], stream.exactly(int(fields["content-length"]) + 4), [None]):
                            z = gz.flush() if piece is None else gz.compress(piece)
                            out.write(z)
                            length += len(z)
                        line = {"offset": offset, "length": length, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + length, count + 1
                rows.append((f"{folder}/{name}", f"{folder}/{name}.idx", count))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                                             ["archive", "index", "records"])
    return cut(manifest.select("archive").mapInArrow(run, "archive string, index string, records long"))


def read_record(record: bytes, where: str) -> tuple[int | None, str | None, str, int, str, int | None]:
    """(page_id, url, type, payload bytes, payload digest, refers_to) of one record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block, kind, url = block[:int(fields["content-length"])], fields.get("warc-type", "unknown"), fields.get("warc-target-uri")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if "x-payload-length" not in fields:
        return None, url, kind, size, digest, None
    given = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (size != int(fields["x-payload-length"]) or digest != given):
        raise ValueError(f"{where}: the payload doesn't match its digest")
    page, refers = (int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id"))
    return page, None if url is None else json.loads(f'"{url}"'), kind, int(fields["x-payload-length"]), given, refers


def read_records(archives: DataFrame) -> DataFrame:
    """Every record by its place in the index: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, archive, offset, length).

    A response's payload is digested again and must match the header of an
    archive written here.  Records from elsewhere (warcinfo, request, ..; other digests or
    none) have no page_id, and the size and SHA-1 of the payload they hold: the
    body of an HTTP message, else the whole block.
    """
    schema = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
              "archive string, offset long, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = open_fs(archive)
                with fs.open_input_stream(open_fs(index)[1], compression=None) as x, fs.open_input_file(path) as f:
                    lines = io.BufferedReader(x)
                    while part := list(islice(lines, 2000)):
                        rows = []
                        for line in part:
                            place = json.loads(line)
                            record = zlib.decompress(f.read_at(place["length"], place["offset"]), 31)
                            rows.append((*read_record(record, f"{archive} at {place['offset']}"), archive, place["offset"], place["length"]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return archives.select("archive", "index").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write, normalise and read back; the monolithic archives go once the normalised ones are complete."""
    manifest = write_monoliths(payloads(pages), f"{folder}/monolith")
    archives = normalise(manifest, f"{folder}/records")
    fs, path = open_fs(f"{folder}/monolith")
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
    return read_records(archives)
