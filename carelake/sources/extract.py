"""Question-time text of any upload: the format is chosen by extension
(workbook -> sheet text, docx -> paragraphs, anything else -> UTF-8 text).

One pass over the files: a single Arrow-batch parser puts each parsed file's
text together in the task that holds the file, and lets plain bytes through.
``extract_lines`` gives the same as line rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.text import make_valid_text
from carelake.operators.context import SHEET_HEADER
from carelake.sources.docx import UNREADABLE_TEXT, paragraphs
from carelake.sources.xlsx import CHUNK_ROWS, UNREADABLE, workbook_rows

# Fixed value: text given for a file whose format cannot be extracted here.
UNSUPPORTED_TEXT = "[Could not extract text from this file type]"
NO_PARSER = ("pdf", "xls")

LINE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),        # sheet | row | para | text
    T.StructField("k1", T.LongType()),
    T.StructField("k2", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
])
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()),
                    ("cells", pa.list_(pa.string())), ("text", pa.string())])


def _ext(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1]


def _file_lines(path: str, data: bytes) -> Iterator[tuple]:
    """(kind, k1, k2, cells, text) of one workbook, document or unsupported file."""
    ext = _ext(path)
    if ext == "xlsx":
        seen = set()
        for idx, name, _active, rnum, cells, _hrow, _hdr in workbook_rows(data):
            if idx not in seen:
                seen.add(idx)
                yield "sheet", idx, -1, None, name
            yield "row", idx, rnum, cells, None
    elif ext == "docx":
        for i, t in enumerate(paragraphs(data)):
            yield "para", 0, i, None, t
    else:
        yield "text", 0, 0, None, UNSUPPORTED_TEXT


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path"), b.column("content")):
            path = path.as_py()
            try:
                rows = list(_file_lines(path, data.as_py() or b""))
            except UNREADABLE:
                rows = [("text", 0, 0, None, UNREADABLE_TEXT)]
            rows.insert(0, ("file", -1, -1, None, None))   # keeps files whose text is empty
            for i in range(0, len(rows), CHUNK_ROWS):
                part = [(path, *r) for r in rows[i:i + CHUNK_ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)


def _split(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of workbooks and documents, one row per plain text); a file without a path is plain text."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    parsed = F.coalesce(F.element_at(F.split(name, r"\."), -1).isin("xlsx", "docx", *NO_PARSER), F.lit(False))
    plain = files.where(~parsed).select(
        "path", F.lit("text").alias("kind"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        F.lit(None).cast("array<string>").alias("cells"), make_valid_text(F.coalesce("content", F.lit(b""))).alias("text"))
    return files.where(parsed).select("path", "content").mapInArrow(_lines, LINE_SCHEMA), plain


def extract_lines(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> one row per text line of each workbook or document;
    plain text stays in the JVM (one row per file, malformed bytes replaced)."""
    lines, plain = _split(files)
    return lines.unionByName(plain)


def _file_text(path: str, data: bytes) -> str:
    """The text of one workbook, document or unsupported file, put together where it is parsed."""
    lines = []
    for kind, _, _, cells, text in _file_lines(path, data):
        if kind == "sheet":
            lines.append(SHEET_HEADER % text)
        elif kind == "row":
            lines.append("\t".join(c or "" for c in cells))
        elif kind == "text" or text.strip():
            lines.append(text)
    return "\n".join(lines)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = b.column("path").to_pylist()
        parsed = [p is not None and _ext(p) in ("xlsx", "docx", *NO_PARSER) for p in paths]
        texts: list[str | None] = []
        for i, (path, mine) in enumerate(zip(paths, parsed)):
            try:
                texts.append(_file_text(path, b.column("content")[i].as_py() or b"") if mine else None)
            except UNREADABLE:
                texts.append(UNREADABLE_TEXT)
        raw = pc.if_else(pa.array(parsed, pa.bool_()), pa.scalar(None, pa.binary()), b.column("content").cast(pa.binary()).fill_null(b""))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), raw], ["path", "text", "raw"])


def extract_text(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> ``(path, text)``, a row per file.  Workbooks: a
    header line per sheet, rows tab-joined (null -> ''); documents: non-blank
    paragraphs; PDF and legacy ``.xls``: the unsupported-type text; damaged
    files: the unreadable text; anything else, also a file without a path:
    UTF-8 with malformed bytes replaced (plain bytes pass the parser by and are
    decoded in the JVM).  Files are read once and nothing is shuffled."""
    found = files.select("path", "content").mapInArrow(_texts, "path string, text string, raw binary")
    return found.select("path", F.coalesce("text", make_valid_text(F.col("raw"))).alias("text"))
