"""DOCX paragraphs, parsed in Arrow batches on the executors (stdlib only)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.text import pystrip
from carelake.sources.xlsx import CHUNK_ROWS, UNREADABLE

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARA_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("para_idx", T.LongType()),
    T.StructField("text", T.StringType()),
])


def paragraphs(data: bytes) -> list[str]:
    """Text of each top-level body paragraph (runs concatenated; tabs and
    breaks as ``\\t`` / ``\\n``).  Paragraphs inside tables are not body
    paragraphs and are not included."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{{{_W}}}body")
    out = []
    for p in (body.findall(f"{{{_W}}}p") if body is not None else []):
        parts = []
        for el in p.iter():
            if el.tag == f"{{{_W}}}t":
                parts.append(el.text or "")
            elif el.tag == f"{{{_W}}}tab":
                parts.append("\t")
            elif el.tag in (f"{{{_W}}}br", f"{{{_W}}}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return out


#: fixed value: the answer for a file that can't be read
UNREADABLE_TEXT = "[Could not read this file]"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path"), b.column("content")):
            try:
                rows = list(enumerate(paragraphs(data.as_py() or b"")))
            except UNREADABLE:   # one bad file never takes the others with it
                rows = [(-1, UNREADABLE_TEXT)]
            rows = rows or [(-1, None)]   # a file without paragraphs
            for i in range(0, len(rows), CHUNK_ROWS):
                part = rows[i:i + CHUNK_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(part), pa.string()), pa.array([n for n, _ in part], pa.int64()),
                                                  pa.array([t for _, t in part], pa.string())], ["path", "para_idx", "text"])


def parse_docx(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> ``(path, para_idx, text)``; a file without paragraphs gives one row with
    ``para_idx`` -1 and no text, a damaged one (or one without content) such a row with the unreadable text."""
    return files.select("path", "content").mapInArrow(_parse_batches, PARA_SCHEMA)


def docx_text(files: DataFrame) -> DataFrame:
    """One text per file: non-blank paragraphs joined by newlines ('' when
    every paragraph is blank or there is none; the unreadable text for a damaged file)."""
    paras = parse_docx(files).withColumn(
        "text", F.when(pystrip(F.col("text")) != "", F.col("text")))   # blank -> null, ignored by listagg
    return (paras.groupBy("path")
            .agg(F.coalesce(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY para_idx)"), F.lit(""))
                 .alias("text")))


def read_docx(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return docx_text(files)


def build_docx(paras: Sequence[str], split_runs: bool = True) -> bytes:
    """A minimal document; each paragraph's text is split over two runs when
    ``split_runs`` (as editors do)."""
    def run(t: str) -> str:
        return f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'

    body = []
    for t in paras:
        if split_runs and len(t) > 1:
            h = len(t) // 2
            body.append(f"<w:p>{run(t[:h])}{run(t[h:])}</w:p>")
        else:
            body.append(f"<w:p>{run(t)}</w:p>" if t else "<w:p/>")
    doc = (f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W}"><w:body>'
           + "".join(body) + "</w:body></w:document>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
                   "</Types>")
        z.writestr("_rels/.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/>'
                   "</Relationships>")
        z.writestr("word/document.xml", doc)
    return buf.getvalue()
