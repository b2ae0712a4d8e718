"""Workbooks of any size, and files that can't be read."""

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from carelake.sources import docx as DX
from carelake.sources import xlsx as XL
from carelake.sources.extract import extract_text

ROWS = [["h1", "h2", "h3"], ["a", 1, True], [], ["é", None, 2.5], [None, "x"]]


def book(rows=ROWS, **kw):
    return XL.build_xlsx([("S", rows), ("Two words", [["only"]]), ("Empty", [])], **kw)


def sheet_xml(data, edit):
    """The workbook with its first sheet's XML changed."""
    src, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            text = src.read(n)
            z.writestr(n, edit(text.decode()).encode() if n.endswith("sheet1.xml") else text)
    return out.getvalue()


@pytest.mark.parametrize("shared", [True, False])
def test_rows_by_events_equal_the_grids(monkeypatch, shared):
    data = book(shared_strings=shared)
    grid = list(XL.workbook_rows(data))
    monkeypatch.setattr(XL, "GRID_BYTES", 0)
    assert list(XL.workbook_rows(data)) == grid
    assert [r[4] for r in grid if r[0] == 0] == [["h1", "h2", "h3"], ["a", "1", "True"], [None] * 3, ["é", None, "2.5"], [None, "x", None]]


def test_rows_out_of_order_and_without_numbers(monkeypatch):
    swapped = sheet_xml(book([["a"], ["b"], ["c"]]), lambda x: x.replace('r="1"', 'r="9"').replace('r="A1"', 'r="A9"'))
    plain = sheet_xml(book([["a"], ["b"]]), lambda x: x.replace('<row r="1">', "<row>").replace('<row r="2">', "<row>"))
    for size in (XL.GRID_BYTES, 0):
        monkeypatch.setattr(XL, "GRID_BYTES", size)
        got = [(r[3], r[4][0]) for r in XL.workbook_rows(swapped) if r[0] == 0]
        assert got[:2] == [(2, "b"), (3, "c")] and got[-1] == (9, "a") and len(got) == 8
        assert [(r[3], r[4][0]) for r in XL.workbook_rows(plain) if r[0] == 0] == [(1, "a"), (2, "b")]


def large(n):
    """A workbook of n rows whose XML is much larger than what a reader of it may hold."""
    buf = io.BytesIO()
    base = zipfile.ZipFile(io.BytesIO(XL.build_xlsx([("S", [["x"]])])))
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name in base.namelist():
            if not name.endswith("sheet1.xml"):
                z.writestr(name, base.read(name))
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for i in range(1, n + 1):
                f.write(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t>text of row {i} {"." * 200}</t></is></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return buf.getvalue()


def test_memory_does_not_follow_the_sheet():
    data = large(60_000)
    size = zipfile.ZipFile(io.BytesIO(data)).getinfo("xl/worksheets/sheet1.xml").file_size
    tracemalloc.start()
    count = last = 0
    for r in XL.workbook_rows(data):
        count, last = count + 1, r[4][0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 60_000 and last == "60000"
    assert peak < size / 5   # some 16 MB of XML, a grid of it takes several times that


def test_a_large_sheet_is_dealt_over_tasks(spark, tmp_path):
    paths = []
    for name, data in (("big.xlsx", large(2500)), ("small.xlsx", book()), ("_hidden.xlsx", book([["q"]])), ("bad.xlsx", b"PK no"), ("cut.xlsx", large(50)[:-400])):
        (tmp_path / name).write_bytes(data)
        paths.append(str(tmp_path / name))
    dealt = XL.read_large_xlsx(spark, paths, rows_a_task=300)
    by_task = dealt.where(F.col("path").endswith("big.xlsx")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) > 3 and sum(r["count"] for r in by_task) == 2500
    contents = spark.createDataFrame([(p, bytearray(open(p, "rb").read())) for p in paths], "path string, content binary")
    key = lambda r: (r.path, r.sheet_idx, r.row_index)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, XL.parse_xlsx(contents).collect()), key=str)
    assert len({key(r) for r in dealt.collect()}) == dealt.count()


def test_every_file_has_an_answer(spark):
    good, doc = book(), DX.build_docx(["p", " "])
    files = {"a.xlsx": good, "b.xlsx": good[:300], "c.xlsx": b"", "d.xlsx": None, "a.docx": doc, "b.docx": doc[:100], "c.docx": b"", "d.docx": None,
             "e.docx": DX.build_docx([]), "plain.txt": b"x\xff", "none.txt": None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: r.text for r in extract_text(df).collect()}
    lost = DX.UNREADABLE_TEXT
    assert {k: got[k] for k in files if k[0] != "a"} == {"b.xlsx": lost, "c.xlsx": lost, "d.xlsx": lost, "b.docx": lost, "c.docx": lost, "d.docx": lost,
                                                         "e.docx": "", "plain.txt": "x�", "none.txt": ""}
    assert got["a.docx"] == "p" and got["a.xlsx"].startswith("=== Sheet: S ===\nh1\th2\th3\na\t1\tTrue\n\t\t\n")
    docs = {r.path: r.text for r in DX.docx_text(df.where("path like '%.docx'")).collect()}
    assert docs == {k: v for k, v in got.items() if k.endswith("docx")}
    books = XL.parse_xlsx(df.where("path like '%.xlsx'"), lost)
    from carelake.operators.context import sheets_to_text
    assert {r.path: r.text for r in sheets_to_text(books, workbook="path").collect()} == {k: v for k, v in got.items() if k.endswith("xlsx")}
    plan = extract_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
