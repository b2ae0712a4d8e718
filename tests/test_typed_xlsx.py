"""Workbook types from the cells, in one read."""

import datetime as dt
import io
import os
import zipfile

import pytest

import carelake.sources.xlsx as XL
from carelake.sinks.versions import current_files, read_current, read_current_uploads
from carelake.sources.typed_xlsx import column_names, kind_of, read_sheets_once
from carelake.streaming.ingest import backfill

FOLDER = "user_id=u1/year=2026/month=06"


def _put(root, name, data):
    path = os.path.join(str(root), FOLDER, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def _book(*rows):
    return XL.build_xlsx([("S", rows), ("Other", [["not", "read"]])])


def _with_cells(header, cells):
    """A workbook whose second row is given as XML."""
    with zipfile.ZipFile(io.BytesIO(_book(header, ["x"]))) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"].decode()
    at = sheet.index('<row r="2">')
    parts["xl/worksheets/sheet1.xml"] = (sheet[:at] + f'<row r="2">{cells}</row></sheetData></worksheet>').encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    return out.getvalue()


DAY = dt.datetime(2024, 1, 31)


@pytest.mark.parametrize("values,kind", [
    ([1, -2, None], "bigint"),
    ([1, 2.5], "double"),
    ([6025550100.0], "bigint"),
    ([10**20], "double"),
    ([1e300], "double"),
    ([True, False], "boolean"),
    ([True, 1], "string"),
    ([DAY, None], "timestamp"),
    ([DAY, 7], "string"),
    (["1", "2"], "string"),      # text that looks like numbers
    (["007", 7], "string"),
    ([1, ""], "bigint"),         # an empty text is no value
    ([None], "string"),
])
def test_types_are_those_of_the_cells(spark, tmp_path, values, kind):
    path = _put(tmp_path, "a.xlsx", _book(["h", "row"], *[[v, i] for i, v in enumerate(values)]))
    with read_sheets_once(spark, [path]) as (g,):
        assert g.rows.select("h").schema[0].dataType.simpleString() == kind
        got = [r.h for r in g.rows.orderBy("_row").collect()]
    if kind != "string":
        assert got == [None if v == "" else v for v in values]


def test_cells_of_every_kind(spark, tmp_path):
    """Errors are no values; dates beyond the calendar and texts in date cells don't take the workbook with them."""
    cells = ('<c r="A2" t="e"><v>#N/A</v></c><c r="B2" s="1"><v>99999999999</v></c><c r="C2" s="1" t="e"><v>#REF!</v></c>'
             '<c r="D2" t="d"><v>2024-01-31T10:11:12</v></c><c r="E2" s="1"><v>0.5</v></c><c r="F2"><v>1E3</v></c>'
             '<c r="G2" t="str"><v>=x</v></c><c r="H2"/>')
    one = _put(tmp_path, "a.xlsx", _with_cells(list("abcdefgh"), cells))
    two = _put(tmp_path, "b.xlsx", _book(list("abcdefgh"), [5, 1, DAY, DAY, "x", 2, "y", 3]))
    with read_sheets_once(spark, [one, two]) as (g,):
        assert g.paths == [one, two]
        assert [f.dataType.simpleString() for f in g.rows.select(*g.names).schema] == [
            "bigint", "bigint", "timestamp", "timestamp", "string", "double", "string", "bigint"]
        rows = {r["_path"]: tuple(r)[2:] for r in g.rows.collect()}
    assert rows[one] == (None, 99999999999, None, dt.datetime(2024, 1, 31, 10, 11, 12), "12:00:00", 1000.0, "=x", None)
    assert rows[two] == (5, 1, DAY, DAY, "x", 2.0, "y", 3)


def test_names():
    assert column_names(["A", "a", None, "", "x y", "a_2"]) == ["A", "a_3", "_c3", "_c4", "x_y", "a_2"]
    assert column_names(["Month", "month", "month_2"], ["month"]) == ["Month_3", "month_4", "month_2"]
    assert [kind_of(m) for m in (XL.WHOLE, XL.NUMBER, XL.MOMENT, XL.TRUTH, XL.TEXT, None)] == ["bigint", "double", "timestamp", "boolean", "string", "string"]


def test_large_sheets_are_dealt_and_equal(spark, tmp_path):
    books = {"big.xlsx": [["k", "v"], *[[i, f"v{i}" if i % 3 else None] for i in range(700)]], "small.xlsx": [["k", "v"], [7.5, "x"]],
             "empty.xlsx": [], "head.xlsx": [["k", "v"]]}
    paths = [_put(tmp_path, n, _book(*rows)) for n, rows in books.items()] + [_put(tmp_path, "bad.xlsx", b"no zip")]
    found = []
    for dealing in ({}, {"whole_bytes": 2000, "rows_a_task": 100}):
        assert XL.read_first_sheets(spark, paths, **dealing).where("sheet_idx <> 0").isEmpty()
        with read_sheets_once(spark, paths, **dealing) as groups:
            found.append(sorted((os.path.basename(r["_path"]), r["_row"], r["k"], r["v"]) for g in groups if "k" in g.names for r in g.rows.collect()))
            assert sorted(os.path.basename(p) for g in groups for p in g.paths) == ["big.xlsx", "empty.xlsx", "head.xlsx", "small.xlsx"]
    want = [("big.xlsx", i + 1, float(i), f"v{i}" if i % 3 else None) for i in range(700)] + [("small.xlsx", 1, 7.5, "x")]
    assert found[0] == found[1] == sorted(want)


def test_ingest_keeps_types_and_own_columns(spark, tmp_path):
    up, lake, table = (str(tmp_path / n) for n in ("uploads", "lake", "table"))
    _put(up, "a.xlsx", _book(["Name", "name", "month", "Due", "a.b"], ["Ann", "x", 3, 12.5, "007"], ["Bo", None, None, 1, None]))
    _put(up, "bad.xlsx", b"no zip")
    _put(up, "head.xlsx", _book(["only"]))
    assert backfill(spark, up, lake, uploads_root=table) == 2 + 1
    status = {r.key.rsplit("/", 1)[1]: r.status for r in current_files(spark, lake).collect()}
    assert status == {"a.xlsx": "converted", "bad.xlsx": "placeholder", "head.xlsx": "converted"}
    got = read_current(spark, lake, "xlsx")
    types = dict(got.dtypes)
    assert [types[n] for n in ("Name", "name_2", "month_2", "Due", "a.b", "month")] == ["string", "string", "bigint", "double", "string", "string"]
    rows = sorted(tuple(r) for r in got.select("Name", "name_2", "month_2", "Due", "`a.b`", "month", "user_id", "_source_key").collect())
    assert rows == [("Ann", "x", 3, 12.5, "007", "06", "u1", f"{FOLDER}/a.xlsx"), ("Bo", None, None, 1.0, None, "06", "u1", f"{FOLDER}/a.xlsx")]
    long = {r.row_index: r.content for r in read_current_uploads(spark, table, lake).where("filename = 'a.xlsx'").collect()}
    assert long == {1: '{"Name":"Ann","name_2":"x","month_2":3,"Due":12.5,"a.b":"007"}', 2: '{"Name":"Bo","Due":1.0}'}
    # other cells under the same header: the file's rows and types are replaced
    _put(up, "a.xlsx", _book(["Name", "name", "month", "Due", "a.b"], ["Ann", "x", "March", 12, 7]))
    assert backfill(spark, up, lake, force=True, uploads_root=table) == 1 + 1
    got = read_current(spark, lake, "xlsx")
    assert [tuple(r) for r in got.select("Name", "month_2", "Due", "`a.b`").collect()] in ([("Ann", "March", "12", "7")], [("Ann", "March", 12, 7)])


def test_csv_columns_of_any_name_reach_lake_and_uploads(spark, tmp_path):
    up, lake, table = (str(tmp_path / n) for n in ("uploads", "lake", "table"))
    _put(up, "a.csv", b"a.b,row_index,_blk,content,x`y\n1,seven,8,c,2\n")
    assert backfill(spark, up, lake, uploads_root=table) == 1
    got = read_current(spark, lake, "csv").select("`a.b`", "row_index", "_blk_2", "content", "`x``y`").first()
    assert tuple(got) == (1, "seven", 8, "c", 2)
    row = read_current_uploads(spark, table, lake).first()
    assert (row.row_index, row.content) == (1, '{"a.b":1,"row_index":"seven","_blk_2":8,"content":"c","x`y":2}')
