"""File round trips in a fresh temporary folder: CSV, text, XLSX, DOCX, FHIR,
the lake (per-file overwrite, string partitions, pruning) and the catalog."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from carelake.sinks.lake import register_uploads, to_uploads, write_lake
from carelake.sinks.versions import read_current
from carelake.sources import docx as DX
from carelake.sources import fhir as FH
from carelake.sources import xlsx as XL
from carelake.sources.files import file_inventory, pending_files, read_csv, read_text_docs
from carelake.sources.lake import read_lake, with_provenance


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="carelake-test-")


def put(root, key, data):
    p = os.path.join(root, key)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return p


def test_csv_provenance_and_quoting(spark, tmp):
    a = put(tmp, "uploads/user_id=u1/year=2026/month=06/my data.csv", 'id,name\n1,"Lee, Ann"\n2,Bo\n')
    b = put(tmp, "uploads/user_id=u1/year=2026/month=06/b.csv", "id,name\n")
    df = with_provenance(read_csv(spark, [a, b]), tmp)
    rows = sorted((r.id, r.name, r._source_key, r._filename) for r in df.collect())
    assert rows == [(1, "Lee, Ann", "uploads/user_id=u1/year=2026/month=06/my data.csv", "my data.csv"),
                    (2, "Bo", "uploads/user_id=u1/year=2026/month=06/my data.csv", "my data.csv")]


def test_text_scan_replacement(spark, tmp):
    p = put(tmp, "t.txt", bytes.fromhex("61E28241FF62F09F98"))
    e = put(tmp, "empty.txt", b"")
    got = {os.path.basename(r.path): r.text for r in read_text_docs(spark, [p, e]).collect()}
    # Spark file sources skip zero-length files, so an empty upload yields no row.
    assert got == {"t.txt": "a�A�b�"}


def test_inventory_and_pending(spark, tmp):
    for k in ["uploads/user_id=u1/year=2026/month=06/a.CSV", "uploads/user_id=u1/year=2026/month=06/b.pdf",
              "uploads/user_id=u2/year=2026/month=05/c.xlsx", "uploads/user_id=u2/year=2026/month=05/noext"]:
        put(tmp, k, "x")
    inv = file_inventory(spark, tmp)
    rows = inv.collect()
    assert {r.name for r in rows} == {"a.CSV", "b.pdf", "c.xlsx", "noext"}
    assert all(r.last_modified.endswith(" UTC") and r.size == 1 for r in rows)
    assert {r.name for r in file_inventory(spark, tmp, user_id="u2").collect()} == {"c.xlsx", "noext"}
    assert "content" not in inv._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1][:200]
    done = spark.createDataFrame([("uploads/user_id=u1/year=2026/month=06/a.CSV",)], "key string")
    pend = {r.key for r in pending_files(inv.select("key"), done).collect()}
    assert pend == {"uploads/user_id=u2/year=2026/month=05/c.xlsx"}
    assert len(pending_files(inv.select("key"), done, force=True).collect()) == 2


def test_xlsx_reader_rules(spark, tmp):
    rows = [[" First Name ", "LAST NAME", None, "Mobile Number", "last name"],
            ["Ann", "Lee", "x", 6025550100, "LEE2"],
            ["Bo"],
            [None, None, None, None, None],
            ["Cy", "Ng", None, "(602) 555-0101", "NG2", "extra"]]
    for shared in (True, False):
        data = XL.build_xlsx([("Notes", [["n"]]), ("Patients", rows)], active=1, shared_strings=shared)
        p = put(tmp, f"w{int(shared)}.xlsx", data)
        parsed = XL.read_xlsx(spark, p)
        t = XL.xlsx_table(parsed, ["first name", "last name", "mobile number", ""])
        got = [(r["first name"], r["last name"], r["mobile number"]) for r in t.orderBy("row_index").collect()]
        # the blank sheet row is kept (all null), as the outreach reader yields it
        assert got == [("Ann", "LEE2", "6025550100"), ("Bo", None, None), (None, None, None),
                       ("Cy", "NG2", "(602) 555-0101")]
        assert {r.sheet for r in parsed.collect()} == {"Notes", "Patients"}
        notes = XL.xlsx_table(parsed, ["n"], sheet="Notes").count()
        assert notes == 0


def test_docx_paragraphs(spark, tmp):
    p = put(tmp, "d.docx", DX.build_docx(["Hello world", "", "  ", "Second, split over runs"]))
    assert DX.read_docx(spark, p).first().text == "Hello world\nSecond, split over runs"


def test_fhir_patients(spark, tmp):
    lines = [
        '{"resourceType":"Patient","id":"a","name":[{"family":"Lee","given":["Ann","B"]}],"birthDate":"1950-02-03"}',
        '{"resourceType":"Patient","id":"b","birthDate":"1991-01-01"}',
        '{"resourceType":"Patient","id":"c","name":[{"family":"X","given":["Y"]},{"family":"Z","given":[]}],'
        '"birthDate":"1990-01-01"}',
        "{broken",
    ]
    put(tmp, "fhir/Patient/p.ndjson", "\n".join(lines) + "\n")
    df = FH.read_fhir(spark, os.path.join(tmp, "fhir"), "Patient")
    flat = sorted((r.id, r.name_idx, r.family, r.given) for r in FH.flatten_patients(df).collect())
    assert flat == [("a", 0, "Lee", "Ann B"), ("b", None, None, None), ("c", 0, "X", "Y"), ("c", 1, "Z", "")]
    assert len(FH.corrupt_records(df).collect()) == 1
    assert {r.id for r in FH.fhir_search(df, birthdate="ge1990-01-01").collect()} == {"b", "c"}
    assert {r.id for r in FH.fhir_search(df, birthdate="1950-02-03").collect()} == {"a"}
    assert {r.id for r in FH.fhir_search(df, family="z").collect()} == {"c"}


def test_lake_per_file_overwrite_and_pruning(spark, tmp):
    root = os.path.join(tmp, "lake")

    def rows(fname, vals, month="06"):
        return spark.createDataFrame([(v, "u1", "2026", month, fname) for v in vals],
                                     "v long, user_id string, year string, month string, _filename string")

    assert write_lake(rows("a.csv", [1, 2]), root) == 2
    assert write_lake(rows("b.csv", [3], month="07"), root) == 1
    assert write_lake(rows("a.csv", [9]), root) == 1          # re-ingest replaces only a.csv
    assert write_lake(rows("a.csv", [9]), root) == 1          # idempotent
    lake = read_lake(spark, root)
    assert sorted((r.v, r._filename) for r in lake.collect()) == [(3, "b.csv"), (9, "a.csv")]
    assert dict(lake.dtypes)["month"] == "string"
    pruned = lake.where(F.col("month") == "06")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and [r.v for r in pruned.collect()] == [9]


def test_uploads_catalog(spark, tmp):
    p = put(tmp, "uploads/user_id=u1/year=2026/month=06/d.csv", "a,b\n1,x\n2,y\n3,z\n")
    src = with_provenance(read_csv(spark, p), tmp).withColumns(
        {"user_id": F.lit("u1"), "year": F.lit("2026"), "month": F.lit("06")})
    long = to_uploads(src, uploaded_at=F.lit("2026-06-01 00:00:00"))
    root = os.path.join(tmp, "uploads_long")
    write_lake(long, root)
    t = register_uploads(spark, root, table="uploads_test")
    got = sorted((r.row_index, r.content, r.filename, r.month) for r in t.collect())
    assert got == [(1, '{"a":1,"b":"x"}', "d.csv", "06"), (2, '{"a":2,"b":"y"}', "d.csv", "06"),
                   (3, '{"a":3,"b":"z"}', "d.csv", "06")]
    spark.sql("DROP TABLE uploads_test")


def test_backfill_skips_converted(spark, tmp):
    from carelake.streaming.ingest import backfill
    up = os.path.join(tmp, "uploads")
    put(up, "user_id=u1/year=2026/month=06/a.csv", "id,v\n1,x\n2,y\n")
    put(up, "user_id=u1/year=2026/month=06/b.txt", "id,v\n3,z\n")
    put(up, "user_id=u1/year=2026/month=06/c.csv", "other,cols,here\n7,8,9\n")
    put(up, "user_id=u1/year=2026/month=06/d.pdf", "%PDF")   # not tabular: never picked up
    wb = XL.build_xlsx([("Sheet1", [["Name", "Mobile Number"], ["Ann", "602-555-0100"], ["Bo", None]])])
    put(up, "user_id=u1/year=2026/month=06/f.xlsx", wb)
    lake = os.path.join(tmp, "lake")
    assert backfill(spark, up, lake) == 4 + 2      # 4 CSV/TXT rows + 2 sheet rows
    xl = read_current(spark, lake, "xlsx").collect()
    assert sorted((r.Name, r.Mobile_Number) for r in xl) == [("Ann", "602-555-0100"), ("Bo", None)]
    put(up, "user_id=u2/year=2026/month=07/e.csv", "id,v\n5,w\n")
    assert backfill(spark, up, lake) == 1          # only the new file
    sigs = {r.sig for r in read_current(spark, lake, "csv").select("sig").distinct().collect()}
    assert len(sigs) == 2                          # two header signatures, two wide roots
    assert backfill(spark, up, lake, force=True) == 5 + 2


def test_xlsx_grid_and_sheet_text(spark, tmp):
    from carelake.operators.context import sheets_to_text
    # the third row has no cells at all, as spreadsheet apps write blank rows
    data = XL.build_xlsx([("S", [["h1", "h2", "h3"], ["a"], [], ["b", None, "c"]]), ("Empty", [])])
    p = put(tmp, "g.xlsx", data)
    parsed = XL.read_xlsx(spark, p)
    got = [(r.sheet, r.row_index, r.cells) for r in parsed.orderBy("sheet_idx", "row_index").collect()]
    assert got == [("S", 1, ["h1", "h2", "h3"]), ("S", 2, ["a", None, None]), ("S", 3, [None, None, None]),
                   ("S", 4, ["b", None, "c"]), ("Empty", 1, [None])]
    text = sheets_to_text(parsed.withColumnRenamed("path", "workbook")).first().text
    assert text == "=== Sheet: S ===\nh1\th2\th3\na\t\t\n\t\t\nb\t\tc\n=== Sheet: Empty ===\n"


def test_docx_skips_table_paragraphs(spark, tmp):
    import io
    import zipfile
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = (f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>top</w:t></w:r></w:p>'
           '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
           '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    base = zipfile.ZipFile(io.BytesIO(DX.build_docx(["x"])))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in base.namelist():
            z.writestr(n, doc if n == "word/document.xml" else base.read(n))
    p = put(tmp, "t.docx", buf.getvalue())
    assert DX.read_docx(spark, p).first().text == "top\na\tb"


def test_extract_text_dispatch(spark):
    from carelake.sources.extract import UNSUPPORTED_TEXT, extract_text
    wb = XL.build_xlsx([("S", [["a", 1]])])
    files = spark.createDataFrame(
        [("u/a.XLSX", bytearray(wb)), ("u/b.docx", bytearray(DX.build_docx(["p1", "", "p2"]))),
         ("u/c.csv", bytearray(b"x,y\n1,2\n")), ("u/d.pdf", bytearray(b"%PDF-1.4")), ("u/noext", bytearray(b"\xffz"))],
        "path string, content binary")
    got = {r.path: r.text for r in extract_text(files).collect()}
    assert got == {"u/a.XLSX": "=== Sheet: S ===\na\t1", "u/b.docx": "p1\np2", "u/c.csv": "x,y\n1,2\n",
                   "u/d.pdf": UNSUPPORTED_TEXT, "u/noext": "�z"}


def test_row_index_across_splits(spark, tmp):
    lines = "\n".join(["id,v"] + [f"{i},row{i}" for i in range(1, 3001)]) + "\n"
    p = put(tmp, "uploads/user_id=u1/year=2026/month=06/big.csv", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        src = with_provenance(read_csv(spark, p), tmp).withColumns(
            {"user_id": F.lit("u1"), "year": F.lit("2026"), "month": F.lit("06")})
        assert src.rdd.getNumPartitions() > 5
        long = to_uploads(src, uploaded_at=F.lit("2026-06-01 00:00:00"))
        got = [(r.row_index, r.content) for r in long.orderBy("row_index").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f'{{"id":{i},"v":"row{i}"}}') for i in range(1, 3001)]


def test_blank_documents_keep_a_row(spark):
    from carelake.sources.extract import extract_text
    files = spark.createDataFrame([("u/blank.docx", bytearray(DX.build_docx(["", "  "]))),
                                   ("u/empty.txt", bytearray(b""))], "path string, content binary")
    assert {r.path: r.text for r in extract_text(files).collect()} == {"u/blank.docx": "", "u/empty.txt": ""}
    assert [tuple(r) for r in DX.docx_text(files.where(F.col("path").endswith(".docx"))).collect()] == \
        [("u/blank.docx", "")]


def test_xlsx_date_cells(spark, tmp):
    import datetime as dt
    rows = [["Name", "DOB", "Visit"], ["Ann", dt.date(1960, 1, 2), dt.datetime(2026, 6, 1, 9, 30)], ["Bo", 12, None]]
    p = put(tmp, "d.xlsx", XL.build_xlsx([("S", rows)]))
    got = [r.cells for r in XL.read_xlsx(spark, p).orderBy("row_index").collect()]
    assert got == [["Name", "DOB", "Visit"], ["Ann", "1960-01-02 00:00:00", "2026-06-01 09:30:00"], ["Bo", "12", None]]
