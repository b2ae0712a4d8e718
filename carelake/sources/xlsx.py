"""XLSX workbooks as rows, parsed in Arrow batches on the executors.

``parse_xlsx`` turns a ``(path, content)`` DataFrame (``binaryFile`` output or
bytes built by a job) into one row per sheet row:
``path, sheet_idx, sheet, active, row_index, cells array<string>``.
Only the standard library is used (``zipfile`` + ``xml.etree``): shared and
inline strings, numbers, booleans and sparse cells (``r="C5"``).
``xlsx_table`` then applies the header rules of the outreach reader.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.outreach import normalize_headers
from carelake.session import checkpoint_root
from carelake.sources.uploads import open_path

ROW_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("sheet_idx", T.IntegerType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    # the sheet's first row (its header) on every row: no self-join needed
    T.StructField("header_row", T.LongType()),
    T.StructField("header", T.ArrayType(T.StringType())),
])

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _text_of(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def _number_text(v: str) -> str:
    # Integral numbers are written without the float suffix ("6025550100").
    return v[:-2] if v.endswith(".0") else v


# Built-in number formats that show dates or times (spreadsheet
# format ids 14-22 and 45-47); custom formats are recognised by their tokens.
BUILTIN_DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')
_DATE_TOKENS = re.compile(r"[dmyhs]", re.IGNORECASE)


def _is_date_format(code: str) -> bool:
    return bool(_DATE_TOKENS.search(_QUOTED.sub("", code)))


def _date_styles(zf: zipfile.ZipFile, names: set) -> set[int]:
    """Indexes of the cell styles whose number format is a date or time."""
    if "xl/styles.xml" not in names:
        return set()
    root = ET.fromstring(zf.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "")
              for f in root.findall("m:numFmts/m:numFmt", _NS)}
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in BUILTIN_DATE_FORMATS or (fid in custom and _is_date_format(custom[fid])):
            out.add(i)
    return out


def _serial_text(v: str, date1904: bool) -> str:
    """A date serial as the reader's text: ``YYYY-MM-DD HH:MM:SS`` (time only
    for serials below one day in the 1900 system)."""
    serial = float(v)
    if not date1904 and 0 <= serial < 1:
        return str((datetime.datetime(1900, 1, 1) + datetime.timedelta(microseconds=round(serial * 86400e6))).time())
    base = datetime.datetime(1904, 1, 1) if date1904 else datetime.datetime(1899, 12, 30)
    if not date1904 and serial < 60:   # serials before the phantom 1900-02-29
        base += datetime.timedelta(days=1)
    return str(base + datetime.timedelta(microseconds=round(serial * 86400 * 1e6)))


#: sheets of at most so many bytes of XML are held as a grid; larger ones are read twice, row by row
GRID_BYTES = 4 << 20

#: types that a cell can have: its mask has bit i for CELL_TYPES[i]; text has no bit, and a cell without a value (blank, empty
#: text, an error such as #N/A) no mask, as it fits every type
CELL_TYPES = ("bigint", "double", "timestamp", "boolean")
WHOLE, NUMBER, MOMENT, TRUTH, TEXT = 0b0011, 0b0010, 0b0100, 0b1000, 0
_WHOLE = re.compile(r"-?\d{1,18}")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_DAY = re.compile(r"\d{4}-\d\d-\d\d([ T]|$)")
Cell = tuple[str | None, int | None]   # text and mask
BLANK: Cell = (None, None)


def _number_cell(v: str) -> Cell:
    text = _number_text(v)
    return text, WHOLE if _WHOLE.fullmatch(text) else NUMBER if _NUMBER.fullmatch(text) else TEXT


def _date_cell(v: str, date1904: bool) -> Cell:
    """A date, or a time of day (text, as it has no date); a number that is no date of the calendar stays a number."""
    try:
        text = _serial_text(v, date1904)
    except (ValueError, OverflowError):
        return _number_cell(v)
    return text, MOMENT if _DAY.match(text) else TEXT


class _Strings:
    """The shared strings: one buffer of bytes and the places in it."""

    def __init__(self):
        self.data, self.ends = bytearray(), array("Q", [0])

    def add(self, text: str) -> None:
        self.data += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise IndexError(i)
        return self.data[self.ends[i]:self.ends[i + 1]].decode("utf-8", "surrogatepass")


class Workbook:
    """A workbook read by events: memory holds the shared strings and a row, and a small sheet's grid."""

    def __init__(self, file):
        self.zf = zf = zipfile.ZipFile(file)
        names = set(zf.namelist())
        self.shared = _Strings()
        if "xl/sharedStrings.xml" in names:
            with zf.open("xl/sharedStrings.xml") as f:
                for si in _elements(f, "si"):
                    self.shared.add(_text_of(si))
        wb = ET.fromstring(zf.read("xl/workbook.xml"))
        rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", _NS)}
        self.date_styles = _date_styles(zf, names)
        pr = wb.find("m:workbookPr", _NS)
        self.date1904 = pr is not None and pr.get("date1904", "0") in ("1", "true")
        view = wb.find("m:bookViews/m:workbookView", _NS)
        active = int(view.get("activeTab", "0")) if view is not None else 0
        self.sheets: list[tuple[int, str, bool, str]] = []
        for idx, sh in enumerate(wb.findall("m:sheets/m:sheet", _NS)):
            t = target.get(sh.get(f"{{{_NS['r']}}}id"), "")
            self.sheets.append((idx, sh.get("name"), idx == active, t.lstrip("/") if t.startswith("/") else f"xl/{t}"))
        self._bounds: dict[str, tuple] = {}
        self._grids: dict[str, dict[int, dict[int, Cell]]] = {}

    def _cell(self, c) -> Cell:
        typ, v = c.get("t", "n"), c.find("m:v", _NS)
        if typ == "inlineStr":
            is_ = c.find("m:is", _NS)
            text = _text_of(is_) if is_ is not None else None
            return text, TEXT if text else None
        if v is None or v.text is None:
            return BLANK
        if typ in ("s", "str"):
            text = self.shared[int(v.text)] if typ == "s" else v.text
            return text, TEXT if text else None
        if typ == "b":
            return "True" if v.text == "1" else "False", TRUTH
        if typ == "e":
            return v.text, None
        if typ == "d":   # a date as ISO text
            return v.text.replace("T", " "), MOMENT if _DAY.match(v.text) else TEXT
        if c.get("s") is not None and int(c.get("s")) in self.date_styles:
            return _date_cell(v.text, self.date1904)
        return _number_cell(v.text)

    def _stored(self, part: str, wanted=lambda n: True) -> Iterator[tuple[int, dict[int, Cell]]]:
        """(row number, cells by column) of the rows that have cells, as they stand; values only of wanted rows."""
        number = 0
        with self.zf.open(part) as f:
            for row in _elements(f, "row"):
                number = int(row.get("r")) if row.get("r") else number + 1
                cells: dict[int, Cell] = {}
                nxt, keep = 1, wanted(number)
                for c in row.findall("m:c", _NS):
                    ref = c.get("r")
                    col = _col_number(_REF.match(ref).group(1)) if ref else nxt
                    nxt = col + 1
                    cells[col] = self._cell(c) if keep else BLANK
                if cells:
                    yield number, cells

    def bounds(self, part: str) -> tuple[int, int, int, int, dict[int, Cell]]:
        """First and last used row, first and last used column, cells of the first used row (an empty sheet is one
        empty cell).  Reads the whole sheet, so a damaged one shows."""
        if part not in self._bounds:
            whole = self.zf.getinfo(part).file_size <= GRID_BYTES
            grid: dict[int, dict[int, Cell]] = {}
            r0 = r1 = c0 = c1 = None
            first: dict[int, Cell] = {}
            for number, cells in self._stored(part):
                if r1 is not None and number <= r1 and not whole:
                    # rows out of order: only a grid can put them right
                    grid, whole = dict(self._stored(part)), True
                    break
                if whole:
                    grid[number] = cells
                if r0 is None:
                    r0, first = number, cells
                r1 = number
                c0, c1 = (min(cells), max(cells)) if c0 is None else (min(c0, min(cells)), max(c1, max(cells)))
            if whole:
                self._grids[part] = grid
                if grid:
                    r0, r1 = min(grid), max(grid)
                    c0, c1 = min(min(c) for c in grid.values()), max(max(c) for c in grid.values())
                    first = grid[r0]
            self._bounds[part] = (r0, r1, c0, c1, first) if r0 is not None else (1, 1, 1, 1, {})
        return self._bounds[part]

    def cells(self, part: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, list[Cell]]]:
        """(row number, cells padded to the used columns) of the used range, rows without cells too; of rows lo .. hi - 1."""
        r0, r1, c0, c1, _ = self.bounds(part)
        lo, hi = max(lo, r0), min(r1 + 1, hi if hi is not None else r1 + 1)
        grid = self._grids.get(part)
        stored = iter(sorted(grid.items())) if grid is not None else self._stored(part, lambda n: lo <= n < hi)
        at = lo
        for number, cells in stored:
            if number < lo:
                continue
            if number >= hi:
                break
            for blank in range(at, number):
                yield blank, [BLANK] * (c1 - c0 + 1)
            yield number, [cells.get(i, BLANK) for i in range(c0, c1 + 1)]
            at = number + 1
        for blank in range(at, hi):
            yield blank, [BLANK] * (c1 - c0 + 1)

    def rows(self, part: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """``cells`` as texts."""
        for number, cells in self.cells(part, lo, hi):
            yield number, [text for text, _ in cells]

    def header(self, part: str) -> tuple[int, list[str | None]]:
        r0, _, c0, c1, first = self.bounds(part)
        return r0, [first.get(i, BLANK)[0] for i in range(c0, c1 + 1)]


def _elements(f, name: str) -> Iterator[ET.Element]:
    """The elements of a name, one at a time; what has been read is let go."""
    tag, open_ = f"{{{_NS['m']}}}{name}", []
    for event, el in ET.iterparse(f, ("start", "end")):
        if event == "start":
            open_.append(el)
            continue
        open_.pop()
        if el.tag == tag:
            yield el
            if open_:
                open_[-1].clear()


def workbook_rows(data: bytes) -> Iterator[tuple[int, str, bool, int, list[str | None], int, list[str | None]]]:
    """(sheet_idx, sheet name, is active, 1-based row number, cells, header row
    number, header cells) for every row of each sheet's used range, cells
    padded to the used columns.  All sheets are looked through before the first row."""
    wb = Workbook(io.BytesIO(data))
    for *_, part in wb.sheets:
        wb.bounds(part)
    for idx, name, active, part in wb.sheets:
        head = wb.header(part)
        for number, cells in wb.rows(part):
            yield idx, name, active, number, cells, *head


#: what a damaged or foreign file (a legacy .xls, say) makes the parser raise
UNREADABLE = (zipfile.BadZipFile, zlib.error, ET.ParseError, KeyError, ValueError, IndexError, AttributeError, TypeError, EOFError, NotImplementedError)
CHUNK_ROWS = 2000
_ARROW = pa.schema([("path", pa.string()), ("sheet_idx", pa.int32()), ("sheet", pa.string()), ("active", pa.bool_()),
                    ("row_index", pa.int64()), ("cells", pa.list_(pa.string())), ("header_row", pa.int64()),
                    ("header", pa.list_(pa.string()))])


def _batches(path: str, rows: Iterator[tuple], schema: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    while part := [(path, *r) for r in islice(rows, CHUNK_ROWS)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _parser(damaged: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path"), b.column("content")):
                try:
                    rows = workbook_rows(data.as_py() or b"")
                    first = next(rows, None)   # a file that can't be read shows here
                except UNREADABLE:   # one bad file never takes the others with it
                    rows, first = iter(()), None if damaged is None else (-1, None, False, -1, [damaged], -1, [])
                if first is not None:
                    yield from _batches(path.as_py(), chain([first], rows))
    return run


def parse_xlsx(files: DataFrame, damaged: str | None = None) -> DataFrame:
    """``(path, content)`` -> workbook rows (see module doc).  A file that can't
    be read gives no rows (a readable one gives at least one), or with
    ``damaged`` one row of sheet -1 with that text as its cell."""
    return files.select("path", "content").mapInArrow(_parser(damaged), ROW_SCHEMA)


def read_xlsx(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return parse_xlsx(files)


# --------------------------------------------------------- large workbooks --
ROWS_A_TASK = 100_000
WHOLE_BYTES = 64 << 20
CELL_SCHEMA = T.StructType([*ROW_SCHEMA.fields, T.StructField("masks", T.ArrayType(T.ByteType()))])
_ARROW_CELLS = _ARROW.append(pa.field("masks", pa.list_(pa.int8())))
_PLAN = "path string, sheet_idx int, lo long, hi long"


def _deal(rows_a_task: int, whole_bytes: int | None = None):
    """Ranges of rows of the sheets.  With ``whole_bytes`` of the first sheet only, which is one range without an end where
    the sheets' XML takes no more than that (then only the directory of the file is read here)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path in b.column("path").to_pylist():
                fs, name = open_path(path)
                try:
                    with fs.open_input_file(name) as f:
                        if whole_bytes is not None and _sheet_bytes(f) <= whole_bytes:
                            out.append((path, 0, 0, None))
                            continue
                        wb = Workbook(f)
                        mine = []
                        for idx, _, _, part in wb.sheets[:None if whole_bytes is None else 1]:
                            r0, r1, *_ = wb.bounds(part)
                            mine += [(path, idx, lo, min(lo + rows_a_task, r1 + 1)) for lo in range(r0, r1 + 1, rows_a_task)]
                    out += mine
                except UNREADABLE:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                             [f.split()[0] for f in _PLAN.split(", ")])
    return run


def _sheet_bytes(f) -> int:
    """Bytes of XML of the largest sheet, from the file's directory."""
    with zipfile.ZipFile(f) as zf:
        return max((i.file_size for i in zf.infolist() if i.filename.startswith("xl/worksheets/")), default=0)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, idx, lo, hi in zip(*(b.column(c).to_pylist() for c in range(4))):
            fs, name = open_path(path)
            with fs.open_input_file(name) as f:
                wb = Workbook(f)
                _, sheet, active, part = wb.sheets[idx]
                head = wb.header(part)
                yield from _batches(path, ((idx, sheet, active, n, cells, *head) for n, cells in wb.rows(part, lo, hi)))


def _read_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, idx, lo, hi in zip(*(b.column(c).to_pylist() for c in range(4))):
            fs, name = open_path(path)
            with fs.open_input_file(name) as f:
                try:
                    wb = Workbook(f)
                    _, sheet, active, part = wb.sheets[idx]
                    head = wb.header(part)   # looks through the whole sheet
                except UNREADABLE:
                    if hi is not None:
                        raise   # it could be read when it was dealt
                    continue
                rows = ((idx, sheet, active, n, [t for t, _ in cells], *head, [m for _, m in cells]) for n, cells in wb.cells(part, lo, hi))
                yield from _batches(path, rows, _ARROW_CELLS)


def _dealt(spark: SparkSession, paths: Sequence[str], deal) -> DataFrame:
    most = 4 * spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    ranges = listed.repartition(max(1, min(len(paths), most)), "path").mapInArrow(deal, _PLAN)
    checkpoint_root(spark)
    ranges = ranges.checkpoint()
    n = max(1, min(ranges.count(), most))
    return ranges.repartition(n, "path", "sheet_idx", "lo")


def read_large_xlsx(spark: SparkSession, paths: Sequence[str] | str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """The rows that ``read_xlsx`` gives, for workbooks of any size: files are never held whole, and a sheet is
    dealt over tasks by ranges of rows.  A task reads the sheet's XML up to its
    range and makes rows of the range only."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _dealt(spark, paths, _deal(rows_a_task)).mapInArrow(_read_ranges, ROW_SCHEMA)


def read_first_sheets(spark: SparkSession, paths: Sequence[str], rows_a_task: int = ROWS_A_TASK,
                      whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Rows of the first sheet of workbooks of any size, with the ``masks`` of their cells (see ``CELL_TYPES``).

    A file whose sheets take at most ``whole_bytes`` of XML is one task's and read once; the first sheet of a
    larger one is dealt over tasks by ranges of rows.  No file is held whole.  Files that can't be read give no rows,
    readable ones at least one.
    """
    return _dealt(spark, list(paths), _deal(rows_a_task, whole_bytes)).mapInArrow(_read_cells, CELL_SCHEMA)


def xlsx_table(rows: DataFrame, columns: Sequence[str], sheet: str | None = None) -> DataFrame:
    """Rows of one sheet per workbook as a table of the wanted ``columns``.

    The first row is the header (lower-cased, stripped, null -> ''); the
    sheet is ``sheet`` by name or the active one; a duplicated header maps to
    its last column; short rows are padded with null.
    """
    chosen = rows.where(F.col("sheet") == sheet) if sheet is not None else rows.where(F.col("active"))
    # A projection: every row already carries its sheet's header.
    body = (chosen.where(F.col("row_index") > F.col("header_row"))
            .withColumn("_hdr", normalize_headers("header")))
    rev = F.reverse(F.col("_hdr"))
    out = [F.col("path"), F.col("sheet"), F.col("row_index")]
    for name in columns:
        pos = F.array_position(rev, F.lit(name))
        idx = F.size(F.col("_hdr")) - pos + 1
        out.append(F.when(pos > 0, F.try_element_at(F.col("cells"), idx.cast("int"))).alias(name))
    return body.select(*out)


# --------------------------------------------------------------- building --
def _col_letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def build_xlsx(sheets: Sequence[tuple[str, Sequence[Sequence[object]]]], active: int = 0,
               shared_strings: bool = True) -> bytes:
    """A minimal valid workbook.  Strings go to the shared table (or inline),
    numbers and booleans are typed cells, ``None`` cells are omitted."""
    sst: list[str] = []
    sst_idx: dict[str, int] = {}

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (datetime.date, datetime.datetime)):
            d = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
            serial = (d - datetime.datetime(1899, 12, 30)).total_seconds() / 86400
            return f'<c r="{ref}" s="1"><v>{serial!r}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        s = str(v)
        if shared_strings:
            if s not in sst_idx:
                sst_idx[s] = len(sst)
                sst.append(s)
            return f'<c r="{ref}" t="s"><v>{sst_idx[s]}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(s)}</t></is></c>'

    sheet_xml = []
    for _, rows in sheets:
        parts = []
        for i, row in enumerate(rows, start=1):
            cs = "".join(cell(f"{_col_letters(j)}{i}", v) for j, v in enumerate(row, start=1))
            parts.append(f'<row r="{i}">{cs}</row>')
        sheet_xml.append('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                         f'<worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(parts)}</sheetData></worksheet>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                             for i in range(1, n + 1))
                   + '<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>'
                   '</Types>')
        z.writestr("_rels/.rels",
                   f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["pr"]}">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                   '</Relationships>')
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}">'
                   f'<bookViews><workbookView activeTab="{active}"/></bookViews><sheets>'
                   + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>'
                             for i, (name, _) in enumerate(sheets, start=1))
                   + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["pr"]}">'
                   + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>'
                             for i in range(1, n + 1))
                   + f'<Relationship Id="rId{n + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/>'
                   + f'<Relationship Id="rId{n + 2}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
                   "</Relationships>")
        # style 0: general; style 1: built-in date format 14
        z.writestr("xl/styles.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_NS["m"]}">'
                   '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs>'
                   "</styleSheet>")
        for i, x in enumerate(sheet_xml, start=1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", x)
        z.writestr("xl/sharedStrings.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{_NS["m"]}" count="{len(sst)}" uniqueCount="{len(sst)}">'
                   + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in sst) + "</sst>")
    return buf.getvalue()
