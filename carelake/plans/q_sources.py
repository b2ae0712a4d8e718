"""Scans and sinks over files written (or built) by Spark from the driver
tables: CSV uploads, the Parquet lake, the ``uploads`` catalog table, XLSX and
DOCX bytes, FHIR NDJSON, and backfill discovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.session import scratch_dir
from carelake.sinks.lake import register_uploads, to_uploads, write_lake
from carelake.sources import docx as DX
from carelake.sources import fhir as FH
from carelake.sources import xlsx as XL
from carelake.sources.files import file_inventory, pending_files, read_csv, read_text_docs
from carelake.sources.lake import key_parts, read_lake, with_provenance
from carelake.sources.uploads import open_path
from carelake.plans.registry import register
from carelake.plans.tables import table

_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_UPLOAD_USER = "'u' || CAST(o_custkey % 4 AS VARCHAR)"
_ORDERS_WITH_KEYS_SQL = (f"SELECT *, {_UPLOAD_USER} AS user_id, strftime(o_orderdate, '%Y') AS year, "
                         "strftime(o_orderdate, '%m') AS month FROM orders")


def _orders_keyed(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumns({"user_id": F.concat(F.lit("u"), (F.col("o_custkey") % 4).cast("string")),
                          "year": F.date_format("o_orderdate", "yyyy"), "month": F.date_format("o_orderdate", "MM")})


def _conform(df, spark, sf):
    """Cast inferred columns back to the source table's types."""
    src = table(spark, sf, "orders").schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in src.fields],
                     *[c for c in df.columns if c not in src.names])


@register("csv_scan", _ORDERS_WITH_KEYS_SQL)
def q_csv_scan(spark, sf):
    """Orders uploaded as one CSV per user and month, scanned back with header
    and inferred types; partition keys come from each row's source key."""
    root = scratch_dir(spark, "csv-uploads")
    (_orders_keyed(spark, sf).hint("rebalance", "user_id", "year", "month").sortWithinPartitions("o_orderkey")
     .write.option("header", "true").partitionBy("user_id", "year", "month").csv(f"{root}/uploads"))
    df = with_provenance(read_csv(spark, f"{root}/uploads", recursive=True), root)
    parts = key_parts(F.col("_source_key"))
    out = df.withColumns({k: parts[k] for k in ("user_id", "year", "month")})
    return _conform(out, spark, sf).drop("_source_key", "_filename")


@register("lake_partition_scan", _ORDERS_WITH_KEYS_SQL)
def q_lake_partition_scan(spark, sf):
    """Write to the lake (per-file overwrite layout), read back with string
    partition keys."""
    root = scratch_dir(spark, "lake")
    staged = _orders_keyed(spark, sf).withColumns({"_filename": F.lit("orders.csv"),
                                                   "_source_key": F.lit("uploads/orders.csv")})
    write_lake(staged, root)
    return read_lake(spark, root).select(*_ORDER_COLS, "user_id", "year", "month")


@register("write_count", "SELECT count(*) AS rows_written FROM orders")
def q_write_count(spark, sf):
    root = scratch_dir(spark, "lake-count")
    staged = _orders_keyed(spark, sf).withColumns({"_filename": F.lit("orders.csv"),
                                                   "_source_key": F.lit("uploads/orders.csv")})
    n = write_lake(staged, root)
    return spark.createDataFrame([(n,)], "rows_written bigint")


@register("uploads_table", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS row_index, 'orders.parquet' AS filename,
  'u0' AS user_id, '2026' AS year, '06' AS month, o_orderkey
FROM orders""")
def q_uploads_table(spark, sf):
    """The orders file as one upload, in the catalog's long form."""
    root = scratch_dir(spark, "uploads-table")
    src = table(spark, sf, "orders").withColumns({
        "_source_key": F.lit("uploads/user_id=u0/year=2026/month=06/orders.parquet"),
        "_filename": F.lit("orders.parquet"), "user_id": F.lit("u0"), "year": F.lit("2026"),
        "month": F.lit("06")})
    long = to_uploads(src, uploaded_at=F.lit("2026-06-01 00:00:00"))
    write_lake(long, root)
    name = f"uploads_{root.rsplit('-', 1)[-1]}"
    t = register_uploads(spark, root, table=name)
    return t.select("row_index", "filename", "user_id", "year", "month",
                    F.get_json_object("content", "$.o_orderkey").cast("long").alias("o_orderkey"))


# -------------------------------------------------------------- file trees --
def _write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            fs, name = open_path(path)
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(name, compression=None) as out:
                out.write(content or b"")
        yield b.select(["path"])


def put_files(files: DataFrame) -> None:
    """Write (path, content) as files with just these names; the tasks write."""
    n = files.sparkSession.sparkContext.defaultParallelism
    files.select("path", "content").repartition(n, "path").mapInArrow(_write_files, "path string").write.format("noop").mode("overwrite").save()


@register("upload_inventory", """
WITH f AS (
  SELECT 'uploads/user_id=u' || CAST(doc_id % 7 AS VARCHAR) || '/year=2026/month=' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '/' AS folder,
    CASE doc_id % 5 WHEN 0 THEN '_' || CAST(doc_id AS VARCHAR) || '_.csv' WHEN 1 THEN '.' || CAST(doc_id AS VARCHAR) || '.csv'
      WHEN 2 THEN 'no bytes ' || CAST(doc_id AS VARCHAR) || '.txt' ELSE 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' END AS name,
    CASE WHEN doc_id % 5 = 2 THEN 0 ELSE octet_length(encode(coalesce(text, ''))) END AS size, doc_id % 7 AS u
  FROM documents)
SELECT 'all' AS scope, folder || name AS key, name, CAST(size AS BIGINT) AS size FROM f
UNION ALL SELECT 'u3', folder || name, name, CAST(size AS BIGINT) FROM f WHERE u = 3""")
def q_upload_inventory(spark, sf):
    """Documents as files of seven users, under hidden names and without bytes too, listed for all users and for one."""
    root = scratch_dir(spark, "inventory")
    i = F.col("doc_id")
    kind = i % 5
    name = (F.when(kind == 0, F.format_string("_%d_.csv", i)).when(kind == 1, F.format_string(".%d.csv", i))
            .when(kind == 2, F.format_string("no bytes %d.txt", i)).otherwise(F.format_string("doc-%d.txt", i)))
    path = F.concat(F.format_string(f"{root}/uploads/user_id=u%d/year=2026/month=%02d/", i % 7, 1 + i % 12), name)
    put_files(table(spark, sf, "documents").select(path.alias("path"), F.when(kind != 2, F.col("text").cast("binary")).alias("content")))
    listed = [file_inventory(spark, root, user).select(F.lit(scope).alias("scope"), "key", "name", "size") for scope, user in (("all", None), ("u3", "u3"))]
    return listed[0].unionByName(listed[1])


# ------------------------------------------------------------------- xlsx --
_XLSX_HEADERS = ["Customer Key", " First Name ", "Last Name", "Amount Due", "MOBILE NUMBER", "last name"]
WORKBOOK_ROWS = 1000  # customers per workbook: files stay bounded at any scale


def _xlsx_files(spark, sf):
    """One workbook per (nation, block of 1000 customers): a notes sheet and the
    active patient sheet; every 9th row is short (padded with null)."""
    c = table(spark, sf, "customer").withColumn("_wb", F.concat_ws(
        "-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / WORKBOOK_ROWS).cast("string")))

    # A row a workbook: no data frame is built for each of many small groups.
    books = c.groupBy("_wb").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("due")))).alias("_c"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for cust in zip(*(b.column(n).to_pylist() for n in ("c_custkey", "c_name", "due"))):
                rows = [_XLSX_HEADERS]
                for k, name, due in zip(*cust):
                    first, last = name.split("#", 1)
                    row = [k, first, last, due, 6025550000 + k % 10000, last.lower()]
                    rows.append(row[:4] if k % 9 == 0 else row)
                files.append(XL.build_xlsx([("Notes", [["generated"]]), ("Patients", rows)], active=1, shared_strings=cust[0][0] % 2 == 0))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(files, pa.binary())], ["path", "content"])

    path = F.concat(F.lit("uploads/xlsx/"), "_wb", F.lit(".xlsx")).alias("path")
    return books.select(path, "_c.c_custkey", "_c.c_name", "_c.due").mapInArrow(build, "path string, content binary")


@register("xlsx_scan", """
SELECT c_custkey AS customer_key, split_part(c_name, '#', 1) AS first_name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lower(split_part(c_name, '#', 2)) END AS last_name,
  c_acctbal AS amount_due,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(6025550000 + c_custkey % 10000 AS VARCHAR) END AS mobile_number
FROM customer""", headline=True)
def q_xlsx_scan(spark, sf):
    rows = XL.parse_xlsx(_xlsx_files(spark, sf))
    t = XL.xlsx_table(rows, ["customer key", "first name", "last name", "amount due", "mobile number"])
    return t.select(F.col("customer key").cast("long").alias("customer_key"),
                    F.col("first name").alias("first_name"), F.col("last name").alias("last_name"),
                    F.col("amount due").cast("double").alias("amount_due"),
                    F.col("mobile number").alias("mobile_number"))


# ------------------------------------------------------------------- docx --
DOC_TURNS = 500  # turns per generated document: files stay bounded at any scale


def _docx_files(spark, sf):
    """One document per (conversation, block of 500 turns): each line of each
    turn a paragraph, a blank paragraph after every turn."""
    cv = table(spark, sf, "conversations").withColumn("_blk", F.floor(F.col("turn") / DOC_TURNS))

    docs = cv.groupBy("conv_id", "_blk").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for texts in b.column("text").to_pylist():
                paras = []
                for t in texts:
                    paras.extend((t or "").split("\n"))
                    paras.append("")
                files.append(DX.build_docx(paras))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(files, pa.binary())], ["path", "content"])

    path = F.concat(F.lit("uploads/docx/conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("_blk").cast("string"), F.lit(".docx")).alias("path")
    return docs.select(path, "_t.text").mapInArrow(build, "path string, content binary")


_DOCX_TEXT_SQL = """
WITH lines AS (
  SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS i,
         unnest(string_split(text, chr(10))) AS line
  FROM conversations)
SELECT 'uploads/docx/conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 500 AS VARCHAR) || '.docx' AS path,
  coalesce(string_agg(CASE WHEN trim(line) <> '' THEN line END, chr(10) ORDER BY turn, i), '') AS text
FROM lines GROUP BY conv_id, turn // 500"""


@register("docx_text", _DOCX_TEXT_SQL)
def q_docx_text(spark, sf):
    return DX.docx_text(_docx_files(spark, sf))


@register("damaged_files", """
WITH f AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'xlsx' ELSE 'docx' END AS ext, doc_id % 10 // 2 AS state, coalesce(text, '') AS text FROM documents),
t AS (SELECT ext || '/' || CAST(doc_id AS VARCHAR) || '.' || ext AS path,
        CASE WHEN state IN (1, 2) THEN '[Could not read this file]' WHEN ext = 'docx' THEN CASE WHEN state = 3 THEN '' ELSE 'words ' || CAST(length(text) AS VARCHAR) END
          WHEN state = 3 THEN '=== Sheet: S ===' || chr(10) ELSE '=== Sheet: S ===' || chr(10) || 'words ' || CAST(length(text) AS VARCHAR) END AS text
      FROM f)
SELECT 'extract' AS by_, path, text FROM t UNION ALL SELECT 'format', path, text FROM t""")
def q_damaged_files(spark, sf):
    """A workbook or document per text: good, cut off, without bytes or without content; every file gets an answer, from the
    dispatching extractor and from the readers of each format."""
    from carelake.operators.context import sheets_to_text
    from carelake.sources.extract import extract_text
    docs = table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))

    def build(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for i, n in zip(pdf.doc_id.tolist(), pdf.n.tolist()):
                ext, state = "xlsx" if i % 2 == 0 else "docx", i % 10 // 2
                line = [] if state == 3 else [f"words {n}"]
                data = XL.build_xlsx([("S", [line] if line else [])]) if ext == "xlsx" else DX.build_docx(line)
                rows.append((f"{ext}/{i}.{ext}", data[:len(data) // 2] if state == 1 else b"" if state == 2 else data))
            yield pd.DataFrame(rows, columns=["path", "content"])
    files = docs.mapInPandas(build, "path string, content binary")
    books = XL.parse_xlsx(files.where(F.col("path").endswith("xlsx")), DX.UNREADABLE_TEXT)
    by_format = sheets_to_text(books, workbook="path").unionByName(DX.docx_text(files.where(F.col("path").endswith("docx"))))
    out = [df.select(F.lit(by).alias("by_"), "path", "text") for by, df in (("extract", extract_text(files)), ("format", by_format))]
    return out[0].unionByName(out[1])


@register("read_files", """
SELECT CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' ELSE 'csv' END AS kind, doc_id,
  CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'length ' || CAST(length(coalesce(text, '')) AS VARCHAR)
    WHEN 2 THEN '=== Sheet: S ===' || chr(10) || CAST(length(coalesce(text, '')) AS VARCHAR) ELSE CAST(length(coalesce(text, '')) AS VARCHAR) END AS text
FROM documents""")
def q_read_files(spark, sf):
    """Documents as files of four formats, each read back by its format's reader."""
    from carelake.operators.context import sheets_to_text
    root = scratch_dir(spark, "read-files")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def build(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for i, t in zip(pdf.doc_id.tolist(), pdf.text.tolist()):
                kind = ("txt", "docx", "xlsx", "csv")[i % 4]
                data = (t.encode() if kind == "txt" else DX.build_docx([f"length {len(t)}"]) if kind == "docx"
                        else XL.build_xlsx([("S", [[len(t)]])]) if kind == "xlsx" else f"id,n\n{i},{len(t)}\n".encode())
                rows.append((f"{root}/{kind}/{i}.{kind}", data))
            yield pd.DataFrame(rows, columns=["path", "content"])
    put_files(docs.mapInPandas(build, "path string, content binary"))
    id_ = F.regexp_extract("path", r"/([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_id")
    found = [read_text_docs(spark, f"{root}/txt").select(F.lit("txt").alias("kind"), id_, "text"),
             DX.read_docx(spark, f"{root}/docx").select(F.lit("docx"), id_, "text"),
             sheets_to_text(XL.read_xlsx(spark, f"{root}/xlsx"), workbook="path").select(F.lit("xlsx"), id_, "text"),
             read_csv(spark, f"{root}/csv").select(F.lit("csv"), F.col("id").cast("long"), F.col("n").cast("string"))]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


# ------------------------------------------------------------------- fhir --
def _fhir_root(spark, sf):
    """Patient resources from customer as NDJSON (plus malformed lines)."""
    root = scratch_dir(spark, "fhir")
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    fam = F.split_part(F.col("c_name"), F.lit("#"), F.lit(2))
    one = F.struct(fam.alias("family"), F.array(F.lit("Customer"), F.col("c_nationkey").cast("string")).alias("given"))
    alias = F.struct(F.lit("Alias").alias("family"), F.array(F.lit("C"), F.lit("K")).alias("given"))
    name = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.array(one, alias)).otherwise(F.array(one))
    birth = F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), ((k * 37) % 25000).cast("int")), "yyyy-MM-dd")
    res = c.select(F.to_json(F.struct(F.lit("Patient").alias("resourceType"),
                                      F.concat(F.lit("p"), k.cast("string")).alias("id"),
                                      name.alias("name"), birth.alias("birthDate"))).alias("value"))
    bad = c.where(k % 50 == 7).select(F.lit('{"resourceType": "Patient", broken').alias("value"))
    res.unionByName(bad).write.text(f"{root}/Patient")
    return root


_FHIR_BIRTH_SQL = "DATE '1940-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER)"


@register("fhir_flatten", f"""
SELECT 'p' || CAST(c_custkey AS VARCHAR) AS id, CAST(NULL AS INTEGER) AS name_idx, CAST(NULL AS VARCHAR) AS family,
  CAST(NULL AS VARCHAR) AS given, {_FHIR_BIRTH_SQL} AS birth_date FROM customer WHERE c_custkey % 11 = 0
UNION ALL
SELECT 'p' || CAST(c_custkey AS VARCHAR), 0, split_part(c_name, '#', 2), 'Customer ' || CAST(c_nationkey AS VARCHAR),
  {_FHIR_BIRTH_SQL} FROM customer WHERE c_custkey % 11 <> 0
UNION ALL
SELECT 'p' || CAST(c_custkey AS VARCHAR), 1, 'Alias', 'C K', {_FHIR_BIRTH_SQL} FROM customer WHERE c_custkey % 11 = 1""")
def q_fhir_flatten(spark, sf):
    return FH.flatten_patients(FH.read_fhir(spark, _fhir_root(spark, sf), "Patient"))


@register("fhir_search", f"""
SELECT 'p' || CAST(c_custkey AS VARCHAR) AS id, {_FHIR_BIRTH_SQL} AS birth_date
FROM customer WHERE {_FHIR_BIRTH_SQL} >= DATE '1990-01-01'""")
def q_fhir_search(spark, sf):
    df = FH.read_fhir(spark, _fhir_root(spark, sf), "Patient")
    return FH.fhir_search(df, birthdate="ge1990-01-01").select("id", "birth_date")


# ---------------------------------------------------------------- backfill --
_DOC_KEY_SQL = ("'uploads/user_id=u' || CAST(doc_id % 3 AS VARCHAR) || '/year=2026/month=06/doc-' || "
                "CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.csv' WHEN 'fr' THEN '.TXT' "
                "WHEN 'de' THEN '.xlsx' ELSE '.pdf' END")


def _doc_key():
    ext = (F.when(F.col("lang") == "en", ".csv").when(F.col("lang") == "fr", ".TXT")
            .when(F.col("lang") == "de", ".xlsx").otherwise(".pdf"))
    return F.concat(F.lit("uploads/user_id=u"), (F.col("doc_id") % 3).cast("string"),
                    F.lit("/year=2026/month=06/doc-"), F.col("doc_id").cast("string"), ext)


@register("pending_files", f"""
SELECT {_DOC_KEY_SQL} AS key FROM documents
WHERE lang IN ('en', 'fr', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_pending_files(spark, sf):
    """Uploads = documents (extension by language); converted = labelled ones."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    listing = docs.select(_doc_key().alias("key"))
    done = table(spark, sf, "labels").join(docs, "doc_id").select(_doc_key().alias("key"))
    return pending_files(listing, done)


def _wb_sql(col: str) -> str:
    return f"CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor({col} / {WORKBOOK_ROWS}) AS BIGINT) AS VARCHAR)"


_XLSX_TEXT_SQL = f"""
WITH c AS (SELECT *, {_wb_sql('c_custkey')} AS wb FROM customer),
lines AS (
  SELECT wb, 0 AS s, 0 AS r, '=== Sheet: Notes ===' AS line FROM c GROUP BY wb
  UNION ALL SELECT wb, 0, 1, 'generated' FROM c GROUP BY wb
  UNION ALL SELECT wb, 1, 0, '=== Sheet: Patients ===' FROM c GROUP BY wb
  UNION ALL SELECT wb, 1, 1, 'Customer Key' || chr(9) || ' First Name ' || chr(9) || 'Last Name' || chr(9)
                      || 'Amount Due' || chr(9) || 'MOBILE NUMBER' || chr(9) || 'last name' FROM c GROUP BY wb
  UNION ALL SELECT wb, 1, 2 + c_custkey,
    CAST(c_custkey AS VARCHAR) || chr(9) || split_part(c_name, '#', 1) || chr(9) || split_part(c_name, '#', 2)
    || chr(9) || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '')
    || CASE WHEN c_custkey % 9 = 0 THEN chr(9) || chr(9)
            ELSE chr(9) || CAST(6025550000 + c_custkey % 10000 AS VARCHAR) || chr(9) || lower(split_part(c_name, '#', 2))
       END
  FROM c)
SELECT 'uploads/xlsx/' || wb || '.xlsx' AS path, string_agg(line, chr(10) ORDER BY s, r) AS text
FROM lines GROUP BY wb"""


@register("xlsx_sheet_text", _XLSX_TEXT_SQL)
def q_xlsx_sheet_text(spark, sf):
    """Question-time text of each uploaded workbook: every sheet, every row."""
    from carelake.operators.context import sheets_to_text
    rows = XL.parse_xlsx(_xlsx_files(spark, sf))
    return sheets_to_text(rows.withColumnRenamed("path", "workbook")).withColumnRenamed("workbook", "path")



@register("extract_text", f"""
SELECT * FROM ({_XLSX_TEXT_SQL})
UNION ALL SELECT * FROM ({_DOCX_TEXT_SQL})
UNION ALL SELECT 'uploads/docs/' || CAST(doc_id AS VARCHAR) || '.' || coalesce(lang, 'txt') AS path, coalesce(text, '') AS text FROM documents""")
def q_extract_text(spark, sf):
    """A mixed upload set -- workbooks, documents and text files with other
    extensions -- turned into text by one dispatching job."""
    from carelake.sources.extract import extract_text
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("uploads/docs/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("txt"))).alias("path"),
        F.encode("text", "UTF-8").alias("content"))
    files = _xlsx_files(spark, sf).unionByName(_docx_files(spark, sf)).unionByName(docs)
    return extract_text(files)


_QUESTION_DOCS_SQL = f"""
SELECT 'workbooks' AS request_id, * FROM ({_XLSX_TEXT_SQL})
UNION ALL SELECT 'chat ' || CAST(CAST(regexp_extract(path, 'conv-([0-9]+)-', 1) AS BIGINT) % 50 AS VARCHAR), * FROM ({_DOCX_TEXT_SQL})
UNION ALL SELECT coalesce(lang, 'txt') || ' ' || CAST(doc_id % 40 AS VARCHAR),
  'uploads/docs/' || CAST(doc_id AS VARCHAR) || '.' || coalesce(lang, 'txt'), coalesce(text, '') FROM documents"""


@register("question_context", f"""
WITH d AS MATERIALIZED ({_QUESTION_DOCS_SQL}),
r AS (SELECT *, CAST(regexp_extract_all(string_split(path, '/')[-1], '[0-9]+') AS BIGINT[]) AS nums,
        count(*) OVER (PARTITION BY request_id) AS n_files FROM d),
b AS (SELECT request_id, nums, n_files, repeat('=', 60) || chr(10) || 'FILE: ' || path || chr(10) || repeat('=', 60) || chr(10) ||
    CASE WHEN text IS NULL THEN '[Could not read this file]' WHEN length(text) > greatest(8000, 120000 // n_files)
         THEN left(text, CAST(greatest(8000, 120000 // n_files) AS BIGINT)) || chr(10) || '[... truncated ...]' ELSE text END AS block
  FROM r),
j AS (SELECT request_id, n_files, string_agg(block, chr(10) || chr(10) ORDER BY nums) AS full_text FROM b GROUP BY request_id, n_files)
SELECT request_id, n_files, length(full_text) AS full_length, CASE WHEN length(full_text) > 60000
  THEN left(full_text, 60000) || chr(10) || chr(10) || '[... file truncated for context length ...]' ELSE full_text END AS context
FROM j""")
def q_question_context(spark, sf):
    """A question over files, end to end: mixed uploads are extracted once, and each request gets the combined context
    of its files in the order of their numbers."""
    from carelake.operators.context import combined_context
    path = f"{scratch_dir(spark, 'question')}/texts"
    q_extract_text(spark, sf).write.parquet(path)
    docs = spark.read.parquet(path).withColumnRenamed("path", "key")
    conv = F.regexp_extract("key", "conv-([0-9]+)-", 1)
    name = F.element_at(F.split("key", "/"), -1)
    request = (F.when(F.col("key").startswith("uploads/xlsx/"), F.lit("workbooks"))
               .when(F.col("key").startswith("uploads/docx/"), F.concat(F.lit("chat "), (conv.cast("long") % 50).cast("string")))
               .otherwise(F.concat(F.split_part(name, F.lit("."), F.lit(2)), F.lit(" "),
                                   (F.split_part(name, F.lit("."), F.lit(1)).cast("long") % 40).cast("string"))))
    nums = F.regexp_extract_all(name, F.lit("([0-9]+)")).cast("array<long>")
    ord_ = F.element_at(nums, 1) * 1_000_000 + F.coalesce(F.try_element_at(nums, F.lit(2)), F.lit(0))
    return combined_context(docs.select(request.alias("request_id"), ord_.alias("ord"), "key"), docs)
