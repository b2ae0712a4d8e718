"""Document text decoding, single/combined contexts and workbook text."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions.text import make_valid_text
from carelake.operators import context as X
from carelake.plans.registry import register
from carelake.plans.tables import table

_NL = "chr(10)"


@register("utf8_text", """
SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || '�' ELSE text END AS text FROM documents""")
def q_utf8_text(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.encode("text", "UTF-8")
    # Every 7th file ends in a cut 3-byte sequence, as a truncated upload would.
    content = F.when(F.col("doc_id") % 7 == 3, F.concat(raw, F.unhex(F.lit("E282")))).otherwise(raw)
    return d.select("doc_id", make_valid_text(content).alias("text"))


@register("single_context", f"""
SELECT doc_id, CASE WHEN length(text) > 60000
  THEN left(text, 60000) || {_NL} || {_NL} || '[... file truncated for context length ...]' ELSE text END AS context
FROM documents""", headline=True)
def q_single_context(spark, sf):
    d = table(spark, sf, "documents")
    return X.file_context(d, "text").select("doc_id", "context")


@register("single_context_cut", f"""
SELECT doc_id, CASE WHEN length(text) > 500
  THEN left(text, 500) || {_NL} || {_NL} || '[... file truncated for context length ...]' ELSE text END AS context
FROM documents""")
def q_single_context_cut(spark, sf):
    """The single-file context with a limit that most documents exceed."""
    return X.file_context(table(spark, sf, "documents"), "text", limit=500).select("doc_id", "context")


_KEY = "'documents/' || CAST(doc_id AS VARCHAR) || '.txt'"


@register("combined_context", f"""
WITH r AS (SELECT quality * 2 + toxic AS request_id, doc_id AS ord, {_KEY} AS key FROM labels),
n AS (SELECT request_id, count(*) AS n_files FROM r GROUP BY request_id),
d AS (SELECT {_KEY} AS key, text FROM documents),
b AS (
  SELECT r.request_id, r.ord, n.n_files,
    repeat('=', 60) || {_NL} || 'FILE: ' || r.key || {_NL} || repeat('=', 60) || {_NL} ||
    CASE WHEN d.text IS NULL THEN '[Could not read this file]'
         WHEN length(d.text) > greatest(8000, 120000 // n.n_files)
         THEN left(d.text, CAST(greatest(8000, 120000 // n.n_files) AS BIGINT)) || {_NL} || '[... truncated ...]'
         ELSE d.text END AS block
  FROM r JOIN n USING (request_id) LEFT JOIN d USING (key)),
j AS (SELECT request_id, n_files, string_agg(block, {_NL} || {_NL} ORDER BY ord) AS full_text
      FROM b GROUP BY request_id, n_files)
SELECT request_id, n_files, length(full_text) AS full_length,
  CASE WHEN length(full_text) > 60000
       THEN left(full_text, 60000) || {_NL} || {_NL} || '[... file truncated for context length ...]'
       ELSE full_text END AS context
FROM j""", headline=True)
def q_combined_context(spark, sf):
    lab = table(spark, sf, "labels")
    key = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    requests = lab.select((F.col("quality") * 2 + F.col("toxic")).alias("request_id"),
                          F.col("doc_id").alias("ord"), key.alias("key"))
    docs = table(spark, sf, "documents").select(key.alias("key"), "text")
    return X.combined_context(requests, docs)


@register("context_parts", f"""
WITH r AS (SELECT quality * 2 + toxic AS request_id, doc_id AS ord, {_KEY} AS key FROM labels),
n AS (SELECT request_id, count(*) AS n_files FROM r GROUP BY request_id),
d AS (SELECT {_KEY} AS key, text FROM documents),
b AS (
  SELECT r.request_id, r.ord, r.ord = max(r.ord) OVER (PARTITION BY r.request_id) AS is_last,
    repeat('=', 60) || {_NL} || 'FILE: ' || r.key || {_NL} || repeat('=', 60) || {_NL} ||
    CASE WHEN d.text IS NULL THEN '[Could not read this file]'
         WHEN length(d.text) > greatest(8000, 120000 // n.n_files)
         THEN left(d.text, CAST(greatest(8000, 120000 // n.n_files) AS BIGINT)) || {_NL} || '[... truncated ...]'
         ELSE d.text END AS block
  FROM r JOIN n USING (request_id) LEFT JOIN d USING (key)),
s AS (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY request_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM b)
SELECT request_id, CAST(st // 60000 AS BIGINT) AS part, CAST(min(st) AS BIGINT) AS start,
  string_agg(block || CASE WHEN is_last THEN '' ELSE {_NL} || {_NL} END, '' ORDER BY ord) AS context
FROM s GROUP BY request_id, st // 60000""")
def q_context_parts(spark, sf):
    """The whole contexts of the same requests, as parts of some 60,000 characters."""
    lab = table(spark, sf, "labels")
    key = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    requests = lab.select((F.col("quality") * 2 + F.col("toxic")).alias("request_id"), F.col("doc_id").alias("ord"), key.alias("key"))
    return X.combined_context_parts(requests, table(spark, sf, "documents").select(key.alias("key"), "text"))


@register("sheet_text", f"""
WITH lines AS (
  SELECT r_regionkey AS sheet_idx, -1 AS line_no, '=== Sheet: ' || r_name || ' ===' AS line FROM region
  UNION ALL
  SELECT n_regionkey, n_nationkey,
    CAST(n_nationkey AS VARCHAR) || chr(9) || coalesce(n_name, '') || chr(9) || CAST(n_regionkey AS VARCHAR)
  FROM nation)
SELECT 'nations.xlsx' AS workbook, string_agg(line, {_NL} ORDER BY sheet_idx, line_no) AS text FROM lines""")
def q_sheet_text(spark, sf):
    """A workbook with one sheet per region; each nation is a row of that sheet."""
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    cells = (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.lit("nations.xlsx").alias("workbook"), F.col("r_name").alias("sheet"),
                     F.col("r_regionkey").alias("sheet_idx"), F.col("n_nationkey").alias("row_index"),
                     F.array(F.col("n_nationkey").cast("string"), F.col("n_name"),
                             F.col("n_regionkey").cast("string")).alias("cells")))
    # Regions without nations still get their header line.
    heads = r.select(F.lit("nations.xlsx").alias("workbook"), F.col("r_name").alias("sheet"),
                     F.col("r_regionkey").alias("sheet_idx"))
    lines = X.sheet_lines(cells).unionByName(
        heads.select("workbook", "sheet_idx", F.lit(-1).cast("long").alias("line_no"),
                     F.format_string(X.SHEET_HEADER, F.col("sheet")).alias("line"))).distinct()
    return (lines.groupBy("workbook")
            .agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY sheet_idx, line_no)").alias("text")))
