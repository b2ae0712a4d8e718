"""Stream twins, each fed with time-ordered file drops derived from the driver
tables and run to completion with ``availableNow``; oracle = the batch twin's
SQL."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from carelake import functions as C
from carelake.operators import conversations as V
from carelake.operators.sql import query
from carelake.plans import derived as D
from carelake.plans.q_audit import _AUDIT_SQL, logs
from carelake.plans.q_outreach import _TIMELINE_SQL, _hist_cols
from carelake.plans.q_sources import _ORDER_COLS, _ORDERS_WITH_KEYS_SQL, _conform, _orders_keyed, put_files
from carelake.plans.registry import ORACLE, register
from carelake.plans.tables import table
from carelake.session import scratch_dir
from carelake.sinks.conversations import ItemStore
from carelake.sinks.versions import current_files, read_current, register_current_uploads
from carelake.sources.xlsx import build_xlsx
from carelake.streaming import inbound as SI
from carelake.streaming import login as SL
from carelake.streaming.common import latest, run_available_now, stream_parquet, write_time_chunks
from carelake.streaming.ingest import backfill, ingest_stream

CHUNKS = 3
CHUNK_ROWS = 5_000_000   # a replayed micro-batch holds about so many rows at most


def _replay(spark, df, ts, root, key) -> int:
    """Write ``df`` as time-ordered chunks of several files; -> files of a chunk, the size of a micro-batch."""
    files = _state_partitions(spark)
    write_time_chunks(df, ts, root, max(CHUNKS, -(-df.count() // CHUNK_ROWS)), files, key)
    return files


def _state_partitions(spark) -> int:
    """State partitions for a new stateful query: one per core of the cluster."""
    return max(8, spark.sparkContext.defaultParallelism)


@register("stream_inbound", f"""
WITH {_TIMELINE_SQL},
hn AS (SELECT phone_number, count(*) AS n FROM conv_msgs GROUP BY 1),
run AS (SELECT a.*, s.reply_count AS stored, s.opt_out AS stored_flag, coalesce(hn.n, 0) AS h,
    count(*) FILTER (WHERE action = 'reply' AND sent) OVER w AS n,
    last_value(CASE command WHEN 'stop' THEN true WHEN 'start' THEN false END IGNORE NULLS) OVER w AS flag
  FROM act a LEFT JOIN conv_items s ON s.phone_number = a.phone LEFT JOIN hn ON hn.phone_number = a.phone
  WINDOW w AS (PARTITION BY a.phone ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT msg_id, phone, command, action,
  CAST(CASE WHEN n = 0 THEN stored ELSE coalesce(stored, 0) + n END AS INTEGER) AS reply_count,
  coalesce(flag, stored_flag) AS opt_out, CAST(least(20, h + 2 * n) AS INTEGER) AS history_size
FROM run""")
def q_stream_inbound(spark, sf):
    root = scratch_dir(spark, "inbound-stream")
    src = D.inbound(spark, sf)
    files = _replay(spark, src, "ts", f"{root}/in", C.pystrip(F.coalesce("phone", F.lit(""))))
    # The stored conversations are a table: materialised once, not re-derived per micro-batch.
    D.conversation_items(spark, sf).write.parquet(f"{root}/convs")
    convs = spark.read.parquet(f"{root}/convs")
    out = SI.inbound_stream(stream_parquet(spark, f"{root}/in", src.schema, files), convs)
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ckpt",
                      spark, _state_partitions(spark))
    return spark.read.schema(SI.OUTPUT_SCHEMA).parquet(f"{root}/out")


def _late_stream(spark, sf):
    """Every fifth message arrives three days late; -> (folder of the messages' outcomes, store of the items)."""
    root = scratch_dir(spark, "late-stream")
    src = D.inbound(spark, sf)
    arrival = F.col("ts") + F.when(F.col("msg_id") % 5 == 0, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    files = _replay(spark, src.withColumn("arrival", arrival), "arrival", f"{root}/in", C.pystrip(F.coalesce("phone", F.lit(""))))
    convs = D.conversation_items(spark, sf)
    convs = convs.select(*[F.col(c) if c in convs.columns else F.lit(None).cast("string").alias(c) for c in V.CONV_COLUMNS])
    store = ItemStore(spark, f"{root}/items")
    store.start(convs)

    def merge(changes, batch_id: int) -> None:
        changes = changes.persist()   # read for the items and for the messages
        store.merge(latest(SI.item_rows(changes), ["phone_number"]).select(*V.CONV_COLUMNS), batch_id)
        SI.message_rows(changes).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        changes.unpersist()
    out = SI.inbound_changes(stream_parquet(spark, f"{root}/in", src.schema, files), store.read(), "5 days")
    run_available_now(out.writeStream.foreachBatch(merge), f"{root}/ckpt", spark, _state_partitions(spark))
    return f"{root}/out", store


@register("stream_inbound_late", ORACLE["stream_inbound"])
def q_stream_inbound_late(spark, sf):
    """Messages that arrive three days late act at their own time, as in the batch."""
    out, _ = _late_stream(spark, sf)
    return latest(spark.read.parquet(out).drop("batch"), ["msg_id"]).drop("rec", "revision")


@register("stream_items", ORACLE["fold_conversations"])
def q_stream_items(spark, sf):
    """The stored items as the stream leaves them, late messages and all."""
    _, store = _late_stream(spark, sf)
    return store.read().select("phone_number", "patient_name", "amount_due", "message_type", "reply_count", "opt_out",
                               "last_inbound_message", *_hist_cols())


@register("stream_login", _AUDIT_SQL + " SELECT * FROM audit")
def q_stream_login(spark, sf):
    root = scratch_dir(spark, "login-stream")
    issues, attempts = logs(spark, sf)
    ev = SL.login_events(issues, attempts)
    files = _replay(spark, ev, "t", f"{root}/in", C.normalize_email(F.coalesce("email", F.lit(""))))
    out = SL.login_stream(stream_parquet(spark, f"{root}/in", ev.schema, files))
    run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ckpt",
                      spark, _state_partitions(spark))
    return spark.read.schema(SL.OUTPUT_SCHEMA).parquet(f"{root}/out")


@register("stream_ingest", _ORDERS_WITH_KEYS_SQL)
def q_stream_ingest(spark, sf):
    root = scratch_dir(spark, "ingest-stream")
    (_orders_keyed(spark, sf).hint("rebalance", "user_id", "year", "month").sortWithinPartitions("o_orderkey")
     .write.option("header", "true").partitionBy("user_id", "year", "month").csv(f"{root}/uploads"))
    ingest_stream(spark, f"{root}/uploads", f"{root}/lake", f"{root}/ckpt")
    lake = read_current(spark, f"{root}/lake", "csv")
    return _conform(lake.select(*_ORDER_COLS, "user_id", "year", "month"), spark, sf)


@register("ingest_uploads", """
SELECT 'u' || CAST(o_custkey % 4 AS VARCHAR) AS user_id, strftime(o_orderdate, '%Y') AS year, count(*) AS n_rows,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM orders WHERE strftime(o_orderdate, '%Y') >= '1995' GROUP BY ALL""")
def q_ingest_uploads(spark, sf):
    """CSV uploads are ingested into the ``uploads`` table, ingested again (which replaces them), and queried with a
    partition predicate."""
    root = scratch_dir(spark, "ingest-uploads")
    (_orders_keyed(spark, sf).withColumn("month", F.lit("06")).hint("rebalance", "user_id", "year", "month")
     .write.option("header", "true").partitionBy("user_id", "year", "month").csv(f"{root}/uploads"))
    for _ in range(2):
        backfill(spark, f"{root}/uploads", f"{root}/lake", force=True, uploads_root=f"{root}/table")
    name = f"uploads_{root.rsplit('-', 1)[-1]}"
    register_current_uploads(spark, f"{root}/table", f"{root}/lake", table=name)
    return query(spark, f"""
        SELECT user_id, year, count(*) AS n_rows,
          CAST(sum(CAST(get_json_object(content, '$.o_totalprice') AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
        FROM {name} WHERE year >= '1995' GROUP BY user_id, year""")


@register("backfill_ingest", f"""
SELECT * FROM ({_ORDERS_WITH_KEYS_SQL})
UNION ALL
SELECT * REPLACE ('2030' AS year) FROM ({_ORDERS_WITH_KEYS_SQL})""")
def q_backfill_ingest(spark, sf):
    """Half of the uploads are converted first (by the stream); the batch
    backfill must then convert exactly the rest."""
    root = scratch_dir(spark, "backfill")
    (_orders_keyed(spark, sf).hint("rebalance", "user_id", "year", "month").sortWithinPartitions("o_orderkey")
     .write.option("header", "true").partitionBy("user_id", "year", "month").csv(f"{root}/uploads"))
    ingest_stream(spark, f"{root}/uploads", f"{root}/lake", f"{root}/ckpt")
    # New month folders arrive after the first conversion.
    extra = _orders_keyed(spark, sf).withColumn("year", F.lit("2030"))
    (extra.hint("rebalance", "user_id", "year", "month").sortWithinPartitions("o_orderkey")
     .write.mode("append").option("header", "true").partitionBy("user_id", "year", "month").csv(f"{root}/uploads"))
    backfill(spark, f"{root}/uploads", f"{root}/lake")
    lake = read_current(spark, f"{root}/lake", "csv")
    return _conform(lake.select(*_ORDER_COLS, "user_id", "year", "month"), spark, sf)


_ORDER_FILES_SQL = """
o AS (SELECT 'u' || CAST(o_custkey % 4 AS VARCHAR) AS u, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m,
        CAST(o_orderkey // 1000000 AS VARCHAR) AS b, o_totalprice FROM orders),
f AS (SELECT 'user_id=' || u || '/year=' || y || '/month=' || m || '/' ||
        CASE CAST(m AS INTEGER) % 3 WHEN 0 THEN '_' || b || '_.csv' WHEN 1 THEN '.' || b || '.CSV' ELSE 'o ' || b || '.csv' END AS key,
        count(*) AS n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
      FROM o GROUP BY u, y, m, b),
e AS (SELECT DISTINCT 'user_id=' || u || '/year=' || y || '/month=01/_void_.csv' AS key FROM o),
all_ AS (SELECT key, 'converted' AS status, n_rows, total FROM f
         UNION ALL SELECT key, 'placeholder', 0, NULL FROM e)"""


@register("ingest_every_upload", f"""
WITH {_ORDER_FILES_SQL}
SELECT 'stream' AS by_, * FROM all_ UNION ALL SELECT 'backfill' AS by_, * FROM all_""")
def q_ingest_every_upload(spark, sf):
    """Orders as one CSV per user, month and million of keys, two thirds of them under names that Spark's readers skip, and a
    file without bytes per user and year: the ingest stream and the backfill convert the same files into the same rows."""
    root = scratch_dir(spark, "every-upload")
    # Rows are grouped by numbers and dates; the texts of names and folders are made once a file.
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_custkey") % 4).alias("u"),
                                          F.trunc("o_orderdate", "month").alias("since"), F.expr("o_orderkey div 1000000").alias("b"))
    user, year, month = F.concat(F.lit("u"), F.col("u").cast("string")), F.date_format("since", "yyyy"), F.date_format("since", "MM")
    folder = F.concat(F.lit(f"{root}/uploads/user_id="), user, F.lit("/year="), year)
    third = month.cast("int") % 3
    name = (F.when(third == 0, F.format_string("_%d_.csv", "b")).when(third == 1, F.format_string(".%d.CSV", "b"))
            .otherwise(F.format_string("o %d.csv", "b")))
    lines = (o.withColumn("line", F.concat_ws(",", "o_orderkey", "o_custkey", "o_totalprice")).groupBy("u", "since", "b")
             .agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY o_orderkey)").alias("text")))
    files = lines.select(F.concat(folder, F.lit("/month="), month, F.lit("/"), name).alias("path"),
                         F.concat(F.lit("o_orderkey,o_custkey,o_totalprice\n"), "text", F.lit("\n")).cast("binary").alias("content"))
    years = o.select("u", F.trunc("since", "year").alias("since")).distinct()
    void = years.select(F.concat(folder, F.lit("/month=01/_void_.csv")).alias("path"), F.lit(b"").alias("content"))
    put_files(files.unionByName(void))
    # Two lakes of their own: one fills the cores that the other's listings, commits and last tasks leave free.
    side = inheritable_thread_target(spark)
    with ThreadPoolExecutor(2) as pool:
        both = [pool.submit(side(ingest_stream), spark, f"{root}/uploads", f"{root}/stream", f"{root}/ckpt"),
                pool.submit(side(backfill), spark, f"{root}/uploads", f"{root}/backfill")]
    for one in both:
        one.result()
    out = []
    for by in ("stream", "backfill"):
        rows = read_current(spark, f"{root}/{by}", "csv").groupBy(F.col("_source_key").alias("key")).agg(
            F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
        files = current_files(spark, f"{root}/{by}").select("key", "status")
        out.append(files.join(rows, "key", "left").select(F.lit(by).alias("by_"), "key", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "total"))
    return out[0].unionByName(out[1])


_BOOK_HEADER = ["Customer Key", "Balance", "Active", "Since", "Code", "Note", "Month", "month"]
_BOOK_ROWS = 1000   # customers of a workbook: files stay bounded at any scale


@register("ingest_workbooks", """
SELECT CAST(c_custkey AS BIGINT) AS customer_key, CAST(c_acctbal AS DOUBLE) AS balance, c_custkey % 2 = 0 AS active,
  CASE WHEN c_custkey % 9 <> 0 THEN CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS DATE) END AS since,
  lpad(CAST(c_custkey % 100 AS VARCHAR), 4, '0') AS code,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'n' || CAST(c_custkey AS VARCHAR) END AS note,
  CAST(c_custkey % 12 + 1 AS BIGINT) AS own_month, CAST(NULL AS VARCHAR) AS second_month,
  'bigint,double,boolean,timestamp,string,string,bigint,string' AS types,
  'u' || CAST(c_nationkey % 4 AS VARCHAR) AS user_id, '06' AS month,
  'book ' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey // 1000 AS VARCHAR) || '.xlsx' AS file_name
FROM customer""")
def q_ingest_workbooks(spark, sf):
    """Customers as workbooks (one per nation and thousand keys), converted by the backfill: types come from the cells, text
    that looks like numbers stays text, columns of mixed cells are text, and own columns named like a partition are kept."""
    root = scratch_dir(spark, "workbooks")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("balance"),
                                            F.floor(F.col("c_custkey") / _BOOK_ROWS).alias("b"))

    def build(pdf):
        rows: list[list] = [_BOOK_HEADER]
        for k, balance in zip(pdf.c_custkey.tolist(), pdf.balance.tolist()):
            since = datetime.date(2020, 1, 1) + datetime.timedelta(days=k % 1000) if k % 9 else None
            rows.append([k, balance, k % 2 == 0, since, f"{k % 100:04d}", k if k % 2 == 0 else f"n{k}", k % 12 + 1, None])
        nation, b = int(pdf.c_nationkey.iloc[0]), int(pdf.b.iloc[0])
        path = f"{root}/uploads/user_id=u{nation % 4}/year=2026/month=06/book {nation}-{b}.xlsx"
        return pd.DataFrame({"path": [path], "content": [build_xlsx([("Customers", rows)], shared_strings=b % 2 == 0)]})
    put_files(c.groupBy("c_nationkey", "b").applyInPandas(build, "path string, content binary"))
    backfill(spark, f"{root}/uploads", f"{root}/lake")
    lake = read_current(spark, f"{root}/lake", "xlsx")
    own = ["Customer_Key", "Balance", "Active", "Since", "Code", "Note", "Month_2", "month_3"]
    return lake.select(F.col("Customer_Key").alias("customer_key"), F.col("Balance").alias("balance"), F.col("Active").alias("active"),
                       F.col("Since").cast("date").alias("since"), F.col("Code").alias("code"), F.col("Note").alias("note"),
                       F.col("Month_2").alias("own_month"), F.col("month_3").alias("second_month"),
                       F.concat_ws(",", *[F.typeof(n) for n in own]).alias("types"), "user_id", "month", F.col("_filename").alias("file_name"))
