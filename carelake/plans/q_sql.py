"""SQL-1 conformance set: joins (semi/anti), rollup/cube, windows, set
operations, distinct and top-k, plus SQL over the long-form ``uploads`` rows.
The same text runs on Spark and on the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators.sql import query
from carelake.plans.registry import register
from carelake.plans.tables import table
from carelake.session import scratch_dir
from carelake.sinks.lake import register_uploads, to_uploads, write_lake


def _views(spark, sf, *names):
    return {n: table(spark, sf, n) for n in names}


def _same(name, sql, *tables, headline=False):
    @register(name, sql, headline=headline)
    def run(spark, sf):
        return query(spark, sql, _views(spark, sf, *tables))
    run.__name__ = f"q_{name}"
    return run


_same("sql_join_semi_anti", """
SELECT 'semi' AS kind, c_custkey, c_nationkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL
SELECT 'anti' AS kind, c_custkey, c_nationkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""", "customer", "orders")

_same("sql_rollup", """
SELECT r.r_name, n.n_name, count(*) AS n_customers,
  CAST(sum(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS balance,
  CAST(grouping(n.n_name) AS INTEGER) AS g_nation
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY ROLLUP (r.r_name, n.n_name)""", "customer", "nation", "region")

_same("sql_cube", """
SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""", "lineitem", headline=True)

_same("sql_window", """
SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS running_total,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS price_rank
FROM orders""", "orders", headline=True)

_same("sql_setops", """
SELECT * FROM (SELECT o_custkey AS custkey FROM orders
               INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000) a
UNION ALL
SELECT * FROM (SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders) b""",
      "customer", "orders")

_same("sql_distinct", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS orders_n
FROM orders GROUP BY o_orderpriority""", "orders")

_same("sql_topk", """
SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue
FROM orders GROUP BY o_custkey ORDER BY revenue DESC, o_custkey LIMIT 10""", "orders")

_same("sql_topk_per_group", """
SELECT c_nationkey, c_custkey, c_acctbal FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r
  FROM customer) t
WHERE r <= 3""", "customer")


@register("sql_uploads", """
SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n_rows,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM orders WHERE strftime(o_orderdate, '%Y') >= '1995' GROUP BY 1""")
def q_sql_uploads(spark, sf):
    """Ad-hoc SQL over the ``uploads`` catalog table (row content is JSON text),
    with a partition predicate the scan prunes on."""
    year = F.date_format("o_orderdate", "yyyy")   # one upload a year
    o = table(spark, sf, "orders").withColumns({
        "_source_key": F.concat(F.lit("uploads/user_id=u0/year="), year, F.lit("/month=06/orders.csv")), "_filename": F.lit("orders.csv"),
        "user_id": F.lit("u0"), "year": year, "month": F.lit("06")})
    root = scratch_dir(spark, "sql-uploads")
    write_lake(to_uploads(o, uploaded_at=F.lit("2026-06-01 00:00:00")), root)
    name = f"uploads_{root.rsplit('-', 1)[-1]}"
    register_uploads(spark, root, table=name)
    return query(spark, f"""
        SELECT substr(get_json_object(content, '$.o_orderdate'), 1, 4) AS year, count(*) AS n_rows,
          CAST(sum(CAST(get_json_object(content, '$.o_totalprice') AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
        FROM {name} WHERE user_id = 'u0' AND year >= '1995' GROUP BY 1""")
