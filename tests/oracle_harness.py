"""Compare a registered Spark query with its DuckDB oracle the way the driver
does: same column names, same row count, same multiset of rows."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

from carelake.plans.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = bool(os.environ.get("ORACLE_STRICT"))


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v) if STRICT else round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bytes):
        return v.hex()
    return v


def rows_key(r):
    return tuple((0, "") if x is None else (1, repr(x)) for x in r)


def _spark_type(dt) -> str:
    s = dt.simpleString()
    simple = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
              "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
              "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE", "smallint": "SMALLINT",
              "tinyint": "TINYINT", "binary": "BLOB"}
    if s in simple:
        return simple[s]
    if s.startswith("decimal"):
        return s.upper()
    return s


def type_problems(spark_df, con, sql: str):
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    dtypes = {r[0]: r[1] for r in desc}
    out = []
    for f in spark_df.schema.fields:
        st = _spark_type(f.dataType)
        dt = dtypes.get(f.name)
        if dt is not None and st != dt:
            out.append(f"type {f.name}: spark={st} duck={dt}")
    return out


def compare(spark_df, con, sql: str, limit_show: int = 5):
    cols_s = spark_df.columns
    rows_s = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    cols_d = [d[0] for d in res.description]
    rows_d = res.fetchall()
    problems = []
    if sorted(cols_s) != sorted(cols_d):
        problems.append(f"columns differ: spark={cols_s} duck={cols_d}")
        return problems
    order = sorted(range(len(cols_s)), key=lambda i: cols_s[i])
    dorder = [cols_d.index(cols_s[i]) for i in order]
    ns = sorted((tuple(_norm(r[i]) for i in order) for r in rows_s), key=rows_key)
    nd = sorted((tuple(_norm(r[i]) for i in dorder) for r in rows_d), key=rows_key)
    problems += type_problems(spark_df, con, sql)
    if len(ns) != len(nd):
        problems.append(f"row count spark={len(ns)} duck={len(nd)}")
    diff = [(a, b) for a, b in zip(ns, nd) if a != b]
    if diff:
        problems.append(f"{len(diff)} differing rows; first: " + "; ".join(
            f"\n  spark={a}\n  duck ={b}" for a, b in diff[:limit_show]))
    return problems
