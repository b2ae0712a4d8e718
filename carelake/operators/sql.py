"""Ad-hoc SQL (SQL-1): register DataFrames as views and hand the text to Spark SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run ``sql`` with ``tables`` visible under their names (session-scoped
    temporary views; Catalyst plans the whole statement)."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
