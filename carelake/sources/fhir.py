"""FHIR resources stored as newline-delimited JSON, one folder per type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
PATIENT_SCHEMA = T.StructType([
    T.StructField("resourceType", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.ArrayType(T.StructType([
        T.StructField("family", T.StringType()),
        T.StructField("given", T.ArrayType(T.StringType()))]))),
    T.StructField("birthDate", T.StringType()),
    T.StructField(CORRUPT, T.StringType()),
])

_PREFIX_OPS = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "lt": "__lt__", "ge": "__ge__", "le": "__le__"}


def read_fhir(spark: SparkSession, root: str, resource: str = "Patient",
              schema: T.StructType = PATIENT_SCHEMA) -> DataFrame:
    """Resources of one type; malformed lines land in ``_corrupt_record``."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(f"{root.rstrip('/')}/{resource}"))


def valid(df: DataFrame, resource: str = "Patient") -> DataFrame:
    return df.where(F.col(CORRUPT).isNull() & (F.col("resourceType") == resource))


def flatten_patients(df: DataFrame) -> DataFrame:
    """One row per patient name (a patient without a name keeps one row)."""
    return (valid(df)
            .select("id", F.to_date("birthDate").alias("birth_date"),
                    F.posexplode_outer("name").alias("name_idx", "_n"))
            .select("id", F.col("name_idx").cast("int").alias("name_idx"),
                    F.col("_n.family").alias("family"), F.array_join("_n.given", " ").alias("given"),
                    "birth_date"))


def fhir_search(df: DataFrame, **params: str) -> DataFrame:
    """Patient search: ``birthdate`` (with eq/ne/gt/lt/ge/le prefix),
    ``family``, ``given`` (name parts, case-insensitive starts-with) and ``_id``."""
    out = valid(df).withColumn("birth_date", F.to_date("birthDate"))
    for k, v in params.items():
        if k == "birthdate":
            op, val = (v[:2], v[2:]) if v[:2] in _PREFIX_OPS else ("eq", v)
            out = out.where(getattr(F.col("birth_date"), _PREFIX_OPS[op])(F.to_date(F.lit(val))))
        elif k in ("family", "given"):
            field = F.col("name.family") if k == "family" else F.flatten(F.col("name.given"))
            out = out.where(F.exists(field, lambda x: F.startswith(F.lower(x), F.lit(v.lower()))))
        elif k == "_id":
            out = out.where(F.col("id") == v)
        else:
            raise ValueError(f"unsupported search parameter {k}")
    return out


def corrupt_records(df: DataFrame) -> DataFrame:
    """Lines that did not parse (quarantine).  Selected together with ``id``:
    Spark refuses queries that reference only the corrupt-record column."""
    return df.where(F.col(CORRUPT).isNotNull()).select("id", CORRUPT)
