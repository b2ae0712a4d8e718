"""Workbooks with inferred types from a single read (SRC-2).

A cell says itself what it is, so types come from cells and not from the look of their texts: ``007`` typed as text stays
text.  The rows of all files are read once into columnar scratch files, a folder per header; a partial aggregate over the
cells' masks gives every column of every header the meet of its cells' types, and the typed rows are casts of the scratch
files.  Whole numbers are ``bigint``, others ``double``, dates ``timestamp``; columns of different kinds, times of day and columns
without values are text.  Blank cells and empty texts fit every type, and so do errors (``#N/A``), which are null where the
column isn't text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.session import scratch_dir
from carelake.sources.xlsx import CELL_SCHEMA, CELL_TYPES, read_first_sheets


@dataclass
class Sheets:
    """Workbooks of one header: ``rows`` has ``_path``, ``_row`` (from 1) and the sheet's own columns, ``names``."""

    paths: list[str]
    names: list[str]
    rows: DataFrame


def column_names(header: Sequence[str | None], reserved: Sequence[str] = ()) -> list[str]:
    """Header cells -> Parquet-safe column names (blank -> ``_cN``) that differ from each other and from ``reserved`` in more
    than case; a number makes them differ."""
    named = [re.sub(r"[ ,;{}()\n\t=]+", "_", (h or "").strip()) or f"_c{i}" for i, h in enumerate(header, start=1)]
    out, used, own = [], {r.lower() for r in reserved}, {n.lower() for n in named}
    for base in named:
        name, k = base, 1
        while name.lower() in used or (k > 1 and name.lower() in own):
            k += 1
            name = f"{base}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def kind_of(mask: int | None) -> str:
    """The type of a column whose cells' masks meet in ``mask`` (None: no values)."""
    return next((kind for i, kind in enumerate(CELL_TYPES) if (mask or 0) >> i & 1), "string")


@contextmanager
def read_sheets_once(spark: SparkSession, paths: Sequence[str], reserved: Sequence[str] = (), **dealing) -> Iterator[list[Sheets]]:
    """The first sheets of workbooks, first row as header, by header.

    Files that can't be read are in no group.  Own columns named like one of ``reserved`` get a number.  The rows may
    be used any number of times until this is left, when the scratch files go.  The driver gets the files' headers and a
    mask a column.
    """
    folder = scratch_dir(spark, "sheets-once")
    shape = T.StructType([*CELL_SCHEMA.fields, T.StructField("_head", T.StringType())])
    cells = read_first_sheets(spark, paths, **dealing)
    cells.withColumn("_head", F.sha2(F.to_json("header"), 256)).write.mode("append").partitionBy("_head").parquet(folder)
    staged = spark.read.schema(shape).parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        heads: dict[str, tuple[list, list[str]]] = {}
        for r in staged.where("row_index = header_row").select("path", "header", "_head").collect():
            heads.setdefault(r["_head"], (list(r["header"]), []))[1].append(r["path"])
        masks = {(r["_head"], r["pos"]): r["mask"] for r in staged.where("row_index > header_row")
                 .select("_head", F.posexplode("masks").alias("pos", "mask")).groupBy("_head", "pos").agg(F.bit_and("mask").alias("mask")).collect()}
        found = []
        for head, (header, files) in sorted(heads.items()):
            names = column_names(header, ["_path", "_row", *reserved])
            body = staged.where((F.col("_head") == head) & (F.col("row_index") > F.col("header_row")))
            columns = []
            for i, name in enumerate(names):
                text, kind = F.try_element_at("cells", F.lit(i + 1)), kind_of(masks.get((head, i)))
                columns.append((text if kind == "string" else F.when(text != "", text).try_cast(kind)).alias(name))
            found.append(Sheets(sorted(files), names, body.select(F.col("path").alias("_path"), (F.col("row_index") - F.col("header_row")).alias("_row"), *columns)))
        yield found
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def signature(values: Sequence[str]) -> str:
    """A short name for a list of texts."""
    return hashlib.sha256("\x1f".join(values).encode()).hexdigest()[:16]
