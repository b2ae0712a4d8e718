"""Keyed upsert of conversation items: whole-item replace or field-wise merge of
two tables, and a store that a stream's micro-batches are merged into."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str = "phone_number",
           mode: str = "replace", fields: Sequence[str] | None = None) -> DataFrame:
    """New table = ``current`` with ``changes`` applied per key.

    * ``replace``: a changed key's item is the change row, whole.
    * ``merge``: only the non-null fields of the change overwrite; a key that
      does not exist yet is created from the change row.

    ``changes`` must hold at most one row per key (see ``latest_per_phone``).
    """
    if mode == "replace":
        kept = current.join(changes.select(key), on=key, how="left_anti")
        return kept.unionByName(changes, allowMissingColumns=True)
    if mode != "merge":
        raise ValueError(mode)
    cols = [c for c in (fields or current.columns) if c != key]
    cur = current.select(key, *[F.col(c).alias(f"_cur_{c}") for c in cols])
    chg = changes.select(key, *[F.col(c).alias(f"_chg_{c}") if c in changes.columns
                                else F.lit(None).alias(f"_chg_{c}") for c in cols])
    j = cur.join(chg, on=key, how="full_outer")
    return j.select(key, *[F.coalesce(F.col(f"_chg_{c}"), F.col(f"_cur_{c}")).alias(c) for c in cols])


class ItemStore:
    """Items by key in versioned folders: a micro-batch adds one folder with the items that it changed, and one
    commit that names the folders that count, the latest first.

    A batch that is run again finds its commit and does nothing; one that died
    before it writes its folder anew.  Readers see a batch as a whole or not
    at all.  When ``most`` folders count, the next batch writes all items into one.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "phone_number", most: int = 8):
        self.spark, self.root, self.key, self.most = spark, root.rstrip("/"), key, most
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str]:
        found = self._fs.globStatus(self._path(f"{self.root}/commits/[0-9]*.json")) or []
        return {int(s.getPath().getName()[:-5]): s.getPath().toString() for s in found}

    def folders(self) -> list[str]:
        """The folders that count, the latest first."""
        commits = self._commits()
        if not commits:
            return []
        lines = self.spark.read.text(commits[max(commits)], wholetext=True).first()[0]
        return json.loads(lines)["folders"]

    def _commit(self, batch: int, folders: list[str]) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        staged = self._path(f"{self.root}/commits/.{batch:012d}.json")
        out = self._fs.create(staged, True)
        out.write(json.dumps({"folders": folders}).encode())
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.root}/commits/{batch:012d}.json")):
            raise OSError(f"could not commit batch {batch}")

    def _latest(self, folders: list[str]) -> DataFrame:
        """One row per key, that of the first folder that has it; a sum of groups, so a key's rows never sort in a task."""
        parts = [self.spark.read.parquet(f"{self.root}/{f}").withColumn("_age", F.lit(i)) for i, f in enumerate(folders)]
        if len(parts) == 1:
            return parts[0].drop("_age")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in (self.key, "_age")]
        return rows.groupBy(self.key).agg(F.min_by(F.struct(*rest), "_age").alias("_r")).select(self.key, "_r.*")

    def read(self) -> DataFrame:
        return self._latest(self.folders())

    def start(self, items: DataFrame) -> None:
        """The items before the first batch."""
        if not self._commits():
            items.write.mode("overwrite").parquet(f"{self.root}/version=start")
            self._commit(0, ["version=start"])

    def merge(self, changed: DataFrame, batch_id: int) -> bool:
        """Take in the changed items of micro-batch ``batch_id`` (one row per key); False if that has been done."""
        batch = batch_id + 1   # 0 is the start
        if batch in self._commits():
            return False
        before, folder = self.folders(), f"version={batch:012d}"
        if len(before) < self.most:
            changed.write.mode("overwrite").parquet(f"{self.root}/{folder}")
            self._commit(batch, [folder, *before])
            return True
        changed.write.mode("overwrite").parquet(f"{self.root}/{folder}-changed")
        self._latest([f"{folder}-changed", *before]).write.mode("overwrite").parquet(f"{self.root}/{folder}")
        self._commit(batch, [folder])
        return True

    def sweep(self) -> int:
        """Delete the folders that don't count any more; not while readers of older commits are at work."""
        needed = set(self.folders())
        gone = [s.getPath() for s in self._fs.globStatus(self._path(f"{self.root}/version=*")) or [] if s.getPath().getName() not in needed]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
