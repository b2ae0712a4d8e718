"""State of many keys in one call of a streaming step.

``applyInPandasWithState`` builds data frames for every group it calls (a column at a time, for rows, result and state), which
costs milliseconds however few rows a key has.  Here a group is one of ``GROUPS`` hash buckets of keys: its rows come as
one text each, and its state holds a text a key, of which only those with news or a due timer are opened.  The fold still
sees one key at a time and has state and timer of its own for each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

GROUPS = 1 << 12      # buckets of keys; a stream keeps the number that its checkpoint began with
RESULT_ROWS = 10_000  # rows of a result frame
STATE_SCHEMA = "keys array<string>, due array<bigint>, states array<string>"

#: (key, rows, state, watermark in ms, timed out) -> (results, state or None to forget the key, time of its timer in ms or None)
Fold = Callable[[str, list[dict], object, int | None, bool], tuple[list[tuple], object, int | None]]


def _frame(rows: list[tuple], columns: Sequence[str], nullable: dict[str, str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype(nullable) if nullable else out


def _of_bucket(fold: Fold, columns: Sequence[str], nullable: dict[str, str], timed: bool):
    def run(_bucket, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        keys, due, states = state.get if state.exists else ((), (), ())
        held = {k: (d, s) for k, d, s in zip(keys, due, states)}
        watermark = state.getCurrentWatermarkMs() if timed else None
        news: dict[str, list[str]] = {}
        for pdf in (() if state.hasTimedOut else pdfs):
            for k, row in zip(pdf["key"].tolist(), pdf["row"].tolist()):
                news.setdefault(k, []).append(row)
        idle = [k for k, (d, _) in held.items() if d is not None and d < watermark and k not in news] if timed else []
        out: list[tuple] = []
        for k in (*news, *idle):
            rows = news.get(k)
            before = held.get(k)
            found, after, timer = fold(k, [json.loads(r) for r in rows or ()], json.loads(before[1]) if before else None, watermark, rows is None)
            if after is None:
                held.pop(k, None)
            else:
                held[k] = (timer, json.dumps(after, ensure_ascii=False))
            out += found
            if len(out) >= RESULT_ROWS:
                yield _frame(out, columns, nullable)
                out = []
        if held:
            state.update((list(held), [d for d, _ in held.values()], [s for _, s in held.values()]))
            timers = [d for d, _ in held.values() if d is not None]
            if timers:
                state.setTimeoutTimestamp(max(watermark + 1, min(timers)))
        elif state.exists:
            state.remove()
        if out:
            yield _frame(out, columns, nullable)
    return run


def fold_keys(rows: DataFrame, key: str, fold: Fold, output: str, timed_by: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Results of ``fold`` over streaming ``rows``; ``timed_by``, the column with the watermark, is for folds with timers.
    A row is a dict of its other columns without nulls; states are values that JSON has."""
    schema = T.StructType.fromDDL(output)
    nullable = {f.name: {"bigint": "Int64", "int": "Int64", "boolean": "boolean"}[f.dataType.simpleString()] for f in schema
                if f.dataType.simpleString() in ("bigint", "int", "boolean")}
    own = [c for c in rows.columns if c not in (key, timed_by)]
    packed = rows.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("bucket"), F.col(key).alias("key"), F.to_json(F.struct(*own)).alias("row"),
                         *([timed_by] if timed_by else []))
    run = _of_bucket(fold, schema.names, nullable, timed_by is not None)
    return packed.groupBy("bucket").applyInPandasWithState(
        run, output, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout if timed_by else GroupStateTimeout.NoTimeout)
