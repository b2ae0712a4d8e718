"""Helpers shared by the streams: time-ordered file drops and running a query
to completion with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_time_chunks(df: DataFrame, ts: str, root: str, chunks: int, files_per_chunk: int = 1, key: Column | None = None) -> None:
    """Replay ``df`` into ``root`` as ``chunks`` successive appends in time
    order, the way an upstream producer drops files, so a file stream with
    ``maxFilesPerTrigger = files_per_chunk`` sees one time range per
    micro-batch.  With a ``key`` a chunk's files are dealt by it, so the rows of a
    key stay in order whatever files make a micro-batch.  A fixture/replay
    helper: production streams consume the producer's own files and never go
    through it."""
    def write(part: DataFrame) -> None:
        dealt = part.repartition(files_per_chunk) if key is None else part.repartition(files_per_chunk, key)
        dealt.write.mode("append").parquet(root)
    untimed = df.where(F.col(ts).isNull())   # rows without a time come first, as they do in time order
    if not untimed.isEmpty():
        write(untimed)
    bounds = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        return
    step = (hi - lo) / chunks
    for i in range(chunks):
        a = lo + step * i
        cond = F.col(ts) >= F.lit(a)
        if i < chunks - 1:
            cond &= F.col(ts) < F.lit(lo + step * (i + 1))
        write(df.where(cond))


def run_available_now(query_builder, checkpoint: str, spark: SparkSession | None = None,
                      state_partitions: int | None = None):
    """Start ``query_builder`` (a DataStreamWriter) with ``availableNow`` and
    wait for it to drain the input.

    ``state_partitions`` fixes the number of state partitions of a new
    stateful query (it is kept in the checkpoint afterwards); the session's
    shuffle setting is restored once the query has started.
    """
    old = None
    if spark is not None and state_partitions:
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if old is not None:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def stream_parquet(spark: SparkSession, root: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(root))


#: no event has this time; the optimiser can't know that
_NEVER = -9_000_000_000_000_000_000


def with_event_clock(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``rows`` (streaming) with ``_arrived``, in a query whose watermark is the latest ``ts`` less ``lateness``.

    A stateful step drops the rows that are behind the watermark of its own
    event-time column.  Here that column is the arrival, so no row is ever
    dropped, while the clock that fires the timers is the event time: it comes from a
    second branch of the union that has the other watermark and gives no rows.
    """
    clock = rows.withColumn("_clock", F.col(ts).cast("timestamp")).withWatermark("_clock", lateness)
    clock = clock.where(F.unix_micros("_clock") == F.lit(_NEVER)).drop("_clock").withColumn("_arrived", F.current_timestamp())
    return rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds").unionByName(clock)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the highest ``revision``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select(*keys, "_r.*").select(*df.columns)
