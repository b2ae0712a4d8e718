"""Hilbert-curve sharding (native): quantise metadata, order by curve index, cut runs of equal row counts.

Neighbouring rows of a shard are close in every dimension at once, so the
min/max statistics of its files prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import cut, fresh, let, ranked


def hilbert_index(df: DataFrame, axes: list[str], bits: int, out: str = "curve") -> DataFrame:
    """Add the Hilbert index of integer coordinates 0 .. 2^bits - 1 (Skilling's transform).

    The coordinates are one array and the transform folds over its (bit, axis)
    steps, so the expression has one size whatever ``bits`` and the axes are.
    """
    n = len(axes)
    if n * bits > 62:
        raise ValueError("axes x bits must fit a long")

    def steps(lowest: int) -> Column:
        return F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(i).alias("axis"))
                         for b in range(bits - 1, lowest - 1, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low, at = s["bit"] - 1, F.element_at(x, s["axis"] + 1)
        swap = x[0].bitwiseXOR(at).bitwiseAND(low)
        return F.when(at.bitwiseAND(s["bit"]) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))).otherwise(
            F.transform(x, lambda v, j: F.when((j == 0) | (j == s["axis"]), v.bitwiseXOR(swap)).otherwise(v)))

    zero = F.lit(0).cast("long")
    x = F.array(*[F.col(a).cast("long") for a in axes])
    if bits > 1:
        x = F.aggregate(steps(1), x, turn)
    # Gray code: each axis takes the exclusive or of all up to it, then all take that of the last one's higher bits
    x = F.aggregate(x, F.array().cast("array<long>"), lambda done, v: F.concat(done, F.array(
        F.when(F.size(done) == 0, v).otherwise(F.element_at(done, -1).bitwiseXOR(v)))))
    df = df.withColumn(out, x)
    ones = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)] or [zero])
    gray = F.aggregate(ones, zero, lambda t, bit: F.when(F.element_at(out, -1).bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t))
    df = df.withColumn(out, let(gray, lambda t: F.transform(out, lambda v: v.bitwiseXOR(t))))
    return df.withColumn(out, F.aggregate(steps(0), zero, lambda index, s: index * 2 + F.when(
        F.element_at(out, s["axis"] + 1).bitwiseAND(s["bit"]) != 0, 1).otherwise(0)))


def quantise_text(df: DataFrame, col: str, bits: int, out: str) -> DataFrame:
    """0 .. 2^bits - 1 by the share of rows whose value sorts lower (null first): order and balance both hold.

    Only one row per distinct value is ranked; the values join back by an
    ordinary join, which Spark broadcasts only below its own size threshold.
    """
    key = F.struct(F.col(col)).alias("_v")
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    below = ranked(counts.withColumn("_s", F.col("_v")[col]), ["_s"], weight="_n")
    total = counts.agg(F.sum("_n").alias("_all"))
    grade = F.least(F.lit((1 << bits) - 1), F.floor(F.col("before") * (1 << bits) / F.col("_all"))).cast("long")
    below = below.crossJoin(F.broadcast(total)).select("_v", grade.alias(out))  # total: one row
    return df.withColumn("_v", key).join(below, "_v", "left").drop("_v")


def quantise_number(df: DataFrame, col: str, bits: int, out: str) -> DataFrame:
    """0 .. 2^bits - 1 by approximate quantiles (a sketch of bounded size); null counts as the lowest."""
    steps = 1 << bits
    cuts = df.agg(F.percentile_approx(col, [i / steps for i in range(1, steps)], 10_000).alias("c")).first()["c"] or []
    grade = F.lit(0).cast("long")
    for c in sorted(set(cuts)):
        grade = grade + F.when(F.col(col) > F.lit(c), 1).otherwise(0)
    return df.withColumn(out, grade)


def hilbert_shards(df: DataFrame, shards: int, text_dims: list[str], number_dims: list[str], tie: list[str],
                   bits: int = 5) -> DataFrame:
    """Add ``curve``, ``rank`` in its order, ``shard`` and ``slot``: equal runs (row counts at most one apart) of the curve order.

    ``tie`` orders rows within a curve cell.  Nulls in any column are a value
    of their own; an empty table gives an empty result.  ``df`` should hold
    metadata only: the rows are shuffled, texts need not be.
    """
    axes = []
    for i, c in enumerate(number_dims):
        df = quantise_number(df, c, bits, f"_q{i}")
        axes.append(f"_q{i}")
    for i, c in enumerate(text_dims, len(number_dims)):
        df = quantise_text(df, c, bits, f"_q{i}")
        axes.append(f"_q{i}")
    df = hilbert_index(df, axes, bits).drop(*axes)
    out = ranked(df, ["curve", *tie])
    out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))  # one row
    return _cut_runs(out.withColumnRenamed("before", "rank"), shards, "rank", "_all").drop("_all")


def _cut_runs(df: DataFrame, shards: int, rank: str, total: str) -> DataFrame:
    """Add shard and slot: shard s holds the ranks floor(s * all / shards) <= rank < floor((s + 1) * all / shards)."""
    shard = F.expr(f"(({rank} + 1) * {shards} - 1) div {total}")
    return (df.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col(rank) - F.expr(f"(cast(shard as long) * {total}) div {shards}")))


def document_metadata(docs: DataFrame) -> DataFrame:
    """One small row per document: sizes and checksums instead of the text (null text: no bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents' metadata with ``curve``, ``shard``, ``slot`` over (size, lang, source); ties by text, id, lang, source."""
    # cut: the texts are read once, the small rows as often as the order needs them
    return hilbert_shards(cut(document_metadata(docs)), shards, ["lang", "source"], ["size"], ["text_crc32", "size", "doc_id", "lang", "source"])


def place_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with ``shard`` and ``slot`` (columns of that name are replaced), rows dealt and sorted in that order.

    Rows alike in id, checksum, lang and source stand side by side in the order,
    so one small row per such group (its first rank) joins the texts.  Texts are
    shuffled twice: to meet their rank, and into order.
    """
    id_, crc, first, rank, total = (fresh(docs, n) for n in ("_id", "_crc", "_first", "_rank", "_all"))
    key = F.struct("doc_id", "lang", "source").alias(id_)  # nulls are values too
    meta = shard_documents(docs, shards)
    ranks = meta.select(key, F.col("text_crc32").alias(crc), "rank").groupBy(id_, crc).agg(F.min("rank").alias(first))
    rows = docs.select(*[F.col(c) for c in docs.columns if c not in ("shard", "slot")], key,
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(crc))
    copy = F.row_number().over(Window.partitionBy(id_, crc).orderBy(first))
    rows = rows.join(ranks, [id_, crc]).withColumn(rank, F.col(first) + copy - 1).withColumn(total, F.lit(docs.count()))
    rows = _cut_runs(rows, shards, rank, total).drop(id_, crc, first, total)
    n = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, rank).sortWithinPartitions(rank).drop(rank)


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The documents as Parquet, a folder per shard, rows in curve order: file statistics prune on every dimension."""
    place_documents(docs, shards).write.mode("overwrite").partitionBy("shard").parquet(path)
