"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target exceeds its size is taken in complete epochs first; the
rest of its budget is a weighted sample without replacement: every document
gets the key -ln(u) / w (u from a hash of the document, w its quality by the rule ledger), the
source is sorted by key, and documents are taken while the running word count
stays within the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import cut, fresh, ranked, union_all
from carelake.llm.quality import ledger

#: share of the sources in code-point order, repeating
WEIGHTS = (3, 1, 2)
BUDGET = 1.5       # of all sizes
MOST_EPOCHS = 2    # no source and no document is taken more often


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
                   most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): the budget shared by weight; what exceeds ``most`` times a source's size is
    shared again among the others.

    That fixed point is a water level: with sources sorted by cap / weight, all
    before the level stop at their cap, the others get level x weight.  One row
    per source goes through the windows, never documents.
    """
    per = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("_all", F.sum("source_size").over(everything) * F.lit(budget))
           .withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("_open", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
           .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open")).withColumn("_turn", F.row_number().over(order)))
    # the first source whose own level leaves it below its cap sets the level of all after it
    stops = F.col("_level") <= F.col("_cap") / F.col("_w")
    per = per.withColumn("_lv", F.min(F.when(stops, F.struct("_turn", "_level"))).over(everything)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_lv"), F.lit(float("inf"))) * F.col("_w"))
    return per.select("source", "source_size", target.alias("target"))


def uniform(*cols: Column) -> Column:
    """(0, 1), the same for the same values in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def ledger_quality() -> Column:
    """(0, 1] from a row of the quality ledger: each failed rule halves it, and it loses the shares of words in repeated
    windows and of repeated lines (at most 19/20 of it).  A text without words has no shares to lose."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    clean = F.greatest(F.lit(0.05), (1 - F.col("n_repeat_words") / words) * (1 - F.col("n_dup_lines") / lines))
    return clean * F.pow(F.lit(0.5), F.bit_count("fail_bits"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """One small row per document: its words, and its quality by the rules and measurements of the ledger."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    led = ledger(docs.select(F.struct("doc_id", "source", crc.alias("_crc")).alias("doc_id"), "text"))
    return led.select("doc_id.doc_id", "doc_id.source", "doc_id._crc", F.col("n_words").alias("size"), ledger_quality().alias("quality"))


def mix(sized: DataFrame, seed: int = 17, **recipe) -> DataFrame:
    """Add source_size, target, ``epochs`` (complete passes), ``extra`` (words of the sampled pass) and ``taken``.

    ``sized``: doc_id, source, size, quality, _crc.  The document at the budget's
    edge gives its first words only, so a source's words meet its target to the
    word; ``extra`` says how many.  A null source is a source of its own; null
    or empty texts have size 0 and give nothing.  Rows with equal id and text
    draw equal keys and stand side by side.  Sources of any size are sorted over
    many tasks.
    """
    sized = cut(sized)  # the texts are counted once
    key = -F.log(uniform(F.lit(seed), F.col("doc_id"), F.col("_crc"))) / F.col("quality")
    run = ranked(sized.withColumn("_key", key), ["source", "_key", "doc_id", "_crc"], groups=["source"], weight="size")
    goals = source_targets(sized, **recipe).withColumn("_s", F.struct("source")).drop("source")
    run = run.withColumn("_s", F.struct("source")).join(goals, "_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    run = run.withColumn("epochs", epochs)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), left - F.col("before")))
    return (run.withColumn("extra", extra).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
            .drop("_s", "_key", "before"))


def mix_documents(docs: DataFrame, **recipe) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged.

    A document that the budget's edge cuts is taken whole if at least half of
    it is within, so texts are never cut.
    """
    plan = mix(document_sizes(docs), **recipe)
    copies = (F.col("epochs") + (F.col("extra") * 2 > F.col("size")).cast("long")).cast("int")
    # rows alike in id, text and source share a plan row; where the budget's edge parts them, the first ``more`` take one more
    plan = plan.withColumn("copies", copies).groupBy("doc_id", "_crc", "source").agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("n"))
    plan = cut(plan.select("doc_id", "_crc", "source", "least", (F.col("all") - F.col("least") * F.col("n")).alias("more")).where("least > 0 or more > 0"))

    def taken(part: DataFrame) -> DataFrame:
        crc = F.crc32(F.coalesce(F.col("d.text"), F.lit("")).cast("binary"))
        same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (crc == F.col("p._crc")) & F.col("d.source").eqNullSafe(F.col("p.source"))
        return docs.alias("d").join(part.alias("p"), same)
    name = fresh(docs, "copy")
    columns = [F.col(f"d.{c}") for c in docs.columns]
    parts = [taken(plan.where("more = 0")).select(*columns, F.explode(F.sequence(F.lit(1), F.col("p.least"))).alias(name))]
    parted = plan.where("more > 0")  # one group a source at most
    if not parted.isEmpty():
        alike = Window.partitionBy("p.doc_id", "p._crc", "p.source").orderBy("p._crc")
        rows = taken(parted).select(*columns, (F.col("p.least") + (F.row_number().over(alike) <= F.col("p.more")).cast("int")).alias(name))
        parts.append(rows.where(F.col(name) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))))
    return union_all(parts).select(*docs.columns)
