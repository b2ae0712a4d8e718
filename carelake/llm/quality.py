"""Rule bitmask ledger (native): every rule is evaluated once per document, its failure stored as one bit next to the
measurements; policies are bit masks with a version, and applying or ablating them never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import WORD, let

WINDOW = 5
LETTER_CASE = "[A-Z]"

#: rule name -> failure test over the measurements, in bit order; append only, so that stored ledgers stay readable
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbol_debris": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "tiny_words": "word_chars < 2 * n_words",
    "huge_words": "word_chars > 15 * n_words",
    "shouting": "100 * n_upper > 40 * word_chars",
}
BIT = {name: i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", (*BASE.rules, "symbol_debris", "repeated_lines")),
    Policy("v2", tuple(RULES)),
)}
CURRENT = "v2"


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside a 5-word window that occurs twice or more; n log n in the text's length.

    Windows are compared by a 64-bit hash.  Only a text that repeats one sorts
    (hash, position); neighbours with equal hashes are the repeated windows,
    and each covers up to five words until the next repeated one begins.
    """
    def covered(hashes: Column) -> Column:
        def sweep(by_hash: Column) -> Column:
            twice = F.filter(by_hash, lambda x, i: (x["h"] == F.get(by_hash, i - 1)["h"]) | (x["h"] == F.get(by_hash, i + 1)["h"]))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            gain = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
                               lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")))
            return gain["sum"]
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.sort_array(pairs), sweep)).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    return F.when(n > WINDOW, let(words, lambda w: let(windows(w), covered))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements that the rules read; a null text measures as an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", body.alias("_body"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"),
                     F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"))
    df = df.select("*", F.size("_words").cast("long").alias("n_words"),
                   F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                   F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                   F.regexp_count("_body", F.lit(LETTER_CASE)).cast("long").alias("n_upper"),
                   F.size("_lines").cast("long").alias("n_lines"),
                   (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                   _repeat_words(F.col("_words"), F.size("_words")).alias("n_repeat_words"))
    return df.drop("_body", "_words", "_lines")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, measurements, ``fail_bits``): bit i is set if rule i fails.  Extra columns of ``docs`` are left out."""
    df = measure(docs.select("doc_id", F.col(text).alias("text")))
    bits = F.lit(0).cast("long")
    for name, test in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    return df.drop("text").withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``policy`` and ``kept`` from the stored bits alone."""
    mask = F.lit(POLICIES[version].mask).cast("long")
    return led.withColumn("policy", F.lit(version)).withColumn("kept", F.col("fail_bits").bitwiseAND(mask) == 0)


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    Counted from the distinct bit patterns, at most 2^rules of them whatever
    the number of documents; an empty ledger gives zero counts.
    """
    p = POLICIES[version]
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = led.sparkSession.createDataFrame([(p.version, r, 1 << BIT[r]) for r in p.rules], "policy string, rule string, bit long")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    # both sides bounded: the policy's rules, and the patterns their bits can form
    return (F.broadcast(rules).join(patterns, F.lit(True), "left").groupBy("policy", "rule", "bit")
            .agg(count(hit).alias("n_fail"), count(hit & rest).alias("n_only"), count(rest).alias("kept_without"),
                 count(F.col("bits") == 0).alias("kept")))
