"""Language identification as multilingual mixture inference.

A document is a mixture of languages: each word is drawn from one of them, and
its likelihood under a language is that of its character trigrams.
Expectation-maximisation estimates the proportions; the set of languages is the
one with the best likelihood less a penalty per language (BIC), of the sets that
the largest shares make.  Sets are tried from one language on, each over its own
languages only, until none that follows can win: no mixture's likelihood exceeds
the concave bound that the shares over all languages give.  The prediction
is the language of the largest share, the score that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import text_key, without
from carelake.llm.words import byte_chunks

BUCKETS = 1 << 16
#: labelled documents of each language that the model is fitted on, about (a documented bound; more change little)
MAX_TRAIN = 4000
ROUNDS = 8         # EM rounds over all languages
MORE_ROUNDS = 4    # and over each smaller set
PENALTY = 4.0      # times half the logarithm of the words; over 1 as a word's trigrams aren't independent
SMOOTH = 0.5

_letters: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its lower case."""
    if not _letters:
        top = 0x32400  # no letters above
        _letters.append(np.array([chr(c).isalpha() for c in range(top)] + [False]))
        low = [chr(c).lower() for c in range(top)]
        _letters.append(np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)] + [0], np.uint64))
    return _letters[0], _letters[1]


def _trigrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every trigram, first trigram of every word, row of every word); a word is a run of letters and its
    trigrams take in both ends."""
    letter, lower = _tables()
    char = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(char) != np.count_nonzero((raw & 0xC0) != 0x80):
        raise ValueError("a text isn't valid UTF-8")
    place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    row_start = place[offs]  # in code points
    char = np.minimum(char, len(letter) - 1)
    # two separators after each row, so that no trigram takes in letters of two rows
    row = np.repeat(np.arange(len(offs) - 1), np.diff(row_start))
    seq = np.zeros(len(char) + 2 * len(offs) + 2, np.uint64)
    at = np.arange(len(char)) + 2 * row + 2
    seq[at] = np.where(letter[char], lower[char], 0)
    a, b, c = seq[:-2], seq[1:-1], seq[2:]
    used = (b > 0) | (c > 0)
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9))
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    first = (b == 0) & (c > 0)
    index = np.cumsum(used) - 1
    seq_row = np.zeros(len(seq), np.int64)
    seq_row[at] = row
    return h[used].astype(np.int64), index[first], seq_row[2:][first]


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _em(like: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of the columns of ``like`` (words x languages) by document, after so many rounds."""
    for _ in range(rounds):
        r = like * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(r, start, axis=0) / n[:, None]
    return share


def _fit(like: np.ndarray, doc: np.ndarray, start: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log-likelihood by document."""
    mix = np.maximum((like * share[doc]).sum(axis=1), 1e-30)
    return np.add.reduceat(np.log(mix, dtype=np.float64), start)


def _roof(like: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """No shares give a document a greater log-likelihood: it is at most that of ``share`` and n log max d, where d is the
    mean, by language, of a word's likelihood over that of its mixture (the logarithm is concave)."""
    mix = np.maximum((like * share[doc]).sum(axis=1, keepdims=True), 1e-30)
    d = np.add.reduceat(like / mix, start, axis=0, dtype=np.float64) / n[:, None]
    return np.add.reduceat(np.log(mix[:, 0], dtype=np.float64), start) + n * np.log(np.maximum(d.max(axis=1), 1)) + 1e-4 * (1 + n)


class Model:
    """Log-likelihoods of trigrams by language (names sorted)."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def mixtures(self, raw: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, float]]]:
        """Per row the languages of its set with their shares, largest first; empty without letters."""
        rows, langs = len(offs) - 1, len(self.names)
        grams, first, row = _trigrams(raw, offs)
        out: list[list[tuple[str, float]]] = [[] for _ in range(rows)]
        if len(first) == 0 or langs == 0:
            return out
        ll = np.add.reduceat(self.table[grams], first, axis=0)  # words x languages
        top = ll.max(axis=1)
        like = np.exp(ll - top[:, None])
        some, start = np.unique(row, return_index=True)
        n = np.diff(np.append(start, len(row)))
        doc = np.repeat(np.arange(len(some)), n)
        share = _em(like, doc, start, n, np.full((len(some), langs), 1 / langs, np.float32), ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        roof = _roof(like, doc, start, n, share)
        step = PENALTY * 0.5 * np.log(n)
        best_share = np.zeros_like(share)
        best = np.full(len(some), -np.inf)
        live = np.arange(len(some))
        for m in range(1, langs + 1):
            live = live[roof[live] - (m - 1) * step[live] > best[live]]
            if len(live) == 0:
                break
            chosen = order[live, :m]
            of = np.repeat(np.arange(len(live)), n[live])
            at = np.concatenate(([0], np.cumsum(n[live])[:-1]))
            word = np.arange(len(of)) + np.repeat(start[live] - at, n[live])
            part = like[word[:, None], chosen[of]]  # words x m
            s = np.maximum(np.take_along_axis(share[live], chosen, axis=1), 1e-6)
            s = _em(part, of, at, n[live], (s / s.sum(axis=1, keepdims=True)).astype(np.float32), MORE_ROUNDS if m > 1 else 0)
            fit = _fit(part, of, at, s) - (m - 1) * step[live]
            better = fit > best[live]
            won = live[better]
            best[won] = fit[better]
            best_share[won] = 0
            best_share[won[:, None], chosen[better]] = s[better]
        for d, r in enumerate(some.tolist()):
            out[r] = [(self.names[i], float(best_share[d, i])) for i in np.argsort(-best_share[d], kind="stable") if best_share[d, i] > 0]
        return out


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on about ``max_train`` labelled documents a language, drawn by a hash of the id; held-out ones never.

    Rows with a null text, lang or id teach nothing; no labelled row at all
    gives a model without languages.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, max_train / sizes[name]))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).where(F.col("text").isNotNull())
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, _, raw, offs in byte_chunks(batch.column(0)):
                grams, first, row = _trigrams(raw, offs)
                per_gram = np.repeat(lang[lo + row], np.diff(np.append(first, len(grams))))
                np.add.at(total, (per_gram, grams), 1)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[lang, gram])], ["lang", "gram", "n"])

    counts = (drawn.select("text", "lang").mapInArrow(count, "lang int, gram int, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())  # at most languages x BUCKETS
    table = np.full((BUCKETS, len(names)), SMOOTH)
    np.add.at(table, (counts["gram"].to_numpy(), counts["lang"].to_numpy()), counts["n"].to_numpy())
    return Model(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model, with_key: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, mixture): ``und`` with score 0 and no mixture if the text is null or has no letters.

    ``with_key`` adds ``key``, the hash of the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo, hi, raw, offs in byte_chunks(batch.column(1)):
                found = m.mixtures(raw, offs)
                mix = pa.array([[{"lang": a, "share": b} for a, b in f] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
                cols = [batch.column(0).slice(lo, hi - lo), pa.array([f[0][0] if f else "und" for f in found], pa.string()),
                        pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()), mix,
                        *[c.slice(lo, hi - lo) for c in batch.columns[2:]]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "mixture", "key"][:len(cols)])
    schema = "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    return docs.select("doc_id", "text", *[text_key().alias("key")] * with_key).mapInArrow(run, schema + ", key long" * with_key)


def keep_identified(docs: DataFrame, least: float = 0.4, **params) -> DataFrame:
    """The documents with a language of share ``least`` or more; columns unchanged."""
    found = identify(docs, train(docs, **params), with_key=True).where((F.col("lang_pred") == "und") | (F.col("score") < least))
    return without(docs, found)
