"""Benchmark decontamination by winnowing.

Of every ``W`` consecutive k-gram hashes the smallest is kept (the last of
equals), in documents and in benchmark items alike.  Any shared span of
``K + W - 1`` words holds ``W`` k-grams, so both sides keep the same one of
them: joining the kept hashes misses no shared span.  A joined fingerprint is
extended: each window of that many words around it is looked up among the
item's windows, and the windows found make up the spans.

Items shorter than a window count as one window of their own length and are
looked up whole.

A benchmark of a checked size is sent to the tasks that read the documents; the fingerprints of a larger one stay on
Spark, and documents' fingerprints are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import cut, text_key, without
from carelake.llm.words import ALNUM, gram_hashes, words

K = 5
W = 6
SPAN = K + W - 1
#: bytes of benchmark text up to which its fingerprints are sent to every task; those of more are joined
BLOCK_BYTES = 32 << 20


def winnow(h: np.ndarray, w: int = W) -> np.ndarray:
    """Positions kept of k-gram hashes: the smallest of each ``w`` in a row, the last of equals."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(rows)) + (w - 1 - rows.argmin(axis=1)))


@dataclass
class Windows:
    """Distinct window hashes of one length, sorted, with the items that hold each: items[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Fingerprints:
    """What a benchmark of checked size is searched by."""

    names: list[str | None]
    kept: np.ndarray            # winnowed k-gram hashes, sorted
    windows: dict[int, Windows]  # by length: SPAN, and those of shorter items


def fingerprints(ids: list, texts: pa.Array) -> Fingerprints:
    names, kept, found = [None if i is None else str(i) for i in ids], [], {}
    for w in words(texts, ALNUM):
        for r in range(w.hi - w.lo):
            h = w.hash[w.row(r)]
            if len(h) == 0:
                continue
            m = min(SPAN, len(h))
            grams = np.unique(gram_hashes(h, m))
            found.setdefault(m, []).append((grams, np.full(len(grams), w.lo + r)))
            if m == SPAN:
                k = gram_hashes(h, K)
                kept.append(k[winnow(k)])
    windows = {}
    for m, parts in found.items():
        grams, items = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(grams, kind="stable")
        hashes, first = np.unique(grams[order], return_index=True)
        windows[m] = Windows(hashes, np.append(first, len(grams)), items[order])
    return Fingerprints(names, np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64), windows)


def _member(values: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are in the set, their places in it)."""
    if len(sorted_set) == 0:
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values, at


def _search(w, marks: Fingerprints) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask of the chunk's words inside a hit, (row, item) of the hits); all rows of a chunk are one sequence of words,
    and a window counts only if it stays within its row."""
    n = len(w.hash)
    row = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
    edge = np.zeros(n + 1, np.int64)
    pairs: set[tuple[int, int]] = set()
    for m, win in marks.windows.items():
        if n < m:
            continue
        inside = row[:n - m + 1] == row[m - 1:]
        if m == SPAN:
            k = gram_hashes(w.hash, K)
            at = winnow(k)
            at = at[_member(k[at], marks.kept)[0]]
            start = np.unique((at[:, None] - np.arange(W)[None, :]).ravel())  # the windows that hold the k-gram
            start = start[(start >= 0) & (start <= n - m)]
        else:
            start = np.arange(n - m + 1)
        start = start[inside[start]]
        if m == SPAN:
            grams = np.zeros(len(start), np.uint64)
            if len(start):
                with np.errstate(over="ignore"):
                    grams = gram_hashes_at(w.hash, start, m)
        else:
            grams = gram_hashes(w.hash, m)[start]
        hit, place = _member(grams, win.hashes)
        start, place = start[hit], place[hit]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + m, -1)
        for s, p in zip(start.tolist(), place.tolist()):
            pairs.update((int(row[s]), i) for i in win.items[win.first[p]:win.first[p + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, sorted(pairs)


def gram_hashes_at(h: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """``gram_hashes`` at some positions only."""
    return gram_hashes(h[start[:, None] + np.arange(k)].ravel(), k)[::k]


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _scan(docs: DataFrame, marks: Fingerprints, with_key: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(marks)  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            for w in words(batch.column(1), ALNUM):
                mask, pairs = _search(w, marks)
                items: dict[int, list[str | None]] = {}
                for r, i in pairs:
                    items.setdefault(r, []).append(marks.names[i])
                spans, names = [], []
                for r in range(w.hi - w.lo):
                    if r in items:
                        m = np.diff(np.concatenate(([0], mask[w.row(r)].view(np.int8), [0])))
                        spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(m == 1).tolist(), np.flatnonzero(m == -1).tolist())])
                        names.append(sorted(set(items[r]), key=lambda x: (x is None, x or "")))  # an item without an id comes last
                    else:
                        spans.append([])
                        names.append([])
                cols = [batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(np.diff(w.first), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))]
                if with_key:
                    cols.append(batch.column(2).slice(w.lo, w.hi - w.lo))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "spans", "items", "key"][:len(cols)])
    cols = ["doc_id", "text"] + ([text_key().alias("key")] if with_key else [])
    return docs.select(*cols).mapInArrow(run, SCHEMA + (", key long" if with_key else ""))


def _item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (m, gram, item): the distinct windows of each item by length, and as length 0 the kept k-grams."""
    for batch in batches:
        for w in words(batch.column(1), ALNUM):
            for r in range(w.hi - w.lo):
                h = w.hash[w.row(r)]
                if len(h) == 0:
                    continue
                m = min(SPAN, len(h))
                grams, kept = np.unique(gram_hashes(h, m)), np.zeros(0, np.uint64)
                if m == SPAN:
                    k = gram_hashes(h, K)
                    kept = np.unique(k[winnow(k)])
                n = len(grams) + len(kept)
                length = np.concatenate((np.full(len(grams), m, np.int32), np.zeros(len(kept), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(np.concatenate((grams, kept)).view(np.int64)),
                                                  pa.array([batch.column(0)[w.lo + r].as_py()] * n, pa.string())], ["m", "gram", "item"])


def _document_marks(lengths: list[int]):
    """(doc_id, text, key) -> (doc_id, key, m, gram, windows): the kept k-grams with the windows that hold them (m is SPAN),
    and every window of the shorter lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), ALNUM):
                n = len(w.hash)
                row = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
                for m in lengths:
                    if n < m:
                        continue
                    inside = row[:n - m + 1] == row[m - 1:]
                    grams = gram_hashes(w.hash, m)
                    if m == SPAN:
                        k = gram_hashes(w.hash, K)
                        at = winnow(k)
                        start = at[:, None] - np.arange(W)[None, :]
                        good = (start >= 0) & (start <= n - m)
                        good &= inside[np.where(good, start, 0)]
                        some = good.any(axis=1)
                        at, start, good = at[some], start[some], good[some]
                        mark, size, start = k[at], good.sum(axis=1), start[good]
                    else:
                        at = start = np.flatnonzero(inside)
                        mark, size = grams[at], np.ones(len(at), np.int64)
                    of = row[start]
                    windows = pa.StructArray.from_arrays([pa.array(start - w.first[of]), pa.array(grams[start].view(np.int64))], ["start", "gram"])
                    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                    place = pa.array(w.lo + row[at])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(2).take(place), pa.array(np.full(len(at), m, np.int32)),
                                                      pa.array(mark.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), windows)],
                                                     ["doc_id", "key", "m", "gram", "windows"])
    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words(batch.column(1), ALNUM):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), batch.column(2).slice(w.lo, w.hi - w.lo),
                                              pa.array(np.diff(w.first), pa.int64())], ["doc_id", "key", "n_words"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contamination`` of any benchmark, with ``key``: its fingerprints and those of the documents meet in joins.

    Only marks of documents that the benchmark has too are kept, and the windows around these are looked up; texts are
    never shuffled and nothing of the benchmark reaches the driver but the lengths of short items, nine at the most.
    """
    marks = cut(items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_marks, "m int, gram long, item string"))
    lengths = sorted(r["m"] for r in marks.where("m > 0").select("m").distinct().collect())
    known = marks.where(F.col("m") < SPAN).select(F.when(F.col("m") == 0, SPAN).otherwise(F.col("m")).alias("m"), "gram").distinct()
    texts = docs.select("doc_id", "text", text_key().alias("key"))
    same = texts.mapInArrow(_document_marks(lengths), "doc_id long, key long, m int, gram long, windows array<struct<start:long,gram:long>>")
    near = same.join(known, ["m", "gram"], "left_semi").select("doc_id", "key", "m", F.explode("windows").alias("w")).select("doc_id", "key", "m", "w.*").distinct()
    windows = marks.where("m > 0")
    spans = near.join(windows.select("m", "gram").distinct(), ["m", "gram"], "left_semi")
    spans = cut(spans)   # the hits: read for the spans and for the items
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.select("doc_id", "key", "start", (F.col("start") + F.col("m")).alias("end"))
            .withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    held = (spans.select("doc_id", "key", "m", "gram").distinct().join(windows, ["m", "gram"]).select("doc_id", "key", "item").distinct()
            .groupBy("doc_id", "key").agg(F.collect_list(F.struct("item")).alias("found"))
            .select("doc_id", "key", F.array_sort(F.transform("found", lambda x: x["item"])).alias("items")))
    out = texts.mapInArrow(_count_words, "doc_id long, key long, n_words long").alias("d")
    for name, part in (("s", runs), ("i", held)):
        part = part.alias(name)
        out = out.join(part, F.col("d.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col("d.key") == F.col(f"{name}.key")), "left")
    none = "cast(array() as array<{}>)"
    return out.select("d.doc_id", "d.n_words", F.coalesce("spans", F.expr(none.format("struct<start:bigint,end:bigint>"))).alias("spans"),
                      F.coalesce("items", F.expr(none.format("string"))).alias("items"), "d.key")


def contamination(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES,
                  with_key: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items), one row per row of ``docs``: the word spans (start, end) that occur in the
    benchmark, and the item_ids, as sorted strings, whose windows they hold.

    Null texts have no words; items without words are never found; all items without an id
    are one, a null at the end of the array.  While the benchmark's texts take at most ``block_bytes`` its fingerprints are
    broadcast and nothing is shuffled; beyond that they are joined.
    ``with_key`` adds ``key``, the hash of the text.
    """
    items = items.select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    if total > block_bytes:
        found = _joined(docs, items)
        return found if with_key else found.drop("key")
    got = items.toArrow()
    return _scan(docs, fingerprints(got["item_id"].to_pylist(), got["text"].combine_chunks()), with_key)


def hit_words(found: DataFrame) -> DataFrame:
    """Add ``n_hit``: words inside any span (spans are sorted)."""
    n = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end")),
                    lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("sum"),
                                          F.greatest(a["end"], s["end"]).alias("end")))
    return found.withColumn("n_hit", n["sum"])


def clean(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """The documents of whose words at most the share ``most`` is hit; columns unchanged."""
    found = hit_words(contamination(docs, items, with_key=True)).where(F.col("n_hit") > F.col("n_words") * most)
    return without(docs, found)
