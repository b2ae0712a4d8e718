"""Lexical retrieval packing: sequences of related documents, filled by a sharded BM25 index.

A document's ids are cut into whole windows, which are sequences of their own,
and a tail shorter than a window.  Tails are the units of an index over token
ids, so the vocabulary bounds the table of document frequencies, whatever the
corpus.  Units are ordered by their heaviest terms (idf over all units) and cut
into shards of equal token counts; a shard holds neighbours in that order,
is bounded, and has an inverted index of its own.  In a shard a seed's terms are
looked up and the unused units with the best BM25 scores fill its window.  The
unit that a window's end cuts goes on as the next seed, so every window but
a shard's last is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import cut, ranked
from carelake.llm.tokens import MAX_RANKS_BYTES, _encoder

#: the merges of byte_bpe_50k.json as ranks: the same vocabulary and ids
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WINDOW = 1024
END_ID = 0              # stands after every document
SHARD_TOKENS = 1 << 18  # of an index; bounds a task's group
K1, B = 1.2, 0.75
SIGNATURE = 3           # heaviest terms that order the units
def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANKS_BYTES + 1)
    if len(raw) > MAX_RANKS_BYTES:
        raise ValueError("the rank file is too large to send")
    return raw


def encode(raw: bytes, text: str | None) -> np.ndarray:
    """The ids of a text; strings of special tokens are ordinary text."""
    return _encoder(raw)[0].encode_to_numpy(text or "", allowed_special=set(), disallowed_special=())


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenise(docs: DataFrame, ranks: str = RANKS, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_tokens, whole, tail): the checksums of a document's whole windows, and the ids that are left.

    A document's ids end with ``END_ID``; a null text has that id only.  The
    rank file is read by the driver and sent along.
    """
    raw = read_ranks(ranks)
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _id_type(len(_encoder(sent.value)[1]))
        for batch in batches:
            count, whole, tail = [], [], []
            for text in batch.column(1):
                ids = np.append(encode(sent.value, text.as_py()), END_ID)
                n = len(ids) // window * window
                count.append(len(ids))
                whole.append([checksum(ids[a:a + window]) for a in range(0, n, window)])
                tail.append(ids[n:].astype(kept).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(tail, pa.binary())],
                                             ["doc_id", "doc_tokens", "whole", "tail"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, whole array<long>, tail binary")


def frequencies(units: DataFrame, kind: str) -> DataFrame:
    """(term, n): units that hold each token id; tasks add up their own counts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = [np.unique(np.frombuffer(t, kind)) for t in batch.column(0).to_pylist()]
            if seen:
                n = np.bincount(np.concatenate(seen), minlength=len(total))
                n[:len(total)] += total
                total = n
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term], pa.int64())], ["term", "n"])
    return units.select("tail").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def inverse_frequencies(df: np.ndarray, units: int) -> np.ndarray:
    return np.log1p((units - df + 0.5) / (df + 0.5))


def term_weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their BM25 weights) of a unit."""
    terms, tf = np.unique(ids, return_counts=True)
    return terms, idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


class Index:
    """Inverted lists of one shard's units."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float):
        parts = [term_weights(u, idf, mean) for u in units]
        term = np.concatenate([t for t, _ in parts])
        order = np.argsort(term, kind="stable")
        self.unit = np.repeat(np.arange(len(units)), [len(t) for t, _ in parts])[order]
        self.weight = np.concatenate([w for _, w in parts])[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(term))
        self.n = len(units)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 of every unit for the distinct terms of ``ids``, to six digits, so that sums in any order tie alike."""
        at = np.searchsorted(self.terms, np.unique(ids))
        size = self.first[at + 1] - self.first[at]
        after = np.cumsum(size)
        take = np.repeat(self.first[at] - (after - size), size) + np.arange(int(after[-1]))
        return np.round(np.bincount(self.unit[take], self.weight[take], self.n), 6)


def fill_windows(units: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(unit, start, length, sequence, offset) of every piece: seeds in order, windows filled with the best unused units."""
    index = Index(units, idf, mean)
    size = np.array([len(u) for u in units])
    at = np.zeros(len(units), np.int64)  # ids of each unit that are placed
    unused = np.ones(len(units), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, seed, first = 0, None, 0
    while True:
        if seed is None:
            while first < len(units) and not unused[first]:
                first += 1
            if first == len(units):
                return out
            seed = first
        unused[seed] = False
        room, query, rest = window, units[seed][at[seed]:], iter([seed])
        near = None
        seed_next = None
        while room:
            u = next(rest, None)
            if u is None:
                if near is None and unused.any():
                    left = np.flatnonzero(unused)
                    near = left[np.argsort(-index.scores(query)[left], kind="stable")]
                    rest = iter(near.tolist())
                    continue
                break
            n = min(room, int(size[u] - at[u]))
            out.append((u, int(at[u]), n, sequence, window - room))
            at[u] += n
            room -= n
            unused[u] = False
            if at[u] < size[u]:
                seed_next = u
        sequence, seed = sequence + 1, seed_next


def pack(docs: DataFrame, ranks: str = RANKS, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of a sequence.

    Every id of a document, its closing ``END_ID`` included, lies in exactly
    one piece; a sequence is a whole window of one document, or pieces
    that follow each other in a window without a gap, only a shard's last one
    with room left.  Null and empty texts are the closing id alone; null ids
    and repeated rows are packed like others, row by row.
    Other columns are left out.  No document gives no piece.
    """
    spark = docs.sparkSession
    rows = cut(tokenise(docs, ranks, window))
    whole = rows.select("doc_id", "doc_tokens", F.posexplode("whole").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
                         "doc_tokens", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kind = _id_type(len(_encoder(read_ranks(ranks))[1]))
    units = rows.where(F.length("tail") > 0).select("doc_id", "doc_tokens", "tail")
    n, total = units.agg(F.count("*"), F.sum(F.length("tail"))).first()
    if not n:
        return whole
    mean = total / np.dtype(kind).itemsize / n
    # one row per id of the vocabulary at most
    found = frequencies(units, kind).toArrow()
    df = np.zeros(int(max(found["term"].to_numpy())) + 1)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = spark.sparkContext.broadcast(inverse_frequencies(df, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = np.full((batch.num_rows, SIGNATURE), -1, np.int64)
            crc = np.zeros(batch.num_rows, np.int64)
            for r, t in enumerate(batch.column(2).to_pylist()):
                terms, w = term_weights(np.frombuffer(t, kind), idf.value, mean)
                top = terms[np.lexsort((terms, -w))[:SIGNATURE]]
                heavy[r, :len(top)] = top
                crc[r] = zlib.crc32(t)
            size = pa.array(np.diff(np.concatenate(([0], np.cumsum([len(t) for t in batch.column(2).to_pylist()])))) // np.dtype(kind).itemsize)
            yield pa.RecordBatch.from_arrays([*batch.columns, size, *[pa.array(heavy[:, i]) for i in range(SIGNATURE)], pa.array(crc)],
                                             ["doc_id", "doc_tokens", "tail", "size", *signature, "crc"])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("before", kind="stable")
        ids = [np.frombuffer(t, kind) for t in group["tail"]]
        pieces = fill_windows(ids, idf.value, mean, window)
        u, start, length, sequence, offset = np.array(pieces, np.int64).T
        doc = group["doc_id"].array.take(u)
        skip = group["doc_tokens"].to_numpy()[u] - np.array([len(x) for x in ids])[u]
        crc = [checksum(ids[a][b:b + c]) for a, b, c, _, _ in pieces]
        shard = int(group["shard"].iloc[0])
        return pd.DataFrame({"doc_id": doc, "start": skip + start, "length": length, "ids_crc32": crc, "doc_tokens": group["doc_tokens"].to_numpy()[u],
                             "sequence_id": 2 * (shard * (shard_tokens + window) + sequence), "offset": offset})

    signature = [f"sign{i}" for i in range(SIGNATURE)]
    columns = ", ".join(f"{s} long" for s in signature)
    signed = units.mapInArrow(sign, f"doc_id long, doc_tokens long, tail binary, size long, {columns}, crc long")
    dealt = ranked(signed, [*signature, "crc", "doc_id", "doc_tokens"], weight="size")
    dealt = dealt.select("tail", "doc_tokens", "before", F.floor(F.col("before") / shard_tokens).alias("shard"), "doc_id")
    packed = dealt.groupBy("shard").applyInPandas(fill, whole.schema)
    return whole.unionByName(packed)
