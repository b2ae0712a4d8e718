"""Periodic runs of words, found on tiles of every scale and stitched across them.

A run is a stretch of words with smallest period q that is at least
max(6, 4 q) words long and that neither neighbour extends.  Periods are taken
by octaves P <= q < 2 P.  For each octave a document is covered with
overlapping tiles around boundaries 2 P apart; a tile holds the 2 P words before
its boundary b and the 6 P after it.  Tiles are solved on their own: the Z-function of the
words after b gives, for every q at once, how far the words agree with those q
further on; a q is kept if the first 2 q words are a square whose root is no
repetition itself (at most a few per boundary, also in a text of one word), and
the agreement before b is read backwards.  Every run has a boundary in its
first 2 P words of agreement, and the kept fragments of one run touch or overlap, so
fragments of one document and period are stitched by a sweep over their
intervals.

Documents of at most ``SEGMENT`` words are tiled, solved and stitched where they
are read.  Longer ones become segments: those of scale s are 8^s times
``SEGMENT`` words apart, overlap by as much, and answer for three octaves, so
a document is dealt over many tasks and its fragments meet again
by (document, period).

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carelake.llm.common import WORD, cut, text_key, union_all
from carelake.llm.words import NON_SPACE, mix, words

SEGMENT = 1 << 13
LEAST_LENGTH = 6
LEAST_PERIODS = 4
#: runs (some 30 bytes each) whose documents may be broadcast; beyond, the join with the texts shuffles
BROADCAST_RUNS = 1_000_000
FRAGMENTS = "doc_id long, key long, period long, lo long, hi long"

Intervals = tuple[np.ndarray, np.ndarray, np.ndarray]  # period, lo, hi: words lo <= i < hi equal those at i + period


def z_function(s: list, upto: int) -> list[int]:
    """z[d], 1 <= d < upto: how many words from d on equal the first ones (z[0] is left 0)."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(x: np.ndarray, b: int, p: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi) of the primitive squares at ``b`` with period in [p, 2 p), extended over the tile."""
    ahead = x[b:b + 6 * p]
    if len(ahead) < 2 * p:
        return []
    z = np.array(z_function(ahead.tolist(), min(2 * p, len(ahead) // 2 + 1)))
    reach = np.maximum.accumulate(z + np.arange(len(z)))
    q = np.arange(p, len(z))
    q = q[(z[q] >= q) & (reach[q - 1] < 2 * q)]  # no smaller period reaches over the square
    found = []
    for d in q.tolist():
        room = min(b, 2 * p)
        differ = np.flatnonzero(x[b - room:b] != x[b + d - room:b + d])
        found.append((d, b - room + (int(differ[-1]) + 1 if len(differ) else 0), b + int(z[d])))
    return found


def stitch(period: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Intervals:
    """Intervals of one period that touch or overlap become one."""
    if len(lo) == 0:
        return period, lo, hi
    order = np.lexsort((lo, period))
    period, lo, hi = period[order], lo[order], hi[order]
    shift = (np.cumsum(np.concatenate(([0], np.diff(period) != 0)))) * (int(hi.max()) + 1)
    top = np.maximum.accumulate(hi + shift)
    new = np.concatenate(([True], (lo + shift)[1:] > top[:-1]))
    new[1:] |= np.diff(period) != 0
    first = np.flatnonzero(new)
    return period[first], lo[first], np.maximum.reduceat(hi, first)


def solve_octave(x: np.ndarray, p: int, ends: np.ndarray, known: Intervals) -> Intervals:
    """Fragments of periods in [p, 2 p).  ``ends``: for every word the end of its document; ``known``: the stitched
    fragments of all smaller periods, whose multiples need no tile."""
    n, step = len(x), 2 * p
    tiles = -(-n // step)
    padded = np.concatenate((x, np.zeros(tiles * step - n + 4 * p, x.dtype)))
    grid = padded[:tiles * step].reshape(tiles, step)
    row, col = np.nonzero(grid[:, p:] == grid[:, :1])
    b, q = row * step, col + p
    for off in sorted({1, p // 2, p - 1} - {0}):  # words that a square at b must repeat
        same = padded[b + off] == padded[b + q + off] if off < p else slice(None)
        b, q = b[same], q[same]
    b = np.unique(b[b + 2 * q <= ends[b]])
    period, lo, hi = known
    if len(lo) and len(b):
        order = np.argsort(lo)
        top = np.maximum.accumulate((hi + period)[order])
        at = np.searchsorted(lo[order], b, side="right") - 1
        covered = (at >= 0) & (top[np.maximum(at, 0)] >= np.minimum(b + 4 * p - 2, ends[b]))
        b = b[~covered]
    found = [f for i in b.tolist() for f in solve_tile(x, i, p)]
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)  # type: ignore[return-value]


def solve(x: np.ndarray, ends: np.ndarray, least: int, most: int) -> Intervals:
    """The stitched fragments of the octaves ``least`` .. ``most`` (powers of 2) of a row of word hashes (never 0)."""
    known: Intervals = (np.zeros(0, np.int64),) * 3
    p = least
    while p <= most:
        new = solve_octave(x, p, ends, known)
        if len(new[0]):
            known = stitch(*(np.concatenate(c) for c in zip(known, new)))
        p *= 2
    return known


def long_enough(period, lo, hi):
    length = hi - lo + period
    return (length >= LEAST_LENGTH) & (length >= LEAST_PERIODS * period)


def _batch(doc_id: pa.Array, key: pa.Array, row: np.ndarray, found: Intervals) -> pa.RecordBatch:
    rows = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([doc_id.take(rows), key.take(rows), *[pa.array(c, pa.int64()) for c in found]],
                                      ["doc_id", "key", "period", "lo", "hi"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one segment: all tiles of a chunk of texts at once, as words of different rows never agree."""
    for batch in batches:
        for w in words(batch.column(2), NON_SPACE, lower=False):
            n = np.diff(w.first)
            if not len(n) or n.max() < LEAST_LENGTH:
                continue
            x = w.hash ^ np.repeat(mix(np.arange(1, len(n) + 1, dtype=np.uint64)), n)
            most = 1 << (int(n.max()) // LEAST_PERIODS).bit_length() - 1
            period, lo, hi = solve(x, np.repeat(w.first[1:], n), 1, most)
            ok = long_enough(period, lo, hi)
            period, lo, hi = period[ok], lo[ok], hi[ok]
            row = np.searchsorted(w.first, lo, side="right") - 1
            lo, hi = lo - w.first[row], hi - w.first[row]
            yield _batch(batch.column(0), batch.column(1), row + w.lo, (period, lo, hi))


def scales(n: int, segment: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, least octave, most octave) of the overlapping segments of a document of n words."""
    step, least = segment, 1
    while LEAST_PERIODS * least <= n:
        most = step // 8
        for at in range(0, n, step):
            # tiles reach 2 x most back and 6 x most on; all scales keep one grid of boundaries
            yield max(0, at - 2 * most), min(n, at + step + 6 * most), least, most
        least, step = 2 * most, step * 8


def _segments(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n", "at", "least", "most", "ids"]
        for batch in batches:
            for w in words(batch.column(2), NON_SPACE, lower=False):
                for r in range(w.hi - w.lo):
                    h = w.hash[w.row(r)]
                    if not len(h):
                        continue
                    ids = np.unique(h, return_inverse=True)[1].astype(np.int32) + 1
                    which = pa.array([w.lo + r], pa.int64())
                    for a, z, least, most in scales(len(ids), segment):  # a row at a time: the overlap is never held whole
                        cols = [pa.array([v], pa.int64()) for v in (len(ids), a, least, most)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *cols,
                                                          pa.array([ids[a:z].tobytes()], pa.binary())], names)
    return run


def _solve_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, (n, at, least, most, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 7)))):
            x = np.frombuffer(ids, np.int32)
            end = len(x)
            period, lo, hi = solve(x, np.full(end, end), least, min(most, 1 << (n // LEAST_PERIODS).bit_length() - 1))
            # what ends at an edge of the segment may go on in the next one
            open_ = ((lo == 0) & (at > 0)) | ((hi + period == end) & (at + end < n))
            ok = open_ | long_enough(period, lo, hi)
            found = (period[ok], lo[ok] + at, hi[ok] + at)
            if ok.any():
                yield _batch(batch.column(0), batch.column(1), np.full(int(ok.sum()), r), found)


def fragments(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, key, period, lo, hi): stitched fragments of whole documents, and of the segments of longer ones."""
    docs = docs.select("doc_id", text_key().alias("key"), "text")
    # n words have 2 n - 1 characters at least
    longer = F.coalesce(F.length("text"), F.lit(0)) >= 2 * segment
    short = docs.where(~longer).mapInArrow(_whole, FRAGMENTS)
    dealt = docs.where(longer).mapInArrow(_segments(segment), "doc_id long, key long, n long, at long, least long, most long, ids binary")
    dealt = dealt.repartition("key", "at", "most")
    return union_all([short, dealt.mapInArrow(_solve_segments, FRAGMENTS)])


def find_runs(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, key, runs) of the documents that have runs: array of (start, length, period) by start, then period.

    ``key`` is the text's hash: rows that share id and text share a row here.
    """
    per = Window.partitionBy("doc_id", "key", "period").orderBy("lo", "hi")
    before = per.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int")
    parts = fragments(docs, segment).withColumn("_new", new).withColumn("_run", F.sum("_new").over(per))
    whole = parts.groupBy("doc_id", "key", "period", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    length = (F.col("hi") - F.col("lo") + F.col("period")).alias("length")
    whole = whole.select("doc_id", "key", F.struct(F.col("lo").alias("start"), length, "period").alias("run"))
    whole = whole.where(F.col("run.length") >= F.greatest(F.lit(LEAST_LENGTH), LEAST_PERIODS * F.col("run.period")))
    # (start, period) order: of two runs that start together the shorter period isn't always the shorter run
    by_place = F.transform(F.array_sort(F.collect_list(F.struct(F.col("run.start").alias("a"), F.col("run.period").alias("b"), "run"))), lambda r: r["run"])
    return whole.groupBy("doc_id", "key").agg(by_place.alias("runs"))


@F.pandas_udf(StringType())
def _kept_words(texts: pd.Series, starts: pd.Series, lengths: pd.Series, periods: pd.Series) -> pd.Series:
    out: list[str | None] = [None] * len(texts)
    for i, (text, start, length, period) in enumerate(zip(texts, starts, lengths, periods)):
        if text is None or start is None:
            continue
        w = next(words(pa.array([text]), NON_SPACE, 1 << 62, lower=False))
        # +1 where a run's repeats begin, -1 after its end
        edge = np.bincount(np.asarray(start) + np.asarray(period), minlength=len(w.start) + 1)
        edge = edge - np.bincount(np.asarray(start) + np.asarray(length), minlength=len(edge))
        raw, keep = w.data.tobytes(), np.cumsum(edge)[:len(w.start)] == 0
        out[i] = b" ".join([raw[a:z] for a, z in zip(w.start[keep].tolist(), w.end[keep].tolist())]).decode("utf-8", "replace")
    return pd.Series(out, dtype=object)


def collapse(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, runs, collapsed), one row per row of ``docs``: its runs, and its words without the repeats of any run
    (all words of a run after its first period), joined by one space.

    Null and empty texts have no words: no runs (an empty array) and an empty
    text.  A null id is kept as such; rows that share id and text get equal
    results.  Other columns are left out.  Memory follows the longest text.
    """
    found = cut(find_runs(docs, segment))
    total = found.agg(F.sum(F.size("runs"))).first()[0] or 0
    if total <= BROADCAST_RUNS:
        found = F.broadcast(found)
    rows = docs.select("doc_id", "text", text_key().alias("key")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key"))
    rows = rows.join(found.alias("r"), same, "left").select("d.doc_id", "d.text", "r.runs")

    def part(name: str) -> Column:
        return F.transform("runs", lambda r: r[name])
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    with_runs = _kept_words(F.when(F.col("runs").isNotNull(), F.col("text")), part("start"), part("length"), part("period"))
    return rows.select("doc_id", F.coalesce("runs", F.array().cast("array<struct<start:long,length:long,period:long>>")).alias("runs"),
                       F.when(F.col("runs").isNull(), plain).otherwise(with_runs).alias("collapsed"))


def best_run(runs: str = "runs") -> Column:
    """The run of greatest length, of equals that of smallest start, then period; null where there is none."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"),
                       lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """A test corpus from a real one: (doc_id, text), in every tenth document (by checksum h of the id) each word i from a on
    becomes word a + (i - a) % p, with a and p drawn from h.  Other texts, and those without words, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)

    def rebuilt(s: Column) -> Column:
        g, n = s["g"], F.size(s["w"]).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.when(n > 0, F.array_join(F.transform(s["w"], lambda _, i: F.element_at(s["w"], F.when(i < a, i + 1).otherwise(a + F.pmod(i - a, p) + 1).cast("int"))), " "))
    cut_ = F.transform(F.array(F.struct(F.floor(h / 10).alias("g"), w.alias("w"))), rebuilt)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(cut_, F.col("text"))).otherwise(F.col("text")).alias("text"))
