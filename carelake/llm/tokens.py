"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole: a token that crosses a section's edge
is one token, as it is in training.  Each token's bytes give its character
span; an interval join with the sections' spans says which sections it touches,
and a rule gives it to exactly one of them (or shares it out):

    first   the section of its first character
    most    the section with most of its bytes, the earlier of equals
    split   to every section it touches, by its share of the bytes

What no section covers is counted under section -1, so counts always add up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: the split pattern that belongs to these merges (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most", "split")
#: a special token that is never allowed, so its string is ordinary text: without any, tiktoken looks for the empty string
#: at every place of a text, which is a third of the time
NO_TOKEN = "\x00no token\x00"
OUTSIDE = -1
MAX_RANKS_BYTES = 64 << 20

_loaded: dict[int, tuple] = {}


def _encoder(raw: bytes):
    """(encoding, bytes of each token), built once a worker."""
    key = hash(raw)
    if key not in _loaded:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={NO_TOKEN: len(size)}), size
    return _loaded[key]


def byte_places(text: str) -> tuple[bytes, np.ndarray]:
    """(UTF-8 bytes, byte offset of every code point and of the end)."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw, np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def attribute_spans(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens that end at byte ``ends`` (each begins where the last ended), over sections [lo, hi), sorted, not overlapping.

    -> (tokens of each section, tokens of it that cross one of its edges, tokens outside).
    """
    starts = np.concatenate(([0], ends[:-1]))
    n = len(lo)
    got, crossing = np.zeros(n), np.zeros(n, np.int64)
    if n == 0 or len(ends) == 0:
        return got, crossing, float(len(ends))
    # the interval join: the sections a token touches are those from a to b - 1 with any bytes
    a = np.searchsorted(hi, starts, side="right")
    b = np.searchsorted(lo, ends, side="left")
    whole = (b - a == 1) & (lo[np.minimum(a, n - 1)] <= starts) & (hi[np.minimum(a, n - 1)] >= ends)
    np.add.at(got, a[whole], 1)
    outside = float(np.count_nonzero(b <= a))
    for t in np.flatnonzero(~whole & (b > a)).tolist():  # at most a few a section's edge
        touched = [s for s in range(a[t], b[t]) if hi[s] > lo[s]]
        part = [min(ends[t], hi[s]) - max(starts[t], lo[s]) for s in touched]
        crossing[touched] += 1
        size = ends[t] - starts[t]
        if rule == "split":
            for s, p in zip(touched, part):
                got[s] += p / size
            outside += (size - sum(part)) / size
        elif rule == "most":
            k = int(np.argmax(part)) if part else -1
            if k >= 0 and part[k] >= size - sum(part):
                got[touched[k]] += 1
            else:
                outside += 1
        else:
            first = [s for s in touched if lo[s] <= starts[t]]
            if first:
                got[first[0]] += 1
            else:
                outside += 1
    return got, crossing, outside


def attribute(docs: DataFrame, ranks: str = RANKS, rule: str = "first") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for documents with ``text`` and ``sections``.

    ``sections``: array of (section, start, end), spans in code points; where
    two overlap, the later one begins at the end of the earlier; or null for the text's lines, numbered from 0, each with its
    line break.  A row with section -1 holds what lies outside, if anything
    does.  Null and empty texts have no tokens and no rows of lines.  The rank
    file is read by the driver and sent along.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks, "rb") as f:
        raw_ranks = f.read(MAX_RANKS_BYTES + 1)
    if len(raw_ranks) > MAX_RANKS_BYTES:
        raise ValueError("the rank file is too large to send")
    sent = docs.sparkSession.sparkContext.broadcast(raw_ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoder(sent.value)
        out: list[list] = [[] for _ in range(6)]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            cols = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.float64(), pa.int64()))]
            cols[0] = ids.cast(pa.int64()).take(cols[0])  # rows of the batch: an id may be null
            for c in out:
                c.clear()
            held = 0
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

        for batch in batches:
            ids = batch.column(0)
            for r, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                spans = batch.column(2)[r].as_py()
                raw, place = byte_places(text)
                ends = np.cumsum(size[encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())]) if raw else np.zeros(0, np.int64)
                chars = len(place) - 1
                if spans is None:  # lines
                    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
                    hi = np.append(breaks, len(raw)) if len(raw) and (not len(breaks) or breaks[-1] < len(raw)) else breaks
                    lo = np.concatenate(([0], hi[:-1])) if len(hi) else hi
                    start, end, name = np.searchsorted(place, lo), np.searchsorted(place, hi), np.arange(len(hi))
                else:
                    spans = sorted((s for s in spans if s and None not in s.values()), key=lambda s: (s["start"], s["end"]))
                    name = np.array([s["section"] for s in spans], np.int64)
                    start = np.clip(np.array([s["start"] for s in spans], np.int64), 0, chars)
                    end = np.maximum(start, np.clip(np.array([s["end"] for s in spans], np.int64), 0, chars))
                    taken = np.maximum.accumulate(np.concatenate(([0], end)))[:-1]
                    start = np.maximum(start, taken)
                    end = np.maximum(start, end)
                    lo, hi = place[start], place[end]
                got, crossing, outside = attribute_spans(ends, lo, hi, rule)
                if outside > 1e-9:
                    name, start, end = np.append(name, OUTSIDE), np.append(start, 0), np.append(end, chars)
                    got, crossing = np.append(got, outside), np.append(crossing, 0)
                for c, v in zip(out, ([r] * len(name), name, start, end, got, crossing)):
                    c.append(np.asarray(v))
                held += len(name)
                if held >= 20_000:
                    yield flush()
            if held:
                yield flush()
    cols = docs.columns
    sections = F.col("sections") if "sections" in cols else F.lit(None)
    sections = sections.cast("array<struct<section:long,start:long,end:long>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", sections.alias("sections"))
    return rows.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens double, n_crossing long")
