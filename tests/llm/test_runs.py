"""Periodic runs against a search of every period, on texts made to be hard and on whole documents."""

import hashlib
import random
import re
import zlib

import pytest

from carelake.llm import queries, runs
from carelake.llm.common import table

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)


def brute_runs(w):
    """Every (start, length, period) by trying every period at every word."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_kept(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


def hard_texts():
    out = ["", "a", "a a a a a", "a a a a a a", "x " + "a " * 50 + "y", "a b " * 40, "a b a b a b c " * 9, "A a A a A a A a"]
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 256:
        thue += thue.translate(str.maketrans("ab", "ba"))
    out += [" ".join(fib[-1]), " ".join(thue), " ".join("abcd" * 3 + "e" + "abcd" * 5), "é  x " * 12, "a\n\tb\x0b" * 30]
    for _ in range(60):
        n, k = RNG.randint(1, 200), RNG.randint(1, 3)
        w = [RNG.choice("abc"[:k]) for _ in range(n)]
        for _ in range(RNG.randint(0, 3)):  # plant repeats
            p, a = RNG.randint(1, 20), RNG.randint(0, n)
            w[a:a] = [str(RNG.randint(0, 5)) for _ in range(p)] * RNG.randint(3, 7)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("segment", [8, 32, runs.SEGMENT])
def test_runs_equal_the_search_of_every_period(spark, segment):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in runs.collapse(docs, segment).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = brute_runs(w)
        assert [tuple(r) for r in got[i]["runs"]] == want, t
        assert got[i]["collapsed"] == " ".join(brute_kept(w, want))


def test_segments_overlap_and_cover():
    for n in (1, 7, 8, 100, 5000):
        for a, z, least, most in runs.scales(n, 8):
            assert 0 <= a < z <= n and least <= most


def numpy_runs(w):
    """``brute_runs`` for whole documents: the agreement of each period as one array, smallest periods by divisors."""
    import numpy as np
    ids = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if w else np.zeros(0, int)
    found = []
    for q in range(1, len(ids) // 4 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(int)
        lo, hi = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(lo.tolist(), hi.tolist()):
            n = j - i + q
            if n >= max(6, 4 * q):
                part = ids[i:i + n]
                if not any(q % d == 0 and (part[:-d] == part[d:]).all() for d in range(1, q)):
                    found.append((i, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_query_equals_brute_force_over_whole_documents(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    rows = table(spark, SF, "documents").collect()
    assert len(got) == len(rows)
    seen = 0
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        want, x = numpy_runs(w), got[r["doc_id"]]
        seen += len(want)
        assert x["n_runs"] == len(want)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(" ".join(brute_kept(w, want)).encode()).hexdigest()
        best = min(want, key=lambda v: (-v[1], v[0], v[2])) if want else (None, None, None)
        assert (x["start"], x["length"], x["period"]) == best
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
    assert seen > 10


HARD = [(1, None, 1), (2, "", 1), (3, "a b " * 9, 2), (3, "a b " * 9, 2), (3, "c " * 7, 2), (None, "a b " * 9, 3), (None, None, 3),
        (4, " ".join(f"w{i % 3000}" for i in range(40_000)), 4)]


def test_hard_rows_and_an_empty_table(spark):
    schema = "doc_id long, text string, key int, runs int, period int, lo string"
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in HARD], schema)
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], len(r["collapsed"].split())) for r in runs.collapse(docs).collect())
    ab, c = [(0, 18, 2)], [(0, 7, 1)]
    assert got == sorted([("1", [], 0), ("2", [], 0), ("3", ab, 2), ("3", ab, 2), ("3", c, 1), ("None", ab, 2), ("None", [], 0),
                          ("4", [(0, 40_000, 3000)], 3000)])
    assert runs.collapse(spark.createDataFrame([], schema)).collect() == []
