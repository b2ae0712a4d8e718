"""The prefix trie against a plain one built conversation by conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import __spark_entry__ as E
from carelake.llm import queries, trie
from carelake.llm.common import table
from oracle_harness import compare, duck

RNG = random.Random(12)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(seqs):
    """``seqs``: conv_id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        total[p] = (sum(total[x][0] for x in kids[p]) or 1, own + sum(total[x][1] for x in kids[p]))
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *total[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p in members)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def as_rows(seqs):
    return [(c, i, r, t) for c, s in seqs.items() for i, (r, t) in enumerate(s)]


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def random_sequences():
    words = [("user", "a"), ("assistant", "é b"), ("user", ""), ("", "a")]
    seqs = {}
    for c in range(120):
        s = list(RNG.choice(list(seqs.values()))) if seqs and RNG.random() < 0.6 else []
        s = s[:RNG.randint(0, len(s))] if s else s
        seqs[c * 3 - 40] = s + [RNG.choice(words) for _ in range(RNG.choice([0, 1, 2, 5, 17]))]
    seqs[5000] = [words[i % 2] for i in range(300)]
    seqs[5001] = [words[i % 2] for i in range(299)]
    return seqs


def test_trie_equals_a_plain_one(spark):
    seqs = random_sequences()
    turns = spark.createDataFrame(as_rows(seqs), "conv_id long, pos long, role string, text string").repartition(4)
    everyone = spark.createDataFrame([(c,) for c in seqs], "conv_id long")
    assert collected(trie.prefix_trie(trie.turn_digests(turns), everyone)) == plain_trie(seqs)


def test_query_equals_the_plain_trie_on_the_smallest_data(spark):
    sf = "/root/testdata/sf0.001"
    convs = defaultdict(list)
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r["turn"], r["role"], r["text"])):
        convs[r["conv_id"]].append((r["role"], r["text"]))
    assert collected(E.queries()["op12_prefix_trie"](spark, sf)) == plain_trie(rebuilt(convs))


def test_member_hashes_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_A_CHUNK", 7)
    ids = [RNG.randint(-10 ** 6, 10 ** 6) for _ in range(500)]
    ids = sorted(set(ids))
    ends = spark.createDataFrame([(d, 1, i) for d in (0, 3) for i in ids], "depth long, conv_id long, member long")
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(tuple(r) for r in trie.member_hashes(ends).collect()) == [(0, 1, want), (3, 1, want)]


HARD = [(1, None, "user", "x"), (1, 0, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "user", "é" * 50_000), (None, 1, "user", "lost"),
        (6, 0, "user", "only"), (10, 1, "user", "b"), (10, 0, "user", "b"), (10, 0, "a", "b")]
SCHEMA = "conv_id long, turn long, role string, text string, pos int, depth string, name int, parent int, h int, base int"


def test_hard_rows_and_an_empty_table(spark):
    rows = [(*r, 1, "d", 2, 3, 4, 5) for r in HARD]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    convs = defaultdict(list)
    for c, n, r, t in sorted((x for x in HARD if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs[c].append((r or "", t or ""))
    got = defaultdict(list)
    for r in sorted(turns.collect()):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == convs
    assert collected(trie.prefix_trie(trie.turn_digests(trie.share_openings(turns)), turns.select("conv_id"))) == plain_trie(rebuilt(convs))
    none = trie.ordered_turns(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(trie.turn_digests(trie.share_openings(none)), none.select("conv_id")).collect() == []


def test_query_matches_its_sql(spark):
    assert compare(E.queries()["op12_prefix_trie"](spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), queries.ORACLE["op12_prefix_trie"]) == []
