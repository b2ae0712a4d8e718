"""Retrieval packing: ids against the tokenizer's own, pieces put back together, windows against a plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carelake.llm import packing, queries
from carelake.llm.common import table

SF = "/root/testdata/sf0.01"
RNG = random.Random(13)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def encode(texts):
    raw = packing.read_ranks(packing.RANKS)
    return [packing.encode(raw, t).tolist() for t in texts]


def own(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


SIGNS = "ab éß中 0٣²½'\"!-_ \t\n\x0b\x1c\x85\xa0 ​　\U0001F600strmdvel"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(SIGNS), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=5))
def test_ids_are_the_tokenizers(tokenizer, texts):
    assert encode(texts) == [own(tokenizer, t) for t in texts]


def test_ids_of_contractions_and_special_strings(tokenizer):
    texts = ["don't we'll 'tis a''s x's's '", "they've\n's !'s ?'re I'm'd", "'", "'ll", "a  b   c \n\n d\t e ", " <|endoftext|> x", ""]
    assert encode(texts) == [own(tokenizer, t) for t in texts]


def test_ids_of_every_document(spark, tokenizer):
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()]
    assert encode(texts) == [own(tokenizer, t) for t in texts]


def rebuild(pieces, docs, tokenizer, window=1024):
    """Every document's ids from its pieces, and the sequences checked on the way; -> padding ids."""
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append(p)
    padding = 0
    for s in by_seq.values():
        s.sort(key=lambda p: p["offset"])
        end = 0
        for p in s:
            assert p["offset"] == end and p["length"] > 0
            end += p["length"]
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    want = Counter()
    for i, t in docs:
        ids = np.array(own(tokenizer, t) + [0], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    got = Counter()
    per = defaultdict(list)
    for p in pieces:
        per[p["doc_id"]].append(p)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(np.array(own(tokenizer, t) + [0], "<u4"))
    for i, ps in per.items():
        for ids in texts[i]:  # rows that share an id: each takes the pieces that are its own
            at = 0
            while at < len(ids):
                p = next(p for p in ps if p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes()))
                ps.remove(p)
                at += p["length"]
            got[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert not ps
    assert got == want
    return padding


def test_query_places_every_id_once_with_little_padding(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    pieces = queries.QUERIES["op13_retrieval_packing"](spark, SF).collect()
    padding = rebuild(pieces, docs, tokenizer)
    assert padding < 0.01 * sum(p["length"] for p in pieces)


def plain_fill(units, idf, mean, window):
    """The same greedy rule with dictionaries, every unit scored term by term."""
    tf = [Counter(u.tolist()) for u in units]
    at, out, seed, sequence = [0] * len(units), [], None, 0
    while True:
        if seed is None:
            seed = next((u for u in range(len(units)) if at[u] == 0), None)
            if seed is None:
                return out
        query, room, cut_unit, turn = set(units[seed][at[seed]:].tolist()), window, None, [seed]
        scored = False
        while room:
            if not turn:
                if scored:
                    break
                scored = True
                free = [u for u in range(len(units)) if at[u] == 0]
                score = {u: round(math.fsum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(units[u]) / mean)) for t, n in tf[u].items() if t in query), 6) for u in free}
                turn = sorted(free, key=lambda u: (-score[u], u))
                continue
            u = turn.pop(0)
            n = min(room, len(units[u]) - at[u])
            out.append((u, at[u], n, sequence, window - room))
            at[u], room = at[u] + n, room - n
            if at[u] < len(units[u]):
                cut_unit = u
        sequence, seed = sequence + 1, cut_unit


def test_windows_equal_a_plain_bm25():
    for trial in range(12):
        units = [np.array([RNG.choice(range(1 + trial * 5, 40 + trial * 9)) for _ in range(RNG.randint(1, 60))]) for _ in range(80)]
        df = np.zeros(400)
        for u in units:
            df[np.unique(u)] += 1
        idf, mean = packing.inverse_frequencies(df, len(units)), sum(map(len, units)) / len(units)
        got = packing.fill_windows(units, idf, mean, 64)
        assert got == plain_fill(units, idf, mean, 64)
        ends = [sum(p[2] for p in got if p[3] == s) for s in range(got[-1][3] + 1)]
        assert all(e == 64 for e in ends[:-1])


def test_neighbours_share_words(spark):
    """Documents of three unlike vocabularies: windows hold one vocabulary, but where one runs out."""
    rows = [(i, " ".join(RNG.choice(["red green blue", "one two three four", "cat dog bird fish"][i % 3].split()) for _ in range(60))) for i in range(300)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512).collect()
    kinds = defaultdict(set)
    for p in pieces:
        kinds[p["sequence_id"]].add(p["doc_id"] % 3)
    assert sum(len(k) == 1 for k in kinds.values()) >= len(kinds) - 3


def test_hard_rows_and_an_empty_table(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other text"), (None, "no id"), (None, None), (4, " ".join(f"w{i}" for i in range(5000)))]
    schema = "doc_id long, text string, size int, shard int, tail string, crc int, before int, sign0 int"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], schema).repartition(3)
    pieces = packing.pack(docs, shard_tokens=64, window=16).collect()
    rebuild(pieces, rows, tokenizer, 16)
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []
