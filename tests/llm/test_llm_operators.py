"""The operators against brute force, exact round trips, held-out accuracy and small tables of cases."""

import gzip
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from carelake.llm import chat, graph, html_blocks, language, mixing, neardup, quality, queries, sharding, tokens, warc, winnow, words
from carelake.llm.common import ranked, scratch_uri, table
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"
RNG = random.Random(3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    assert compare(E.queries()[name](spark, SF), duck(SF), queries.ORACLE[name]) == []


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# words and ranks


def test_words_equal_the_patterns():
    texts = ["Ab c\tD", None, "", "é1_x\x0bÄB", "x", "yz" * 40, "\x7fq r"]
    for cls, pattern in ((words.NON_SPACE, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for size in (1, 8, 1 << 20):
            got = {}
            for w in words.words(pa.array(texts), cls, size):
                for r in range(w.hi - w.lo):
                    got[w.lo + r] = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.row(r)], w.end[w.row(r)])]
            assert [got[i] for i in range(len(texts))] == [re.findall(pattern, lower(t)) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    w = next(words.words(pa.array(["alpha beta alpha", "beta alpha"]), words.NON_SPACE))
    assert w.hash[0] == w.hash[2] == w.hash[4] != w.hash[1] == w.hash[3]


def test_ranked_is_a_running_sum_within_groups(spark):
    data = [(RNG.choice(["a", "a", "a", "b", None]), i, RNG.randint(0, 9)) for i in range(500)]
    got = ranked(spark.createDataFrame(data, "g string, k int, w int"), ["g", "k"], groups=["g"], weight="w", partitions=7).collect()
    assert len(got) == 500
    for r in got:
        assert r["before"] == sum(w for g, k, w in data if g == r["g"] and k < r["k"])


# 1: WARC


def test_archives_are_members_with_an_index(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "é" * 600), (2, None, "é" * 600), (3, "http://c", None), (None, "http://d", "é" * 600), (4, "u", "small")],
                                  "page_id long, url string, html string").coalesce(1)
    folder = scratch_uri(spark, "warc-test")
    mono = warc.write_monoliths(warc.payloads(pages), f"{folder}/m")
    assert mono.agg(F.sum("records")).first()[0] == 5
    arch = warc.normalise(mono, f"{folder}/r").collect()
    fs, path = warc.open_fs(arch[0]["archive"])
    raw = fs.open_input_stream(path, compression=None).read()
    source_fs, source = warc.open_fs(mono.first()["archive"])
    whole = source_fs.open_input_stream(source, compression=None).read()
    z = zlib.decompressobj(31)
    assert z.decompress(whole) == gzip.decompress(raw) and z.eof and z.unused_data == b""  # one stream before, same bytes after
    lines = [json.loads(x) for x in fs.open_input_stream(path + ".idx", compression=None).read().splitlines()]
    assert sum(x["length"] for x in lines) == len(raw)
    for x in lines:  # each record stands alone
        assert zlib.decompress(raw[x["offset"]:x["offset"] + x["length"]], 31).startswith(b"WARC/1.1\r\n")
    got = {r["page_id"]: r for r in warc.read_records(spark.createDataFrame(arch)).collect()}
    assert got[2]["record_type"] == "response" and got[1]["refers_to"] == 2 and got[None]["refers_to"] == 2
    assert got[1]["payload_bytes"] == 1200 and got[1]["payload_digest"] == hashlib.sha1(("é" * 600).encode()).hexdigest()
    assert got[1]["url"] == "http://a/\r\nx" and got[2]["url"] is None and got[3]["payload_bytes"] == 0


def test_inflater_rejects_cut_streams_and_reads_members():
    import io
    data = b"abc\r\n\r\n" * 50_000
    two = gzip.compress(data) + gzip.compress(data)
    s = warc.Inflater(io.BytesIO(two))
    assert b"".join(s.exactly(2 * len(data))) == data * 2 and s.until(b"x") is None
    with pytest.raises(ValueError):
        b"".join(warc.Inflater(io.BytesIO(two[:-20])).exactly(2 * len(data)))


# 2: quality ledger


def test_repeat_words_by_brute_force(spark):
    texts = [" ".join(RNG.choice("ab") for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 30, 80)] + ["a b c d e f g a b c d e x", "q " * 50]
    got = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        w = texts[r["doc_id"]].split()
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(hit))


def test_ablation_counts_from_bits(spark):
    bits = [0, 1, 3, 4, 4, 8, 12, 0, 64]
    led = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, fail_bits long")
    got = {r["rule"]: r for r in quality.ablation(led, "v1").collect()}
    assert (got["symbol_debris"]["n_fail"], got["symbol_debris"]["n_only"], got["symbol_debris"]["kept_without"], got["symbol_debris"]["kept"]) == (3, 2, 5, 3)
    assert quality.apply_policy(led, "base").where("kept").count() == 7
    assert {r["n_fail"] for r in quality.ablation(led.limit(0)).collect()} == {0}


def test_labelled_quality(spark):
    d = "/root/testdata/sf0.1"
    kept = quality.apply_policy(quality.ledger(table(spark, d, "documents"))).join(table(spark, d, "labels"), "doc_id")
    share = {r["quality"]: r["k"] for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1


# 3: language


def test_held_out_accuracy_and_mixtures(spark):
    d = table(spark, "/root/testdata/sf0.1", "documents")
    model = language.train(d)
    got = language.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    texts = {r["lang"]: r["t"] for r in d.where("length(text) between 1500 and 2500").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    raw = (texts["en"][:1500] + " " + texts["de"][:700]).encode()
    mix = dict(model.mixtures(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
    assert set(mix) == {"en", "de"} and 0.55 < mix["en"] < 0.85


def test_nothing_is_learned_from_held_out_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    model = language.train(spark.createDataFrame([(i, "some text here", "xx") for i in ids], "doc_id long, text string, lang string"))
    assert model.names == []


# 4: HTML


def test_block_tree_on_unseen_pages_and_odd_markup(spark):
    x, y = html_blocks.labelled_table(150, seed=1234)
    tree = html_blocks.train()
    assert (tree.predict(x) == y).mean() > 0.98
    page = ("<title>no</title><nav><a href='/'>Home</a></nav><div class='cookie-banner'>We use cookies to make this site better for you and us</div>"
            "<article><h1>Top &amp; more</h1><p>One<b> two\n three<br>four <p>Five &lt;six&gt; <script>var a='</p>x';</script>seven"
            "<!-- no --><div id=comments><p>First! I do not agree with a word of this</div></article><form><input>Sign up</form><footer>(c) us")
    page = page + "<" if False else page
    got = html_blocks.extract(spark.createDataFrame([(1, "u", page), (2, "u", "<p"), (3, "u", "<<>><a <b>")], "page_id long, url string, html string")).collect()
    assert got[0]["text"] == "Top & more\n\nOne two three four\n\nFive <six> seven"
    assert got[1]["text"] == ""


def test_articles_of_the_pages(spark):
    got = html_blocks.extract(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html_blocks.html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1|footer)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


# 5: winnowing


def test_winnowing_keeps_one_of_every_window():
    h = np.array([RNG.getrandbits(8) for _ in range(300)], np.uint64)
    at = winnow.winnow(h)
    assert all(any(i <= a < i + winnow.W for a in at) for i in range(len(h) - winnow.W + 1))


def brute_contamination(docs, items):
    def w(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    for d, t in docs:
        x, hit, names = w(t), set(), set()
        for i, s in items:
            y = w(s)
            m = min(10, len(y))
            grams = {tuple(y[j:j + m]) for j in range(len(y) - m + 1)} if m else set()
            for j in range(len(x) - m + 1 if m else 0):
                if tuple(x[j:j + m]) in grams:
                    hit |= set(range(j, j + m))
                    names.add(str(i))
        out[d] = (len(x), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_by_brute_force(spark, block_bytes):
    items = [(i, " ".join(RNG.choice("abc") for _ in range(RNG.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = [(i, " ".join(RNG.choice("abcABC") for _ in range(RNG.randint(0, 90))) + " " + RNG.choice(items)[1]) for i in range(40)]
    found = winnow.hit_words(winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                                  spark.createDataFrame(items, "item_id long, text string"), block_bytes)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found} == brute_contamination(docs, items)


# 6: token attribution


def test_tokens_add_up_and_edges_follow_the_rule(spark):
    d = table(spark, SF, "documents")
    total = None
    for rule in tokens.RULES:
        got = tokens.attribute(d, rule=rule).groupBy("doc_id").agg(F.round(F.sum("n_tokens"), 3).alias("n"))
        n = {r["doc_id"]: r["n"] for r in got.collect()}
        total = total or n
        assert n == total
    raw, size = open(tokens.RANKS, "rb").read(), None
    encoding, size = tokens._encoder(raw)
    for r in d.limit(50).collect():
        assert total[r["doc_id"]] == len(encoding.encode_ordinary(r["text"]))


def test_boundary_tokens():
    ends = np.array([4, 10, 12])  # tokens [0, 4) [4, 10) [10, 12)
    lo, hi = np.array([0, 5]), np.array([5, 11])
    assert [x.tolist() if hasattr(x, "tolist") else x for x in tokens.attribute_spans(ends, lo, hi, "first")] == [[2, 1], [1, 2], 0]
    assert [x.tolist() if hasattr(x, "tolist") else x for x in tokens.attribute_spans(ends, lo, hi, "most")] == [[1, 2], [1, 2], 0]
    got, _, outside = tokens.attribute_spans(ends, lo, hi, "split")
    assert np.allclose(got, [1 + 1 / 6, 5 / 6 + 0.5]) and outside == 0.5


def test_given_sections(spark):
    d = spark.sql("""select 1L doc_id, 'naïve text here' text, array(named_struct('section', 7L, 'start', 0L, 'end', 5L),
                     named_struct('section', 8L, 'start', 10L, 'end', 99L)) sections""")
    got = {r["section"]: r for r in tokens.attribute(d).collect()}
    assert set(got) == {7, 8, -1} and (got[8]["start"], got[8]["end"]) == (10, 15)


# 7: sharding


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_neighbours_touch(spark, n, bits):
    side = 1 << bits
    axes = [f"x{i}" for i in range(n)]
    grid = spark.range(side ** n).select("id", *[(F.floor(F.col("id") / side ** i) % side).alias(a) for i, a in enumerate(axes)])
    got = sorted(sharding.hilbert_index(grid, axes, bits).collect(), key=lambda r: r["curve"])
    assert [r["curve"] for r in got] == list(range(side ** n))
    assert all(sum(abs(a[x] - b[x]) for x in axes) == 1 for a, b in zip(got, got[1:]))


def test_shards_are_even_gapless_and_prune(spark):
    out = queries.op7_hilbert_shards(spark, SF).toPandas()
    d = table(spark, SF, "documents").toPandas().set_index("doc_id")
    for s, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1 and out["doc_id"].is_unique
    for r in out.itertuples():
        raw = d.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    langs = d.lang[out.doc_id].groupby(out.shard.values).nunique()
    assert langs.mean() < 3.5  # a shard holds few of the four languages


# 8: mixing


def water_fill(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_by_resharing(spark):
    for trial in range(4):
        sizes = {s: RNG.choice([0, 3, 50, 400, 9000]) for s in ["a", "b", "c", "d", None, "ä", "Z"]}
        got = mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()
        want = water_fill(sizes)
        for r in got:
            assert r["target"] == pytest.approx(want[r["source"]]), (trial, sizes)


def test_mix_meets_targets_and_prefers_quality(spark):
    out = queries.op8_weighted_mix(spark, SF).toPandas()
    again = queries.op8_weighted_mix(spark, SF).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 1).all()
    data = [(i, "s", 10, 1.0 if i % 2 else 0.1, 0) for i in range(2000)] + [(i, "t", 10_000, 1.0, 0) for i in range(2000, 2010)]
    m = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, size long, quality double, _crc long"), weights=(1, 9), budget=0.1).where("source = 's'")
    share = {r["quality"]: r["n"] for r in m.groupBy("quality").agg(F.avg("taken").alias("n")).collect()}
    assert share[1.0] > 1.5 * share[0.1]


# 9: near-duplicates


def brute_components(texts, percent=85):
    sets, root = {}, {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("long", [32, 3])
def test_near_duplicates_by_brute_force(spark, long):
    texts, base = [], [[f"w{RNG.randint(0, 10 ** 6)}" for _ in range(n)] for n in (4, 6, 40, 120, 300)]
    licence = [f"lic{i}" for i in range(60)]
    for i in range(260):
        w = list(RNG.choice(base))
        for _ in range(RNG.choice([0, 0, 1, 2, 4])):
            w[RNG.randrange(len(w))] = f"e{RNG.randint(0, 50)}"
        texts.append((i, " ".join(licence + w if RNG.random() < 0.4 else w).upper() if i % 7 == 0 else " ".join(licence + w if RNG.random() < 0.4 else w)))
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), long=long).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_the_documents(spark):
    d = table(spark, SF, "documents").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_components([tuple(r) for r in d.collect()])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)]
    RNG.shuffle(edges)
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}


# 10: chat


def test_escapes_are_reversible(spark):
    texts = ["".join(RNG.choice(["<", "|", "\\", "[", "INST]", "/", "s>", "a", "\n", "<|end|>", "</s>"]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.withColumn("e", chat.escape(F.col("t"))).where((chat.unescape(F.col("e")) != F.col("t")) | F.col("e").rlike(r"<\||</?s>|\[/?INST\]"))
    assert bad.collect() == []


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "look <|image:0|> ", None, None, None, None, None), ("image", None, "s3://i.png", 57, 28, None, None),
                            ("audio", None, "a.wav", None, None, 1.5, None), (None, "end", None, None, None, None, None)]),
            (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 3), ("text", "fine", None, None, None, None, None)]), (1, 2, "user", None)]
    out = chat.loss_spans(chat.parse(chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")))).first()
    assert "<|image:0|><|audio:1|>end" in out["formatted"] and r"look <\|image:0|> " in out["formatted"]
    assert [(a["turn"], a["type"], a["ref"], a["tokens"]) for a in out["attachments"]] == [(0, "image", "s3://i.png", 3), (0, "audio", "a.wav", 38), (1, "document", "d.pdf", 1800)]
    assert out["expanded_tokens"] == 1841 and [t["text"] for t in out["turns"]] == ["look <|image:0|> end", "fine", ""] and out["loss"] == ["fine"]


def test_control_strings_across_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rng = random.Random(5)
    bits = ["<", "|", "[", "INST]", "/INST]", "/", "s>", "\\", "end|>", "<|turn", "image:0|>", "", None, "IMAGE"]
    rows, want = [], {}
    for c in range(400):
        picked = [rng.choice(bits) for _ in range(rng.randrange(9))]
        parts = [("image", None, "r", 1, 1, None, None) if b == "IMAGE" else ("text", b, None, None, None, None, None) for b in picked]
        rows.append((c, 0, "user<", parts))
        rows.append((c, 1, "assistant", [("text", "ok", None, None, None, None, None)]))
        want[c] = ("".join(b or "" for b in picked if b != "IMAGE"), picked.count("IMAGE"))
    out = chat.loss_spans(chat.parse(chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))))
    got = {r["conv_id"]: r for r in out.collect()}
    assert {c: (r["turns"][0]["text"], len(r["attachments"])) for c, r in got.items()} == want
    assert all([t["role"] for t in r["turns"]] == ["user<", "assistant"] and r["loss"] == ["ok"] for r in got.values())
