"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and
pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carelake.llm import chat, html_blocks, language, mixing, neardup, quality, sharding, tokens, warc, winnow
from carelake.llm.common import scratch_uri

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, size int, key string, __k int, v int, shard int"
LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(120_000))
PROSE = "the quick brown fox jumps over the lazy dog and then some more words follow here"


def rows():
    extra = (9, 8, "k", 7, 6, 5)
    base = [(1, PROSE, "en", "a", 5), (2, PROSE, "en", "b", 5), (2, PROSE, "en", "b", 5), (3, None, "en", "a", None), (4, "", None, None, 0),
            (5, LONG, "en", "a", 1), (None, PROSE + " null id", None, None, None), (None, None, None, None, None), (6, "\n\n \t\n", "de", "a", 3),
            (7, "12345 !!! ???", "de", "c", 3), (8, "été là où ça\x00 \U0001F600 naïve", "fr", "c", 3)]
    return [b + extra for b in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "quick brown"), (4, "quick brown")], "item_id long, text string")


def operators(spark, d):
    pages = d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "rank", "size", "v")
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("lang").alias("role"),
                     chat.text_parts(F.col("text")).alias("parts"), "size", F.col("key").alias("seen"))
    return {
        "warc": lambda: warc.archive(pages, scratch_uri(spark, "warc")),
        "quality": lambda: quality.apply_policy(quality.ledger(d)),
        "language": lambda: language.identify(d, language.train(d)),
        "html": lambda: html_blocks.extract(pages),
        "winnow": lambda: winnow.hit_words(winnow.contamination(d, items(spark))),
        "tokens": lambda: tokens.attribute(d),
        "sharding": lambda: sharding.shard_documents(d),
        "mixing": lambda: mixing.mix(mixing.document_sizes(d)),
        "neardup": lambda: neardup.near_duplicates(d),
        "chat": lambda: chat.loss_spans(chat.parse(chat.format_conversations(turns))),
    }


NAMES = ["warc", "quality", "language", "html", "winnow", "tokens", "sharding", "mixing", "neardup", "chat"]


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows(spark, docs, name):
    out = operators(spark, docs)[name]().collect()
    if name == "chat":  # rows of one id (null too) are one conversation
        assert len(out) == 9
    elif name != "tokens":
        assert len(out) == len(rows())
    else:
        assert {r["doc_id"] for r in out} == {1, 2, 5, 6, 7, 8, None}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    assert operators(spark, none)[name]().collect() == []


def stages(spark, d, tmp_path):
    items(spark).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return [f(spark, d, str(tmp_path)) for _, f in corpus_pipeline.STAGES]


def test_stages_on_hard_rows(spark, docs, tmp_path):
    lang, near, clean, mix, shard = stages(spark, docs, tmp_path)
    for out in (lang, near, clean, mix):
        assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in lang.collect()) == ["1", "2", "2", "5", "8", "None"]  # no letters: gone
    got = sorted(str(r.doc_id) for r in near.collect())
    assert got == ["1", "3", "4", "5", "6", "7", "8", "None"]  # 2 and the prose without an id are 1's copies; texts without words stay
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "6", "7", "8", "None"]
    assert set(mix.select("text").distinct().toPandas().text) <= set(docs.toPandas().text)
    placed = shard.collect()
    assert len(placed) == len(rows()) and [c for c in shard.columns if c != "slot" and c != "shard"] == [c for c in docs.columns if c != "shard"]
    sizes = [sum(r["shard"] == s for r in placed) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sizes[s]))


def test_stages_on_an_empty_table(spark, none, tmp_path):
    for out in stages(spark, none, tmp_path):
        assert out.collect() == []


def test_different_texts_of_one_id_stay_and_copies_without_an_id_go(spark):
    other = "a wholly different text about ships and harbours and the tides that move between them"
    rows = [(1, PROSE, "x", 1), (1, other, "x", 2), (2, PROSE, "x", 3), (None, other, "x", 4), (None, other, "x", 5), (3, "", "x", 6), (3, "", "x", 7),
            (4, PROSE + " and more", "x", 8), (5, "alone " + other[::-1], "x", 9), (5, "alone " + other[::-1], "x", 10), (None, None, "x", 11)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string, row int").repartition(3)
    got = neardup.keep_one(d)
    assert got.columns == d.columns
    stay = sorted((r["row"] for r in got.collect()))
    assert [r for r in stay if r not in (9, 10)] == [1, 2, 6, 7, 11] and len([r for r in stay if r in (9, 10)]) == 1


def test_rows_of_two_sources_take_their_own_copies(spark):
    """Equal id and text in two sources; three equal rows that the budget's edge parts."""
    rows = [(1, "w " * 30, "a"), (1, "w " * 30, "b"), (2, "v " * 10, "b"), (2, "v " * 10, "b"), (2, "v " * 10, "b"), (3, "u " * 70, "c"), (4, None, None)]
    d = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id long, text string, source string, copy int, __copy int")
    plan = mixing.mix(mixing.document_sizes(d)).collect()
    want = {}
    for r in plan:
        k = (r["doc_id"], r["source"])
        want[k] = want.get(k, 0) + r["epochs"] + (2 * r["extra"] > r["size"])
    out = mixing.mix_documents(d)
    assert out.columns == d.columns
    got = {(r["doc_id"], r["source"]): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert got == {k: n for k, n in want.items() if n} and len(set(want.values())) > 1


def test_items_without_an_id_are_hits(spark):
    d = spark.createDataFrame([(1, "so " + PROSE + " it ends"), (2, "nothing here")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in winnow.hit_words(winnow.contamination(d, items(spark))).collect()}
    assert found[1]["n_hit"] == 16 and found[1]["items"] == ["1", "4", None] and found[2]["n_hit"] == 0
    assert [r["doc_id"] for r in winnow.clean(d, items(spark).where("item_id is null")).collect()] == [2]


def test_overlapping_sections_and_null_ids(spark):
    rows = [(None, "one two three four", [(7, 0, 7), (8, 4, 13), (9, 5, 6)]), (-2 ** 63, "x", None), (3, "good row", [(1, 0, 8)]), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<section:long,start:long,end:long>>")
    got = sorted(((str(r["doc_id"]), r["section"], r["start"], r["end"]) for r in tokens.attribute(d).collect()))
    assert got == sorted([("None", 7, 0, 7), ("None", 8, 7, 13), ("None", 9, 13, 13), ("None", -1, 0, 18), (str(-2 ** 63), 0, 0, 1), ("3", 1, 0, 8)])


def test_archives_from_elsewhere_are_read(spark):
    import gzip
    import hashlib
    folder = scratch_uri(spark, "foreign")
    fs, path = warc.open_fs(folder)
    fs.create_dir(path, recursive=True)
    body = "<p>é</p>".encode()

    def rec(head, block):
        return b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    data = gzip.compress(rec(b"WARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\n", b"software: x\r\n")) + gzip.compress(
        rec(b'WARC-Type: response\r\nWARC-Target-URI: http://a/?"q\r\nWARC-Payload-Digest: sha256:ab\r\nContent-Type: application/http; msgtype=response\r\n',
            b"HTTP/1.1 200 OK\r\n\r\n" + body))
    with fs.open_output_stream(f"{path}/a.warc.gz", compression=None) as out:
        out.write(data)
    made = warc.normalise(spark.createDataFrame([(f"{folder}/a.warc.gz",)], "archive string"), f"{folder}/out")
    got = [(r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(made).orderBy("offset").collect()]
    info = b"software: x\r\n"
    assert got == [(None, None, "warcinfo", len(info), hashlib.sha1(info).hexdigest()), (None, 'http://a/?"q', "response", len(body), hashlib.sha1(body).hexdigest())]


def test_equal_turns_sort_by_raw_text(spark):
    rows = [(1, 0, "user", t) for t in ("<|", "<z", "<", "[INST]")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    assert [t["text"] for t in chat.parse(chat.format_conversations(d)).first()["turns"]] == sorted(["<|", "<z", "<", "[INST]"])


def test_a_stages_own_names_may_be_columns(spark, tmp_path):
    extra = ["__id", "__crc", "__first", "__rank", "__all", "_id", "_crc", "_first", "_rank", "_all", "copy", "_id_"]
    d = spark.createDataFrame([(*r[:5], *range(len(extra))) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long, "
                              + ", ".join(f"{c} int" for c in extra))
    for out in stages(spark, d, tmp_path)[:4]:
        assert out.columns == d.columns and out.count() > 0
    placed = stages(spark, d, tmp_path)[4]
    assert placed.columns == [*d.columns, "shard", "slot"] and placed.count() == len(rows()) and placed.select("_id_").distinct().count() == 1
