"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import chat, html_blocks, language, mixing, neardup, packing, quality, runs, sharding, tokens, trie, warc, winnow
from carelake.llm.common import cut, scratch_uri, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op2_quality_ledger", r"""
WITH w AS (SELECT doc_id, coalesce(text, '') t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l
           FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM w, unnest(generate_series(1, len(w) - 4)) AS s(i) WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + j) n FROM twice, generate_series(0, 4) AS s(j) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, len(regexp_extract_all(t, '[A-Z]'))::BIGINT n_upper,
             len(l)::BIGINT n_lines, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(n, 0)::BIGINT n_repeat_words
      FROM w LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
                 + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
                 + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
                 + 64 * (100 * n_upper > 40 * word_chars)::BIGINT)::BIGINT fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 127) = 0 AS kept, n_upper, n_lines, fail_bits, 'v2' AS policy
FROM b
""")
def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE.mask).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                      (~base & F.col("kept")).alias("kept"), "n_upper", "n_lines", "fail_bits", "policy")


@register("op7_hilbert_shards")
def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


@register("op8_weighted_mix")
def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.document_sizes(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "extra")


@register("op10_chat_parts", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
                + length(regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
                + length('<|turn|><|body|><|end|>') AS f FROM c),
a AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) s,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') l, sum(f) f
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(s) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256,
       f::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM a
""")
def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rows = rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    out = chat.loss_spans(chat.parse(chat.format_conversations(rows)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("_loss", F.array_join("loss", ""))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                      F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"),
                      F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")


@register("op9_bottom_k_near_duplicates")
def op9_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_language_mixture")
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score",
                        F.concat_ws(",", F.transform("mixture", lambda m: m["lang"])).alias("languages"))


@register("op5_winnowing", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
       FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) s(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g
       FROM d, (SELECT DISTINCT m FROM bw), unnest(generate_series(1, len(w) - m + 1)) s(i) WHERE len(w) >= m),
hit AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT i + j) n_hit FROM hit, unnest(generate_series(0, m - 1)) s(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) x
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(x, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.hit_words(winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op4_block_tree")
def op4_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


@register("op1_warc_members", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) d FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) keeper FROM p)
SELECT page_id, n::BIGINT payload_bytes, d payload_digest, CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END refers_to FROM k
""")
def op1_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"), scratch_uri(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_token_spans")
def op6_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses a line's end counts where it begins."""
    out = tokens.attribute(table(spark, sf_dir, "documents"), rule="first")
    return out.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(runs.repeat_tails(table(spark, sf_dir, "documents"))).withColumn("best", runs.best_run())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op12_prefix_trie", r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h
      UNION ALL
      SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(n.n, 0)), t.role, t.text
      FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN n ON n.conv_id = c.base WHERE t.pos >= c.h),
p AS (SELECT conv_id, pos + 1 AS d, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k,
             octet_length(encode(text)) AS b FROM r
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(b) AS own FROM p GROUP BY d, k),
up AS (SELECT nodes.*, q.conv_id AS parent FROM nodes LEFT JOIN p ON p.conv_id = nodes.conv_id AND p.d = nodes.d - 1
       LEFT JOIN nodes q ON q.d = p.d AND q.k = p.k),
kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS m FROM up WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT up.*, coalesce(m, 0) AS m FROM up LEFT JOIN kids USING (d, conv_id)),
sums AS (SELECT a.d, a.k, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN f.d > 0 THEN own ELSE 0 END) AS saved
         FROM full_ f JOIN p a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY ALL),
ends AS (SELECT d, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY d, k)
SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, m::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ JOIN sums USING (d, k) LEFT JOIN ends USING (d, k)
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(trie.turn_digests(trie.ordered_turns(table(spark, sf_dir, "conversations"))))
    return trie.prefix_trie(trie.share_openings(turns), turns.select("conv_id"))


@register("op13_retrieval_packing")
def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))
