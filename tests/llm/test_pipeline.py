"""The pipeline's run() against a plain Python version of its stages."""

import math
import re

from pyspark.sql import functions as F

import corpus_pipeline
from carelake.llm import language, mixing
from carelake.llm.common import table
from test_llm_operators import SF, brute_components, brute_contamination, water_fill


def test_run_equals_the_plain_version(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    docs = table(spark, SF, "documents")
    pred = {r["doc_id"]: r for r in language.identify(docs, language.train(docs)).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if pred[r["doc_id"]]["lang_pred"] != "und" and pred[r["doc_id"]]["score"] >= 0.4}
    comp = brute_components([(i, r["text"]) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if comp[i][1] == i}
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    hit = brute_contamination([(i, r["text"]) for i, r in rows.items()], items)
    rows = {i: r for i, r in rows.items() if hit[i][1] == 0}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in rows.items()}
    per = {}
    for i, r in rows.items():
        per[r["source"]] = per.get(r["source"], 0) + size[i]
    target = water_fill(per)
    # the sampling keys come from a hash that only Spark has
    keyed = mixing.document_sizes(docs).withColumn("u", mixing.uniform(F.lit(17), F.col("doc_id"), F.col("_crc"))).collect()
    key = {r["doc_id"]: -math.log(r["u"]) / r["quality"] for r in keyed}
    want = []
    for s in per:
        epochs = math.floor(target[s] / per[s] + 1e-12)
        left = round(target[s] - epochs * per[s])
        for i in sorted((i for i in rows if rows[i]["source"] == s), key=key.get):
            extra = min(size[i], max(0, left))
            left -= size[i]
            want += [i] * (epochs + (2 * extra > size[i]))
    assert sorted(got["doc_id"]) == sorted(want)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(p["slot"]) == list(range(len(p))) for _, p in got.groupby("shard"))
    assert all(rows[r.doc_id]["text"] == r.text for r in got.itertuples())
