"""What a reviewer found cut short."""

import re

import numpy as np
import pytest

from carelake.llm import html_blocks, language
from carelake.llm.common import table


# 3: language


def test_a_text_in_four_languages_has_four_shares(spark):
    d = table(spark, "/root/testdata/sf0.1", "documents")
    model = language.train(d)
    parts = {r["lang"]: r["text"] for r in d.where("length(text) > 4000").groupBy("lang").agg({"text": "min"}).withColumnRenamed("min(text)", "text").collect()}
    want = dict(zip(sorted(parts), (0.38, 0.30, 0.20, 0.12)))
    raw = " ".join(w for x, share in want.items() for w in re.findall(r"[^\W\d_]+", parts[x])[:int(500 * share)]).encode()
    mix = model.mixtures(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert [x for x, _ in mix] == list(want) and len(want) == 4
    assert all(abs(share - want[x]) < 0.02 for x, share in mix)


# 4: HTML


LAYOUTS = ['class="content has-sidebar"', 'class="main with-comments"', 'class="post hidden-print"', 'data-title="hidden gems"', 'data-id="search"',
           'class="post category-social"', 'id="content" class="no-sidebar"']


@pytest.mark.parametrize("attrs", LAYOUTS)
def test_articles_in_containers_of_other_sign_words(spark, attrs):
    text = ["A long headline of the story", " ".join(f"word{i}" for i in range(60)), " ".join(f"more{i}" for i in range(40))]
    inner = f"<h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p><div class='sidebar'>Read this too</div>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div {attrs}>{inner}</div><footer>Imprint</footer></body></html>"
    got = html_blocks.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "\n\n".join(text)


@pytest.mark.parametrize("name, attrs, sign", [
    ("div", ' class="post-footer"', "side"), ("div", ' class="content-ad"', "notice"), ("aside", ' class="content"', "side"),
    ("article", ' class="comment"', "comment"), ("div", ' class="content" role="navigation"', "menu"), ("div", ' class="content" hidden', "form"),
    ("div", ' class="post" style="display: none"', "form")])
def test_signs_that_still_overrule_the_article(name, attrs, sign):
    assert html_blocks._signs(name, attrs) == {sign}
