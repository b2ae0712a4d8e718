"""Language mixtures against a plain search of every set size, without a bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import language
from carelake.llm.common import table

SF = "/root/testdata/sf0.001"


def _plain(model, text):
    """[(penalised fit, {language: share})] of the sets of 1, 2, .. of the largest shares, one text at a time."""
    raw = np.frombuffer(text.encode(), np.uint8)
    grams, first, _ = language._trigrams(raw, np.array([0, len(raw)]))
    if len(first) == 0:
        return []
    ll = np.array([model.table[g].astype(float).sum(axis=0) for g in np.split(grams, first[1:])])
    like, n = np.exp(ll - ll.max(axis=1, keepdims=True)), len(ll)

    def em(part, share, rounds):
        for _ in range(rounds):
            r = part * share
            share = (r / r.sum(axis=1, keepdims=True)).sum(axis=0) / n
        return share
    share = em(like, np.full(ll.shape[1], 1 / ll.shape[1]), language.ROUNDS)
    out = []
    for m in range(1, ll.shape[1] + 1):
        chosen = np.argsort(-share, kind="stable")[:m]
        s = np.maximum(share[chosen], 1e-6)
        s = em(like[:, chosen], s / s.sum(), language.MORE_ROUNDS if m > 1 else 0)
        fit = np.log(np.maximum(like[:, chosen] @ s, 1e-30)).sum() - language.PENALTY * 0.5 * (m - 1) * np.log(n)
        out.append((fit, {model.names[i]: x for i, x in zip(chosen, s)}))
    return out


def _equal(model, texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
    sizes = []
    for text, got in zip(texts, model.mixtures(np.frombuffer(b"".join(raw), np.uint8), offs)):
        want = _plain(model, text)
        if not want:
            assert got == []
            continue
        fit, top = next(x for x in want if len(x[1]) == len(got))
        assert fit >= max(f for f, _ in want) - 1e-3 * (1 + abs(fit)) * 1e-2   # the best, but for rounding
        shares = dict(got)
        assert sum(abs(shares.get(k, 0) - v) for k, v in top.items()) < 5e-3
        assert [x for _, x in got] == sorted(shares.values(), reverse=True)
        sizes.append(len(got))
    return sizes


def test_mixtures_equal_the_search_of_every_set(spark):
    d = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language.train(d)
    texts = [r.text for r in d.where("text is not null").orderBy("doc_id").collect()]
    some = [" ".join(t.split()[:40]) for t in texts[:60]]
    mixed = [" ".join(some[i:i + k]) for i in range(0, 50, 5) for k in (2, 4, 6)]
    sizes = _equal(model, texts + mixed + ["", "?!", "a"])
    assert max(sizes) >= 3 and min(sizes) == 1


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(7)
    names = [f"l{i:02d}" for i in range(30)]
    table = rng.gamma(0.3, 1.0, (language.BUCKETS, len(names))) + 0.01
    return language.Model(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def _words(rng, k):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 9))) for _ in range(k))


def test_many_languages(many):
    """Words of no language in particular: sets are large, and nothing that the bound leaves out would have won."""
    rng = np.random.default_rng(3)
    assert max(_equal(many, [_words(rng, k) for k in (1, 2, 3, 5, 10, 40, 200, 1000)])) > 3


def test_sets_that_cannot_win_are_not_tried(spark, monkeypatch):
    """Texts in one language cost one set, however many languages there are."""
    d = table(spark, SF, "documents").select("doc_id", "text", "lang").where(F.length("text") > 200)
    model = language.train(d)
    rng = np.random.default_rng(1)
    far = np.log(rng.dirichlet(np.full(language.BUCKETS, 0.3), 36).T + 1e-12).astype(np.float32)
    wide = language.Model(model.names + [f"x{i}" for i in range(36)], np.concatenate((model.table, far), axis=1))
    tried = []
    fit = language._fit
    monkeypatch.setattr(language, "_fit", lambda like, *a: tried.append(like.size) or fit(like, *a))
    raw = [r.text.encode() for r in d.orderBy("doc_id").limit(100).collect()]
    offs = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
    words = len(language._trigrams(np.frombuffer(b"".join(raw), np.uint8), offs)[1])
    got = wide.mixtures(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert all(got) and sum(tried) < 6 * words   # 820 times the words if every set were tried


def test_a_row_does_not_depend_on_its_neighbours(many):
    rng = np.random.default_rng(5)
    raw = [_words(rng, int(k)).encode() for k in rng.integers(1, 6, 200)]
    offs = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
    together = many.mixtures(np.frombuffer(b"".join(raw), np.uint8), offs)
    for got, b in zip(together, raw):
        alone = many.mixtures(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        assert dict(got) == pytest.approx(dict(alone), abs=1e-4)
