"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block-level tags, whatever its nesting or its
mistakes.  Each block gets its word count and link density, those of the blocks
before and after it, and what the open elements around it say (article, menu,
advert, comment ...).  A decision tree, trained on a small labelled table,
decides which blocks are the article.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a comment, declaration or tag; quoted attribute values may hold '>'; what is cut off by the end of the page is a tag too
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
#: attributes one after the other, so that a value is never taken for a name
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")

#: elements whose content is never text
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option button title".split())
#: elements that end a block
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: those that stay open around blocks; the others end with the block
CONTAINER = BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6 html".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())

#: what an element's name or the words of its class, id or role say about all within it
SIGNS = {
    "article": frozenset("article main articlebody post entry story content".split()),
    "menu": frozenset("nav menu navigation navbar breadcrumb breadcrumbs toolbar pagination pager tabs header masthead banner topbar".split()),
    "side": frozenset("aside sidebar side widget related recommended recommendations trending popular footer copyright colophon social share sharing tags".split()),
    "notice": frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter "
                        "subscribe signup paywall disclaimer dialog complementary contentinfo".split()),
    "form": frozenset("form login search fieldset hidden".split()),
    "comment": frozenset("comment comments reply replies respond discussion disqus responses".split()),
}
_SIGN_OF = {w: s for s, words in SIGNS.items() for w in words}
#: what follows these in a class or id says what the page has beside it, not what the element is
_BESIDE = frozenset("has with no without".split())
#: hidden on some screens or on paper only
_HIDDEN_SOMEWHERE = re.compile(r"hidden-(?:print|xs|sm|md|lg|xl|phone|tablet|desktop|mobile)\b")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", *SIGNS, "marked")


@dataclass
class Blocks:
    texts: list[str]
    rows: list[list[float]]  # features


def _token_signs(token: str) -> set[str]:
    """The signs of one class or id: "post-footer" and "content-ad" aren't the article."""
    found: set[str] = set()
    for w in _WORDS.findall("" if _HIDDEN_SOMEWHERE.match(token) else token):
        if w in _BESIDE:
            break
        if w in _SIGN_OF:
            found.add(_SIGN_OF[w])
    if len(found) > 1:
        found.discard("article")
    return found


@functools.lru_cache(maxsize=65536)
def _signs(name: str, attrs: str) -> frozenset[str]:
    if name in ("body", "html"):
        return frozenset()  # classes of the whole page say nothing about its parts
    found = {_SIGN_OF[name]} if name in _SIGN_OF else set()
    tokens: list[set[str]] = []
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("form")
        elif key in ("class", "id"):
            tokens += map(_token_signs, value.split())
        elif key == "role":
            found.update(_SIGN_OF[w] for w in _WORDS.findall(value) if w in _SIGN_OF)
    # a class or id that names the article isn't overruled by another one; the element, its role or its being hidden do so
    found.update(*([{"article"}] if {"article"} in tokens else tokens))
    if len(found) > 1:
        found.discard("article")
    return frozenset(found)


def split_blocks(page: str) -> Blocks:
    """The text blocks of a page in order; one pass over its tags."""
    texts: list[str] = []
    rows: list[list[float]] = []
    stack: list[tuple[str, frozenset[str]]] = []
    piece: list[str] = []
    around = dict.fromkeys(SIGNS, 0)
    linked = 0          # characters inside links
    link, inline, heading, item = False, frozenset(), False, False

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            n = text.count(" ") + 1
            signs = [float(around[s] > 0 or s in inline) for s in SIGNS]
            if around["article"] and signs[1] and stack and any(t == "header" for t, _ in stack) and not any(t == "nav" for t, _ in stack):
                signs[1] = float(any("menu" in s and t != "header" for t, s in stack))  # an article's own header
            texts.append(text)
            rows.append([n, min(1.0, linked / len(text)), 0, 0, 0, 0, float(heading), float(item), *signs,
                         float(any(signs[1:]))])  # marked as anything but the article
        piece.clear()
        linked = 0

    at = 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            piece.append(text)
            if link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attrs = bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                close = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at)
                # an element that is never closed takes the rest; a title or button stops at the next tag
                at = close.end() if close else (n if name in ("script", "style") else at)
            continue
        if name == "a":
            link = not closing
        elif name == "br":
            piece.append(" ")
        elif name in BLOCK:
            end()
            link = False
            heading = item = False
            inline = frozenset()
            if name in CONTAINER:
                if closing:
                    if any(t == name for t, _ in stack):
                        while stack:
                            t, signs = stack.pop()
                            for s in signs:
                                around[s] -= 1
                            if t == name:
                                break
                elif name not in VOID and not attrs.endswith("/"):
                    if name == "li" and stack and stack[-1][0] == "li":
                        for s in stack.pop()[1]:
                            around[s] -= 1
                    signs = _signs(name, attrs)
                    stack.append((name, signs))
                    for s in signs:
                        around[s] += 1
                    item = name == "li"
            elif not closing:
                heading = name[0] == "h" and name[1:].isdigit()
                inline = _signs(name, attrs)
    end()
    for i, row in enumerate(rows):
        if i:
            row[2:4] = rows[i - 1][:2]
        if i + 1 < len(rows):
            row[4:6] = rows[i + 1][:2]
    return Blocks(texts, rows)


#: containers of an article whose mark-up also names something else
MIXED = ('class="content has-sidebar"', 'class="main with-comments"', 'class="post hidden-print"', 'id="main" class="no-sidebar content-with-ads"',
         'class="entry post-7 category-social tag-cookie"', 'class="content" data-title="hidden gems"', 'class="story" data-id="search"')


def _sample_pages(n: int = 120, seed: int = 7, mixed: bool = False) -> Iterator[tuple[str, set[str]]]:
    """Labelled pages made by rule: (page, its article blocks).  Layouts, lengths and mark-up vary; word counts of
    boilerplate and article overlap.  With ``mixed`` the articles' containers are those of MIXED."""
    rng = random.Random(seed)
    serial = iter(range(10 ** 9))

    def words(lo: int, hi: int) -> str:
        return " ".join(f"w{next(serial)}" for _ in range(rng.randint(lo, hi)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def dress(sign: str) -> str:
        tag = rng.choice(sorted(set(SIGNS[sign]) & {"nav", "aside", "footer", "header", "form", "article", "main"}) or ["div"])
        if rng.random() < 0.5:
            return f"<{tag}>|</{tag}>" if tag != "div" else f'<div class="{rng.choice(sorted(SIGNS[sign]))}">|</div>'
        return f'<div {rng.choice(["class", "id"])}="{rng.choice(sorted(SIGNS[sign]))}">|</div>'

    for _ in range(n):
        keep: set[str] = set()

        def good(lo: int, hi: int) -> str:
            t = words(lo, hi)
            keep.add(t)
            return t
        body = [f"<h1>{good(2, 14)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.12:
                body.append(f"<h2>{good(1, 8)}</h2>")
            elif r < 0.2:
                body.append("<ul>" + "".join(f"<li>{good(1, 25)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif r < 0.27:
                body.append(f"<blockquote>{good(3, 60)}</blockquote>")
            else:
                body.append(f"<p>{good(1, 9) if rng.random() < 0.3 else good(10, 140)}" + rng.choice(["</p>", ""]))
        for sign, chance in (("notice", 0.25), ("comment", 0.2), ("side", 0.15), ("form", 0.1)):
            if rng.random() < chance:  # boilerplate inside the article
                body.insert(rng.randint(1, len(body)), dress(sign).replace("|", f"<p>{words(1, 40)}</p>"))
        article = "".join(body)
        if rng.random() < 0.8:
            article = (f"<div {rng.choice(MIXED)}>|</div>" if mixed else dress("article")).replace("|", article)
        before = [dress("menu").replace("|", f"<ul>{links(rng.randint(2, 9))}</ul>"), dress("menu").replace("|", words(1, 14)), f"<ul>{links(5)}</ul>",
                  dress("notice").replace("|", words(3, 40)), dress("form").replace("|", words(1, 8)), dress("side").replace("|", f"<p>{words(2, 50)}</p>")]
        after = [dress("side").replace("|", words(3, 40)), dress("comment").replace("|", f"<p>{words(2, 60)}</p><p>{words(3, 20)}</p>"), f"<ul>{links(6)}</ul>",
                 dress("notice").replace("|", words(3, 30)), dress("form").replace("|", words(2, 9)), dress("side").replace("|", f"<ul>{links(4)}</ul>")]
        page = "".join(rng.sample(before, rng.randint(1, 4))) + article + "".join(rng.sample(after, rng.randint(1, 4)))
        yield f"<html><head><title>{words(2, 8)}</title></head><body>{page}</body></html>", keep


def labelled_table(n: int = 120, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The training table: features and label of every block of the sample pages (about 3,000 rows)."""
    rows, labels = [], []
    for page, keep in [*_sample_pages(n, seed), *_sample_pages(n // 3, seed + 1, mixed=True)]:
        b = split_blocks(page)
        rows += b.rows
        labels += [t in keep for t in b.texts]
    return np.array(rows), np.array(labels)


@dataclass
class Tree:
    """A binary decision tree in arrays: leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            go = f >= 0
            if not go.any():
                return self.share[node] >= 0.5
            up = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(go, np.where(up, self.high[node], self.low[node]), node)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 5) -> Tree:
    """Greedy Gini splits, down to ``depth`` or ``least`` rows a leaf."""
    nodes: list[list[float]] = []

    def best(rows: np.ndarray) -> tuple[float, int, float]:
        found = (1e-9, -1, 0.0)
        n, total = len(rows), y[rows].sum()
        gini = total * (n - total) / n
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows, f][order], np.cumsum(y[rows][order])
            i = np.flatnonzero(v[1:] > v[:-1]) + 1
            i = i[(i >= least) & (n - i >= least)]
            if len(i):
                left = c[i - 1]
                gain = gini - left * (i - left) / i - (total - left) * (n - i - total + left) / (n - i)
                k = int(gain.argmax())
                if gain[k] > found[0]:
                    found = (gain[k], f, (v[i[k] - 1] + v[i[k]]) / 2)
        return found

    def add(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, y[rows].mean()])
        if left and 0 < y[rows].sum() < len(rows):
            _, f, c = best(rows)
            if f >= 0:
                up = x[rows, f] > c
                nodes[me][:4] = [f, c, add(rows[~up], left - 1), add(rows[up], left - 1)]
        return me
    add(np.arange(len(x)), depth)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


def train() -> Tree:
    return grow(*labelled_table())


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_blocks, n_kept): the article of every page, its blocks joined by an empty line.

    A null page is an empty one and gives an empty text; so does a page without
    an article.  Character references are decoded, white space inside a block
    becomes one space.  Extra columns are left out.
    """
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            found = [split_blocks(p or "") for p in batch.column(2).to_pylist()]
            rows = [r for b in found for r in b.rows]
            keep = tree.predict(np.array(rows)) if rows else np.zeros(0, bool)
            texts, kept, at = [], [], 0
            for b in found:
                own = [t for t, k in zip(b.texts, keep[at:at + len(b.texts)]) if k]
                at += len(b.texts)
                texts.append("\n\n".join(own))
                kept.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(b.texts) for b in found], pa.int64()),
                                              pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_blocks", "n_kept"])
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_kept long")
