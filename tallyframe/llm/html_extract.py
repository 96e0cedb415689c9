"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element, and every other element with a telling class, is a node
that is content or not; what lies in silent elements (scripts, styles, heads)
has no text and no node. A node's own potential comes from its tag, names,
role, and text; the potentials between parent and child depend on the child's
kind. Messages of the sum-product algorithm pass up and down each tree; nodes
whose content marginal reaches the threshold give their text.

The potentials are trained by gradient ascent on the likelihood of labelled
pages, with expectations from the same messages. Where no labelled pages are
given, a fixed number is built by `labelled_pages` from templates, since the
tables hold none.

Defined results: null html is an empty page with empty text; anything that is
not markup is text; nesting has no limit; a node whose marginal equals the
threshold is content; repeated rows are treated alike; a very long page is
parsed whole, as a batch of its own, by one worker; columns other than the key,
the URL and the html are not read, whatever their names; an empty table stays
empty.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.arrow import modest_batches, small_batches
from tallyframe.llm.dom import INLINE, SILENT, Page, read_page, squeeze

#: Parts of class and id names, by what they tell.
NAMES = {
    "menu": "nav menu breadcrumb pagination pager tabs toc skip",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "comment": "comment comments reply replies disqus respond discussion",
    "side": "sidebar side aside widget related recommended recommendations share sharing social trending popular",
    "foot": "footer foot copyright legal colophon",
    "head": "header masthead topbar branding logo toolbar",
    "form": "form search login register input",
    "body": "content article post entry story main body text blogpost page-content",
}
_NAME_OF = {word: kind for kind, words in NAMES.items() for word in words.split()}
#: Parts of a name that say nothing by themselves. A name with any other unknown part ("related-work") tells nothing.
_PLAIN = frozenset("list box area block section container wrapper wrap inner outer item items bar links link posts page site top bottom left right primary secondary global row col column module unit slot form title text body main content".split())
_SPLIT = re.compile(r"[^a-z]+")
_TAGS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form button fieldset dialog", "article": "article", "main": "main",
    "section": "section", "div": "div", "p": "p", "h": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table tbody thead tr", "cell": "td th",
    "quote": "blockquote pre figure figcaption", "body": "body html #root",
}
_TAG_OF = {word: kind for kind, words in _TAGS.items() for word in words.split()}
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "search": "form", "main": "body", "article": "body"}
KINDS = [*_TAGS, "other"]
FEATURES = ["bias", *(f"tag_{k}" for k in KINDS), *(f"name_{k}" for k in NAMES), "hidden", "no_text", "linked", "half_linked", "top_header"]
_AT = {name: i for i, name in enumerate(FEATURES)}


@dataclass(frozen=True)
class ExtractRules:
    """threshold: least content marginal. pages: labelled pages built where none are given. steps, rate, decay: of training."""

    threshold: float = 0.5
    pages: int = 300
    steps: int = 500
    rate: float = 1.0
    decay: float = 2e-4
    seed: int = 11


def name_kinds(names: str) -> set[str]:
    """What class and id names tell: the kinds of the parts of each name that is made of known parts only."""
    found: set[str] = set()
    for name in names.split():
        parts = [p for p in _SPLIT.split(name) if p]
        if all(p in _NAME_OF or p in _PLAIN for p in parts):
            found.update(_NAME_OF[p] for p in parts if p in _NAME_OF)
    return found


class Forest:
    """The model nodes of many pages as arrays, by depth."""

    def __init__(self, pages: list[Page]):
        parent, kind, rows, depth, owner, of_element, self.pieces = [], [], [], [], [], [], []
        for number, page in enumerate(pages):
            node_of: list[int] = []
            tells: list[set[str]] = []
            in_body: list[bool] = []  # inside an article or main element
            silent: list[bool] = []
            for i, e in enumerate(page.elements):
                silent.append(e.tag in SILENT or (e.parent >= 0 and silent[e.parent]))
                hits = name_kinds(e.names)
                if e.role in ROLES:
                    hits.add(ROLES[e.role])
                tells.append(hits)
                in_body.append(e.parent >= 0 and (in_body[e.parent] or page.elements[e.parent].tag in ("article", "main")))
                if e.parent < 0 or (not silent[i] and (e.tag not in INLINE or hits or e.hidden)):
                    node_of.append(len(parent))
                    parent.append(node_of[e.parent] if e.parent >= 0 else -1)
                    depth.append(depth[node_of[e.parent]] + 1 if e.parent >= 0 else 0)
                    kind.append(0)
                    owner.append(number)
                    of_element.append(i)
                    rows.append(None)
                else:
                    node_of.append(node_of[e.parent])
            texts: dict[int, list[str]] = {}
            for element, block, text, linked in page.pieces:
                node = node_of[element]
                self.pieces.append((number, node, block, text))
                count = texts.setdefault(node, [0, 0])
                size = len(text.strip())
                count[0] += size
                count[1] += size if linked else 0
            for i, e in enumerate(page.elements):
                if i and node_of[i] == node_of[e.parent]:
                    continue
                size, linked = texts.get(node_of[i], (0, 0))
                tag = _TAG_OF.get(e.tag, "other")
                on = [0, _AT[f"tag_{tag}"], *(_AT[f"name_{t}"] for t in tells[i])]
                if e.hidden:
                    on.append(_AT["hidden"])
                if not size:
                    on.append(_AT["no_text"])
                if size and linked * 5 >= size * 4:
                    on.append(_AT["linked"])
                elif size and linked * 4 >= size:
                    on.append(_AT["half_linked"])
                if tag == "header" and not in_body[i]:
                    on.append(_AT["top_header"])
                rows[node_of[i]] = on
                kind[node_of[i]] = KINDS.index(tag)
        self.parent = np.array(parent, np.int64)
        self.kind = np.array(kind, np.int64)
        self.depth = np.array(depth, np.int64)
        self.page = np.array(owner, np.int64)
        self.element = np.array(of_element, np.int64)
        self.feature_node = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        self.feature = np.array([f for r in rows for f in r], np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        self.levels = np.split(order, cuts) if len(order) else []

    def scores(self, unary: np.ndarray) -> np.ndarray:
        """Log potential of content over not, per node."""
        return np.bincount(self.feature_node, unary[self.feature], len(self.parent))


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content marginal of each node, and marginals (node, parent label, own label) of each edge.
    pair: log potentials (kind of child, parent label, child label)."""
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = forest.scores(unary)
    up = own.copy()  # own potential and all messages from below
    edge = pair[forest.kind]
    sent = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        message = np.logaddexp(edge[level, :, 0] + up[level, None, 0], edge[level, :, 1] + up[level, None, 1])
        message -= message.max(axis=1, keepdims=True)
        sent[level] = message
        for label in (0, 1):
            np.add.at(up[:, label], forest.parent[level], message[:, label])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        outside = belief[forest.parent[level]] - sent[level]
        both = outside[:, :, None] + edge[level] + up[level][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        p = np.exp(both)
        p /= p.sum(axis=(1, 2), keepdims=True)
        joint[level] = p
        from_above = np.logaddexp(outside[:, 0, None] + edge[level, 0], outside[:, 1, None] + edge[level, 1])
        belief[level] = up[level] + from_above
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p[:, 1] / p.sum(axis=1), joint


def train(pages: list[tuple[Page, set[int]]], rules: ExtractRules) -> tuple[np.ndarray, np.ndarray]:
    """Unary and pair potentials from pages with the numbers of their content elements."""
    forest = Forest([p for p, _ in pages])
    # a page counts once, however many nodes it has
    size = np.bincount(forest.page, minlength=len(pages))
    weight = 1.0 / size[forest.page]
    labels = np.array([e in pages[p][1] for p, e in zip(forest.page.tolist(), forest.element.tolist(), strict=True)], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    seen_pair = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen_pair, (forest.kind[child], labels[forest.parent[child]], labels[child]), weight[child])
    seen = np.bincount(forest.feature, (labels * weight)[forest.feature_node], len(FEATURES))
    unary, pair = np.zeros(len(FEATURES)), np.zeros((len(KINDS), 2, 2))
    speed_u, speed_p, n = np.full(len(FEATURES), 1e-8), np.full(pair.shape, 1e-8), len(pages)
    for _ in range(rules.steps):
        content, joint = sum_product(forest, unary, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.kind[child], joint[child] * weight[child, None, None])
        step_u = (seen - np.bincount(forest.feature, (content * weight)[forest.feature_node], len(FEATURES))) / n - rules.decay * unary
        step_p = (seen_pair - expected) / n - rules.decay * pair
        speed_u += step_u**2
        speed_p += step_p**2
        unary += rules.rate * 0.25 * step_u / np.sqrt(speed_u)
        pair += rules.rate * 0.25 * step_p / np.sqrt(speed_p)
    return unary, pair


def labelled_pages(rules: ExtractRules) -> list[tuple[Page, set[int]]]:
    """Pages built from templates; elements whose start tag bears data-content="1" are content."""
    draw = random.Random(rules.seed)
    word = lambda: "".join(draw.choice(["an", "er", "is", "ton", "que", "la", "de", "mi", "os", "re"]) for _ in range(draw.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    sentences = lambda a, b: " ".join(words(4, 14).capitalize() + "." for _ in range(draw.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(draw.randint(a, b)))
    named = lambda names: f'class="{draw.choice(names.split())}"' if draw.random() < 0.7 else f'id="{draw.choice(names.split())}"'
    mark = ' data-content="1"'

    def paragraph() -> str:
        if draw.random() < 0.15:
            return f"<p{mark}>{words(1, 25)}</p>"
        body = sentences(1, 6)
        if draw.random() < 0.2:
            body += f' <a href="/x">{words(1, 3)}</a> ' + sentences(1, 2)
        if draw.random() < 0.2:
            return draw.choice([f"<p{mark}>{body}", f"<p{mark}>{words(2, 5)}<br>{body}</p>", f"<p{mark}><em>{body}</p>"])
        return f"<p{mark}>{body}</p>"

    def nested(inner: str, deep: int) -> str:
        """inner in so many elements without telling names."""
        for _ in range(deep):
            tag = draw.choice(["div", "div", "div", "section", "details", "center", "noscript"])
            inner = f"<{tag}{draw.choice(['', f' class=\"{word()}-{word()}\"', f' id=\"{word()}{draw.randint(1, 99)}\"'])}{mark}>{inner}</{tag}>"
        return inner

    def article() -> str:
        parts = [f"<h1{mark}>{words(2, 9)}</h1>"] if draw.random() < 0.9 else []
        if parts and draw.random() < 0.2:
            parts = [f"<header{mark}>{parts[0]}</header>"]
        for _ in range(draw.randint(1, 9) if draw.random() < 0.9 else draw.randint(10, 60)):
            roll = draw.random()
            if roll < 0.66:
                parts.append(paragraph())
            elif roll < 0.71:
                parts.append(f"<h2{mark}>{words(2, 6)}</h2>")
            elif roll < 0.75:
                parts.append(f"<ul{mark}>" + "".join(f"<li{mark}>{words(4, 12)}</li>" for _ in range(3)) + "</ul>")
            elif roll < 0.78:
                parts.append(f"<blockquote{mark}><p{mark}>{sentences(1, 2)}</p></blockquote>")
            elif roll < 0.88:
                parts.append(nested(paragraph() if draw.random() < 0.7 else words(5, 40), draw.choice([1, 1, 1, 2, 3])))
            elif roll < 0.91:
                parts.append(f"<table{mark}><tr{mark}><td{mark}>{words(1, 4)}</td><td{mark}>{words(1, 4)}</td></tr></table>")
            else:
                parts.append(draw.choice([ad, share, related])())
        if draw.random() < 0.15:
            parts.append(comments())
        return "".join(parts)

    def ad() -> str:
        return f"<div {named('ad ads advert sponsor banner promo')}>{sentences(1, 2) if draw.random() < 0.6 else words(2, 9)}</div>"

    def share() -> str:
        return f"<div {named('share social')}>{links(2, 4)}</div>"

    def related() -> str:
        return f"<{draw.choice(['div', 'section', 'aside'])} {named('related recommended popular')}><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul></div>"

    def comments() -> str:
        rows = "".join(f'<{draw.choice(["div", "li", "div"])} class="comment"><p>{sentences(1, 3)}</p></div>' for _ in range(draw.randint(1, 5)))
        return f"<{draw.choice(['section', 'div'])} {named('comments comment-list discussion')}><h2>{words(1, 2)}</h2>{rows}</section></div>"

    def top() -> str:
        return draw.choice(
            [
                f"<nav><ul>{links(3, 8)}</ul></nav>",
                f"<header><a href='/'>{words(1, 3)}</a><nav><ul>{links(3, 8)}</ul></nav></header>",
                f"<div {named('nav menu topbar')}><ul>{links(3, 8)}</ul></div>",
                f"<header {named('header masthead')}><p>{words(2, 8)}</p></header>",
                f"<div {named('header masthead branding')}><h2>{words(1, 4)}</h2></div>",
                f"<div {named('breadcrumb breadcrumbs')}><a href='/'>{words(1, 2)}</a> / {words(1, 2)}</div>",
            ]
        )

    def other() -> str:
        return draw.choice(
            [
                ad,
                lambda: f"<div {named('cookie consent notice popup')}><p>{sentences(1, 2)}</p><button>{words(1, 2)}</button></div>",
                lambda: f"<form action='/s'><label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button></form>",
                lambda: f"<div {named('newsletter subscribe')}><p>{sentences(1, 1)}</p><form><input></form></div>",
                lambda: f"<aside><p>{sentences(1, 3)}</p></aside>",
                lambda: f"<div {named('sidebar widget')}><h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p><ul>{links(2, 5)}</ul></div>",
                related,
                lambda: f"<div role='dialog'><p>{sentences(1, 2)}</p></div>",
            ]
        )()

    def bottom() -> str:
        return draw.choice(
            [
                f"<footer>&copy; {words(1, 3)} &middot; {sentences(1, 2)}</footer>",
                f"<footer><ul>{links(2, 6)}</ul><p>{sentences(1, 2)}</p></footer>",
                f"<div {named('footer copyright')}>{sentences(1, 2)}</div>",
            ]
        )

    found = []
    for _ in range(rules.pages):
        tag, names = draw.choice([("article", ""), ("article", ""), ("main", ""), ("div", named("content post entry story main-content article-body")), ("section", named("content post")), ("div", "")])
        inner = f"<{tag} {names}{mark}>{article()}</{tag}>"
        if draw.random() < 0.3:
            inner = nested(inner, draw.choice([1, 1, 2, 3, draw.randint(4, 60)]))
        if draw.random() < 0.2:
            inner = f"<main{mark}>{inner}</main>"
        pieces = [top() for _ in range(draw.randint(1, 2))] + [other() for _ in range(draw.randint(0, 2))] + [inner]
        pieces += [other() for _ in range(draw.randint(0, 2))] + ([comments()] if draw.random() < 0.25 else []) + ([bottom()] if draw.random() < 0.9 else [])
        source = f"<html{mark}><head><title>{words(2, 6)}</title></head><body{mark}>{''.join(pieces)}"
        page = read_page(source)
        flags = [mark in m for m in re.findall(r"<[a-zA-Z][^>]*>", source) if not re.match(r"<(?:br|input)\b", m)]
        found.append((page, {0} | {i for i, on in enumerate(flags, 1) if on}))
    return found


@lru_cache(maxsize=4)
def _built_in(rules: ExtractRules) -> tuple[np.ndarray, np.ndarray]:
    """Potentials trained on the built pages, once per rules and driver process."""
    return train(labelled_pages(rules), rules)


def main_texts(pages: list[Page], unary: np.ndarray, pair: np.ndarray, threshold: float) -> list[str]:
    forest = Forest(pages)
    if not len(forest.parent):
        return []
    content, _ = sum_product(forest, unary, pair)
    chosen = content >= threshold
    blocks: list[dict[int, list[str]]] = [{} for _ in pages]
    for number, node, block, text in forest.pieces:
        if chosen[node]:
            blocks[number].setdefault(block, []).append(text)
    return [" ".join(filter(None, (squeeze("".join(b)) for b in found.values()))) for found in blocks]


def extract_pages(pages: DataFrame, rules: ExtractRules | None = None, labelled: list[tuple[Page, set[int]]] | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars. The potentials (a few hundred numbers) go with the function."""
    rules = rules or ExtractRules()
    unary, pair = train(labelled, rules) if labelled is not None else _built_in(rules)
    kind = pages.schema[key].dataType.simpleString()
    threshold = rules.threshold

    def run(batches):
        for batch in small_batches(batches, html, 1 << 20):
            texts = main_texts([read_page(h or "") for h in batch.column(html).to_pylist()], unary, pair, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return modest_batches(pages).select(key, url, html).mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
