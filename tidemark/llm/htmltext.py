"""Main text of HTML pages: boosted trees over DOM-node features, decoded down the tree without contradictions."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import no_null, written

#: The trees are fitted on at most so many pages, the first by hash of the key.
MAX_PAGES = 150
ROUNDS, DEPTH = 20, 4

#: A quote opens a value only behind ``=``, as in browsers, and the value has any length; one that nothing closes, the
#: page's last of its kind, is a letter like others.
_ATTRS = r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRS + ">", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "head"}
BLOCKS = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
             "blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog hr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = {"ul", "ol", "dl", "table"}
#: Words of tag names, classes, ids and roles, by what they tell.
GROUPS = {
    "content": "article main content post entry story body text prose paragraph blog news page".split(),
    "menu": "nav navigation menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager toc links".split(),
    "header": "header banner masthead topbar logo brand".split(),
    "footer": "footer foot colophon copyright legal contentinfo bottom".split(),
    "side": "aside sidebar side widget rail related recommended trending complementary popular more".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal dialog overlay newsletter paywall message".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad dfp outbrain taboola".split(),
    "form": "form fieldset input search login signup subscribe subscription register contact".split(),
    "comment": "comment comments reply replies discussion disqus respond thread commentlist".split(),
    "share": "share social sharing follow button buttons tags meta byline".split(),
}
_GROUP_OF = {w: i for i, words in enumerate(GROUPS.values()) for w in words}
_N = len(GROUPS)
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FEATURES = (["depth", "log_chars", "log_own_chars", "density", "link_share", "stops", "word_length", "children", "place",
             "siblings", "siblings_alike", "text_before", "text_share", "is_paragraph", "is_heading", "is_list", "is_table", "nearest_mark"]
            + [f"own_{g}" for g in GROUPS] + [f"above_{g}" for g in GROUPS] + [f"below_{g}" for g in GROUPS])


class Page:
    """Block elements in page order with their parents, and text segments between block boundaries.

    Node 0 is the page, node 1 its body, whether or not a tag names it. Text that stands in the body itself is no part of
    a block, so each run of it between two block boundaries is a leaf of its own (``#run``), judged like an element.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.groups = ["html", "body"], [-1, 0], [0, 0]
        self.keep: list[int | None] = [None, None]
        self.segments: list[tuple[int, str, bool]] = []  # node, raw text, inside a link; node -1: a block boundary
        self._read(source)

    def _open(self, tag: str, attrs: str, at: int) -> int:
        self.tag.append(tag)
        self.parent.append(at)
        self.groups.append(self._mask([tag], attrs))
        self.keep.append(self._told(attrs))
        return len(self.tag) - 1

    @staticmethod
    def _mask(parts: list[str], attrs: str) -> int:
        mask = 0
        for p in parts + [p.lower() for v in _NAMES.findall(attrs) for p in _PART.findall(v)] if attrs else parts:
            g = _GROUP_OF.get(p)
            if g is not None:
                mask |= 1 << g
        return mask

    @staticmethod
    def _told(attrs: str) -> int | None:
        told = re.search(r'data-keep="([01])"', attrs) if attrs else None
        return int(told[1]) if told else None

    def _read(self, source: str) -> None:
        stack, at, links, n, run = [0, 1], 0, 0, len(source), -1
        add = self.segments.append

        def text(value: str) -> None:
            nonlocal run
            node = stack[-1]
            if node == 1 and run < 0 and not value.isspace():
                run = self._open("#run", "", 1)
            add((run if node == 1 and run >= 0 else node, value, links > 0))

        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in RAW and not m[1]:
                if tag != "head" and not m[3].endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            if tag == "a":
                links = 0 if m[1] else 1
                continue
            if tag not in BLOCKS:
                if tag in ("br", "img", "input"):
                    text(" ")
                continue
            add((-1, "", False))
            links, run = 0, -1
            if tag in ("html", "body"):
                # Their names tell as others' do, though not the word "body" itself; the first tag counts.
                i = 0 if tag == "html" else 1
                if not m[1] and not self.groups[i]:
                    self.groups[i] = self._mask([], m[3])
                    self.keep[i] = self._told(m[3]) if self.keep[i] is None else self.keep[i]
                continue
            if m[1]:
                names = [self.tag[i] for i in stack]
                if tag in names[2:]:
                    del stack[len(names) - 1 - names[::-1].index(tag):]
                continue
            if self.tag[stack[-1]] == "p":
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in _LISTS:
                    break
                if self.tag[stack[i]] in _CLOSES.get(tag, ()):
                    del stack[i:]
                    break
            node = self._open(tag, m[3], stack[-1])
            if tag != "hr":
                stack.append(node)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, stops, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text, link in self.segments:
            if node >= 0 and (size := len(text.strip())):
                own[node] += size
                linked[node] += size * link
                stops[node] += text.count(". ") + text.count(", ") + text.rstrip().endswith((".", "!", "?"))
                words[node] += text.count(" ") + 1
        parent = np.array(self.parent)
        chars, links, marks, tokens, tags = own.copy(), linked.copy(), stops.copy(), words.copy(), np.ones(n)
        below, above = list(self.groups), list(self.groups)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for x in (chars, links, marks, tokens, tags):
                x[p] += x[i]
            below[p] |= below[i]
        depth, kids, place, alike = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = self.parent[i]
            depth[i], place[i] = depth[p] + 1, kids[p]
            kids[p] += 1
            above[i] |= above[p]
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        mark = np.zeros(n)  # of the element itself or the nearest above that has any: 1 content, -1 clutter
        for i in range(1, n):
            mark[i] = -1 if self.groups[i] > 1 else 1 if self.groups[i] else mark[self.parent[i]]
        for i in range(1, n):
            alike[i] = same[self.parent[i], self.tag[i]]
        before = np.cumsum(own) - own
        total = max(1.0, chars[0])
        bits = lambda masks: (np.array(masks)[:, None] >> np.arange(_N)) & 1
        outer = [0] + [above[p] for p in self.parent[1:]]
        flags = [[t == "p", t in _HEADS, t in ("ul", "ol", "li", "dl", "dt", "dd"), t in ("table", "tr", "td", "th")] for t in self.tag]
        return np.column_stack([
            depth, np.log1p(chars), np.log1p(own), chars / tags, links / np.maximum(chars, 1), marks / np.maximum(tokens, 1),
            chars / np.maximum(tokens, 1), kids, place, np.where(parent >= 0, kids[parent], 0), alike, before / total, chars / total,
            np.array(flags, float), mark, bits(self.groups), bits(outer), bits(below)])

    def text(self, state: np.ndarray) -> str:
        blocks, current = [], []
        for node, text, _ in self.segments:
            if node < 0:
                if current:
                    blocks.append("".join(current))
                    current = []
            elif state[node] == 1:
                current.append(text)
        blocks.append("".join(current))
        lines = (" ".join(html.unescape(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def decoded(page: Page, inside: np.ndarray) -> np.ndarray:
    """The most likely consistent states down the tree: 0 before the article, 1 in it, 2 left out of it.

    A child's state is never less than its parent's, so nothing under a node that was left out comes back, and the
    article's text is never put together from a part that an ancestor has thrown away.
    """
    p = np.clip(inside, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log1p(-p)
    best = np.column_stack([no, yes, no])
    n = len(p)
    for i in range(n - 1, 0, -1):
        top = np.maximum.accumulate(best[i][::-1])[::-1]
        best[page.parent[i]] += top
    state = np.zeros(n, np.int8)
    state[0] = int(np.argmax(best[0]))
    for i in range(1, n):
        low = state[page.parent[i]]
        state[i] = low + int(np.argmax(best[i][low:]))
    return state


class Trees:
    """A fitted boosted model as arrays: per tree the split feature (-1: leaf), threshold, children and value."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            nodes: list[list[float]] = []

            def walk(node):
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    left = walk(node.leftChild())
                    nodes[at][:4] = [split.featureIndex(), split.threshold(), left, walk(node.rightChild())]
                return at

            walk(tree._call_java("rootNode"))
            self.trees.append((weight, np.array(nodes)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                feature = nodes[at, 0].astype(np.int64)
                inner = np.nonzero(feature >= 0)[0]
                if not len(inner):
                    break
                here = at[inner]
                left = x[inner, feature[inner]] <= nodes[here, 1]
                at[inner] = np.where(left, nodes[here, 2], nodes[here, 3]).astype(np.int64)
            margin += weight * nodes[at, 4]
        return 1 / (1 + np.exp(-2 * margin))


_WORDS = {"menu": "menu", "header": "header", "footer": "footer", "side": "sidebar", "notice": "cookie-notice", "advert": "ad-slot",
          "form": "subscribe-form", "comment": "comments", "share": "share"}


def teaching_pages(source: str, seed: int) -> list[str]:
    """The page with ``data-keep`` marks by its semantic tags, a second layout of it that tells by class names, and a third
    whose article stands in the body itself.

    Only pages with an ``article`` or ``main`` teach. The second layout has all kinds of clutter, some of it prose (reader
    comments, notices, related stories) and some inside the article, so that length alone decides nothing. In the third
    the body has a telling name or none, and holds paragraphs, plain boxes or bare text cut by line breaks.
    """
    source = source.replace("data-keep", "data-kept")  # only marks set here are labels
    found = re.search(r"<(article|main)\b[^>]*>(.*?)</\1>", source, re.S | re.I)
    if not found:
        return []
    pick = random.Random(seed)
    body = found[2]
    marked = source[:found.start()] + f'<{found[1]} data-keep="1">{body}</{found[1]}>' + source[found.end():]
    prose = [re.sub(r"<[^>]*>", "", x)[:400] for x in re.findall(r"<p>(.*?)</p>", body, re.S)] or ["Words."]
    link = lambda: f'<li><a href="#">{pick.choice(prose)[:20]}</a></li>'

    def clutter(kind: str) -> str:
        names = pick.choice(["", "", "", "main-", "post-", "article-", "page-", "top-"]) + pick.choice(GROUPS[kind][:7])
        tag = pick.choice({"menu": ["nav", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div"],
                           "form": ["form", "div"]}.get(kind, ["div", "section"]))
        if kind in ("menu", "share"):
            inner = "<ul>" + "".join(link() for _ in range(pick.randint(2, 8))) + "</ul>"
        elif kind in ("comment", "side", "notice") or pick.random() < 0.3:
            inner = "".join(f"<{t}>{pick.choice(prose)}</{t}>" for t in pick.choices(["p", "div", "li"], k=pick.randint(1, 4)))
        else:
            inner = f"<p>{pick.choice(prose)[:80]}</p>"
        return f'<{tag} class="{names} {_WORDS[kind]}" data-keep="0">{inner}</{tag}>'

    def wrapped(part: str) -> str:
        tag = pick.choice(["p"] * 6 + ["blockquote", "div", "li", "pre", "h2", "td"])
        if tag == "p":
            return part
        inner = re.sub(r"<[^>]*>", "", part)
        inner = f"<{tag}>{inner[:60] if tag == 'h2' else inner}</{tag}>"
        return {"li": f"<ul>{inner}</ul>", "td": f"<table><tr>{inner}</tr></table>"}.get(tag, inner)

    kinds = list(_WORDS)
    holder = pick.choice([("div", "post-content"), ("div", "entry"), ("section", "story"), ("main", "content"), ("div", "article-body"), ("article", ""),
                          ("article", "")])
    paragraphs = [wrapped(x) for x in re.split(r"(?=<p>)", body)]
    inside = pick.sample(["comment", "advert", "share", "form", "side", "notice"], pick.randint(0, 3))
    for kind in inside:
        paragraphs.insert(pick.randint(1, len(paragraphs)), clutter(kind))
    outside = [clutter(k) for k in pick.sample(kinds, pick.randint(3, len(kinds)))]
    cut = pick.randint(0, len(outside))
    second = (f"<html><body>{''.join(outside[:cut])}<{holder[0]} class=\"{holder[1]}\" data-keep=\"1\">{''.join(paragraphs)}</{holder[0]}>"
              f"{''.join(outside[cut:])}</body></html>")
    outside = [clutter(k) for k in pick.sample(kinds, pick.randint(0, 5))]
    cut = pick.randint(0, len(outside))
    parts = [re.sub(r"<[^>]*>", " ", x).strip() for x in re.split(r"(?=<p>)", body)]
    shape = pick.choice(["bare", "bare", "p", "box", "boxes"])
    text = "<br><br>".join(x for x in parts if x) if shape == "bare" else "".join(f"<p>{x}</p>" for x in parts if x)
    text = {"box": f"<div>{text}</div>", "boxes": f"<div><div>{text}</div></div>"}.get(shape, text)
    title = pick.choice(["", f"<h1>{pick.choice(prose)[:40]}</h1>"])
    name = pick.choice(["", "", ' class="article"', ' class="post"', ' id="story"', ' class="page"'])
    third = f"<html><body{name} data-keep=\"1\">{''.join(outside[:cut])}{title}{text}{''.join(outside[cut:])}</body></html>"
    return [marked, second, third]


def _labelled(page: Page) -> np.ndarray:
    """1 under the nearest mark that says keep, else 0."""
    out = np.zeros(len(page.tag))
    for i in range(1, len(page.tag)):
        out[i] = page.keep[i] if page.keep[i] is not None else out[page.parent[i]]
    return out


def fitted_trees(pages: DataFrame, key: str, source: str, limit: int = MAX_PAGES, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees | None:
    """Trees learnt from the nodes of at most ``limit`` pages; None where no page can teach."""
    sample = (pages.select(F.xxhash64(F.lit(42), F.col(f"`{key}`")).alias("draw"), no_null(F.col(f"`{source}`")).alias("source"))
              .filter(F.col("source").rlike("(?i)<(article|main)[ >]")).orderBy("draw", "source").limit(limit))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, rows = [], []
            for draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for made in teaching_pages(text, draw):
                    page = Page(made)
                    labels.extend(_labelled(page)[1:].tolist())
                    rows.extend(page.features()[1:].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    taught = written(sample.mapInArrow(nodes, "label double, x array<double>"), "dom-nodes")
    if taught.select("label").distinct().count() < 2:
        return None
    train = taught.select("label", array_to_vector("x").alias("features"))
    return Trees(GBTClassifier(maxIter=rounds, maxDepth=depth, seed=42).fit(train))


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", limit: int = MAX_PAGES) -> DataFrame:
    """``key``, ``url`` and ``text``: the main text of every row's whole page, blocks joined by a line feed.

    Null and empty pages, and pages on which no node is in the article, give an empty text. Text in the body itself and
    pages without any tag are judged like other text. Broken markup is read as browsers do in the main (implied ends,
    stray end tags, open comments). What RAW names (scripts, styles, title, text fields, and the content of noscript,
    template, iframe and svg) is never text. Where no page can teach the trees, nodes count as inside by their class names
    alone, and on pages without a telling name everything that is not named as clutter. Repeated rows stay, other columns
    are not looked at, an empty table gives no rows. A task holds one batch of pages and one page's nodes.
    """
    trees = fitted_trees(pages, key, source, limit)
    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{source}`"))
    good, bad = [FEATURES.index(f"{w}_content") for w in ("own", "above")], [FEATURES.index(f"{w}_{g}") for g in GROUPS if g != "content" for w in ("own", "above")]
    named = FEATURES.index("below_content")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            column = batch.column(2)
            for first in range(0, len(column), 64):
                parsed = [Page(x or "") for x in column.slice(first, 64).to_pylist()]
                x = [p.features() for p in parsed]
                every = np.concatenate(x)
                if trees:
                    chance = trees.probability(every)
                else:
                    told = np.concatenate([np.where(o[0, named] > 0, o[:, good].max(axis=1), 1.0) for o in x])
                    chance = 0.9 * told * (every[:, bad].max(axis=1) < 1) + 0.05
                at = 0
                for page, own in zip(parsed, x):
                    part = chance[at:at + len(own)].copy()
                    part[0] = 0.02
                    at += len(own)
                    out.append(page.text(decoded(page, part)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[key, url, "text"])

    return rows.mapInArrow(extract, T.StructType([rows.schema[0], rows.schema[1], T.StructField("text", T.StringType())]))
