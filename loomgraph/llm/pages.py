"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser gives each page's element nodes and the text standing in them. Each node
gets features of its own tag and attribute tokens, its ancestors', its depth and siblings, and the
density of text, links and tags in its subtree. Boosted trees, trained here on pages made
from a seeded grammar of layouts (``training_pages``), give the chance that a node holds main
text. Decoding picks the likeliest set of nodes in which a kept node's parent is kept
too, so no ancestor and descendant contradict each other. Text of kept nodes is joined in
page order.

Null and empty pages and pages without main text give an empty text. Pages cut off anywhere,
unknown tags and stray end tags are read as far as they go; an open element that is never closed swallows the rest only if
HTML says so (scripts, styles and the like). Very long pages are read whole, in time proportional to their length. Rows with null page_id or url, repeated rows and extra columns pass through as they are.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

CHUNK_BYTES = 4 << 20
#: Boosting: trees, depth, bins of a feature, learning rate, weight that keeps leaves small; training pages.
TREES, DEPTH, MAX_BINS, RATE, SHRINK, PAGES = 50, 5, 32, 0.3, 2.0, 1200

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
EMBEDDED = frozenset("noscript template svg object canvas audio video".split())
FOREIGN = frozenset("math mi mn mo ms mtext mspace mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle semantics".split())
INLINE = FOREIGN | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open element of the second kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select".split())
#: Tag kinds of the features.
KINDS = ("article main", "nav menu", "header", "footer", "aside", "form button select label fieldset input", "p blockquote pre", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a", "div section body html", "table tr td th")
#: How often names of training pages speak for the kind of their block, for nothing, or for the other kind.
NAMING = (0.74, 0.1, 0.16)
#: Buckets of the hashes of attribute tokens, and pages of the training set that only their weights are learned from.
BUCKETS, TOKEN_PAGES = 4096, 450
#: A comment (also ended by --!>), a section, a declaration, an end tag, a start tag; a quote opens a value only after "=".
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*(?![\s\"'])|[^>=])*)(?:>|\Z)", re.S,
)
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop|data-\w+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Page:
    """Nodes in page order: tag, attribute text, parent; and runs of text with the node each stands in."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents = ["#page"], [""], [-1]
        #: (node, text) in page order; a node of -1 marks the edge of a block.
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        tags, runs = self.tags, self.runs
        open_ = [0]
        places: dict[str, list[int]] = {}  # of the open elements of each tag in open_
        scopes, blocks = [0], [0]  # of the open scopes and of those that are not inline
        never: set[str] = set()  # tags of which no end tag follows

        def close(k: int) -> None:
            for j in range(len(open_) - 1, k - 1, -1):
                tag = tags[open_[j]]
                places[tag].pop()
                for special in (scopes, blocks):
                    if special[-1] == j:
                        special.pop()
            del open_[k:]

        at, size = 0, len(s)
        while at < size:
            lt = s.find("<", at)
            if lt < 0:
                lt = size
            if lt > at:
                runs.append((open_[-1], s[at:lt]))
                at = lt
                continue
            m = _TOKEN.match(s, at)
            if m is None:
                m = _LOOSE.match(s, at)
            if m is None:  # a lone "<" is text
                runs.append((open_[-1], "<"))
                at += 1
                continue
            at = m.end()
            end, start = (m[1], m[2]) if m.re is _TOKEN else (None, m[1])
            if end:
                end = end.lower()
                if end == "br":
                    runs.append((-1, ""))
                    continue
                own = places.get(end)
                # the end of a list item or cell does not reach beyond its list or table
                if own and (end not in ENDS or own[-1] >= scopes[-1]):
                    close(own[-1])
                if end not in INLINE:
                    runs.append((-1, ""))
            elif start:
                tag, rest = start.lower(), (m[3] if m.re is _TOKEN else m[2]) or ""
                if tag in RAW or tag in EMBEDDED:
                    if not (tag == "svg" and rest.endswith("/")) and tag not in never:
                        closing = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(s, at)
                        if closing:
                            at = closing.end()
                        elif tag in RAW:
                            at = size
                        else:
                            never.add(tag)
                    continue
                if tag not in INLINE:
                    runs.append((-1, ""))
                # an open paragraph or item ends if only inline elements stand open in it
                last = tags[open_[blocks[-1]]]
                if tag in ENDS_P and last == "p" or last in ENDS.get(tag, ()):
                    close(blocks[-1])
                    last = tags[open_[blocks[-1]]]
                if last in ENDS.get(tag, ()):
                    close(blocks[-1])
                tags.append(tag)
                self.attributes.append(rest)
                self.parents.append(open_[-1])
                # the slash of <div/> means nothing but in formulas
                if tag not in VOID and not (tag in FOREIGN and rest.endswith("/")):
                    open_.append(len(tags) - 1)
                    places.setdefault(tag, []).append(len(open_) - 1)
                    if tag in SCOPES:
                        scopes.append(len(open_) - 1)
                    if tag not in INLINE:
                        blocks.append(len(open_) - 1)


def _tokens(rest: str) -> set[int]:
    """Buckets of the tokens of the naming attributes."""
    if not rest or "=" not in rest:
        return set()
    return {zlib.crc32(t.lower().encode()) % BUCKETS for v in _ATTRIBUTE.findall(rest) for t in _SPLIT.split(v) if t}


def token_weights(pages: list[tuple[Page, list[bool]]]) -> np.ndarray:
    """For each bucket, how much more often its tokens stand at main text (smoothed log odds, against those of all named nodes)."""
    main, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for page, labels in pages:
        for rest, label in zip(page.attributes, labels, strict=False):
            for t in _tokens(rest):
                (main if label else other)[t] += 1
    prior = (main.sum() + 1) / (main.sum() + other.sum() + 2)
    return np.log((main + 4 * prior) / (other + 4 * (1 - prior))) - np.log(prior / (1 - prior))


def _attribute_score(rest: str, weights: np.ndarray) -> tuple[float, float, int]:
    """Weights for, weights against, and whether the element is hidden."""
    if not rest or "=" not in rest and "hidden" not in rest:
        return 0.0, 0.0, 0
    w = [float(weights[t]) for t in _tokens(rest)]
    return sum(x for x in w if x > 0), -sum(x for x in w if x < 0), int(bool(_HIDDEN.search(rest)))


_KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
N_FEATURES = len(KINDS) * 2 + 18


def features(page: Page, weights: np.ndarray) -> np.ndarray:
    """One row per node."""
    n = len(page.tags)
    parent = page.parents
    own = [0] * n  # characters that are not white space
    commas = [0] * n
    for node, text in page.runs:
        if node >= 0:
            own[node] += len(text) - text.count(" ")
            commas[node] += text.count(",") + text.count(".")
    total, links, marks, count, kids, blocks = own[:], [0] * n, commas[:], [1] * n, [0] * n, [0] * n
    scores = [_attribute_score(a, weights) for a in page.attributes]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if page.tags[k] == "a":
            links[k] = total[k]
        total[p] += total[k]
        links[p] += links[k]
        marks[p] += marks[k]
        count[p] += count[k]
        kids[p] += 1
        blocks[p] += blocks[k] + (page.tags[k] in ("p", "br"))
    width = len(KINDS)
    out = np.zeros((n, N_FEATURES), np.float32)
    depth, seen = [0] * n, [0] * n
    against, favour, above = [0.0] * n, [0.0] * n, [0] * n  # of ancestors; above: bit set of their tag kinds
    whole = max(1, total[0])
    at = 2 * width
    rows = []
    for k in range(n):
        p = max(parent[k], 0)
        kind = _KIND.get(page.tags[k], -1)
        good, bad, hidden = scores[k]
        if k:
            depth[k] = depth[p] + 1
            against[k], favour[k], above[k] = against[p] + scores[p][1], favour[p] + scores[p][0], above[p]
            pk = _KIND.get(page.tags[p], -1)
            if pk >= 0:
                above[k] |= 1 << pk
        if kind >= 0:
            out[k, kind] = 1
        rows.append((
            good, bad, hidden, min(against[k], 6.0), min(favour[k], 6.0), depth[k], total[k], own[k], total[k] / whole, links[k] / (total[k] or 1), total[k] / count[k],
            marks[k] / (total[k] or 1), count[k], kids[k], kids[p], seen[p] / (kids[p] or 1), total[k] / (total[p] or 1), blocks[k],
        ))
        seen[p] += 1
    out[:, at:] = rows
    bits = np.array(above)
    for k in range(width):
        out[:, width + k] = bits >> k & 1
    return out


def decode(chance: np.ndarray, parent: list[int]) -> list[bool]:
    """The likeliest labels in which every kept node has a kept parent."""
    n = len(parent)
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    for k in range(n - 1, 0, -1):
        keep[parent[k]] += min(keep[k], drop[k])
        drop[parent[k]] += drop[k]
    kept = [False] * n
    for k in range(n):
        kept[k] = (k == 0 or kept[parent[k]]) and keep[k] < drop[k]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """Text of the kept nodes, white space folded, blocks joined by one space."""
    parts = [" " if node < 0 else html.unescape(text) if "&" in text else text for node, text in page.runs if node < 0 or kept[node]]
    return " ".join("".join(parts).split())


# ---------------------------------------------------------------- the model


class Forest:
    """Boosted regression trees on binned features, as flat arrays (complete trees of DEPTH levels)."""

    def __init__(self, cuts: list[np.ndarray], base: float, weights: np.ndarray | None = None):
        self.cuts, self.base, self.weights = cuts, base, weights
        self.feature, self.bin, self.leaf = [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def margin(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.base)
        rows = np.arange(len(binned))
        for feature, cut, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            at = np.zeros(len(binned), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray | None = None) -> Forest:
    """Newton boosting for log loss; ``weights`` are those of attribute tokens that the features were made with."""
    cuts = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, MAX_BINS)))
        cuts.append((q[1:] + q[:-1]) / 2)
    prior = np.average(y, weights=w)
    forest = Forest(cuts, float(np.log(prior / (1 - prior))), weights)
    b = forest.bins(x)
    margin = forest.margin(b)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            for k in range(x.shape[1]):
                place = (at - first) * MAX_BINS + b[:, k]
                gs, hs = (np.cumsum(np.bincount(place, v, nodes * MAX_BINS).reshape(nodes, MAX_BINS), 1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                for j in np.flatnonzero(value > best + 1e-9).tolist():
                    best[j], feature[first + j], cut[first + j] = value[j], k, top[j]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        values = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SHRINK)
        forest.feature.append(feature)
        forest.bin.append(cut)
        forest.leaf.append(values)
        margin += values[leaf]
    return forest


# ------------------------------------------------------- training pages


def training_pages(count: int, seed: int = 5):
    """(html, labels by node) of pages from a grammar of layouts; words are letters at random."""
    rnd = random.Random(seed)
    for _ in range(count):
        yield _Layout(rnd).page()


_MAIN_NAMES = ("article", "content", "post", "entry", "story", "main", "text", "body")
_JUNK_NAMES = ("header", "message", "comment", "menu", "widget", "promo", "notice", "footer", "related", "links", "top", "response")


class _Layout:
    def __init__(self, rnd: random.Random):
        self.r, self.out, self.labels = rnd, [], []
        #: Names that say nothing, or the contrary: names of the other kind are given to main text and to the rest.
        self.naming = rnd.choices(("plain", "none", "contrary"), NAMING)[0]

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        many = r.randint(lo, hi)
        style = r.random()
        ws = ["".join(r.choice("etaoinshrdlucmfy") for _ in range(r.randint(1, 10))) for _ in range(many)]
        if style < 0.1:
            ws = [w.upper() + "!!" for w in ws]
        elif style < 0.2:
            ws = [w + r.choice(("***", "###", "&amp;")) for w in ws]
        elif style < 0.9:
            ws = [w + r.choice(("", "", "", "", "", "", ",", ".")) for w in ws]
        return " ".join(ws)

    def open(self, tag: str, main: bool, attributes: str = "") -> None:
        self.out.append(f"<{tag}{attributes}>")
        self.labels.append(main)

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def put(self, tag: str, main: bool, text: str, attributes: str = "") -> None:
        self.open(tag, main, attributes)
        self.out.append(text)
        self.close(tag)

    def name(self, *tokens: str, main: bool = False) -> str:
        r = self.r
        t = r.choice(tokens)
        if self.naming == "none":
            t = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
        elif self.naming == "contrary" and r.random() < 0.6:
            t = r.choice(_JUNK_NAMES if main else _MAIN_NAMES)
        t = r.choice((t, f"{r.choice(('site', 'page', 'x', 'block', 'c', 'widget'))}-{t}", f"{t}-{r.choice(('box', 'wrap', 'inner', 'area', 'list'))}", f"{t} {r.choice(('wide', 'dark', 'grid', 'row'))}"))
        return f' {r.choice(("class", "class", "id"))}="{t}"'

    def junk(self) -> None:
        """A block that is not main text."""
        r = self.r
        kind = r.choice(("nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "related", "share", "menu", "crumbs", "login"))
        if kind in ("nav", "menu", "crumbs", "related", "share"):
            tag = "nav" if kind == "nav" else r.choice(("div", "nav", "ul", "section"))
            name = {"nav": ("nav", "navbar", "navigation"), "menu": ("menu", "topbar"), "crumbs": ("breadcrumb", "breadcrumbs"), "related": ("related", "recommended"), "share": ("share", "social")}[kind]
            self.open(tag, False, "" if tag == "nav" and r.random() < 0.6 else self.name(*name))
            inner = tag != "ul" and r.random() < 0.8
            if inner:
                self.open("ul", False)
            for _ in range(r.randint(1, 9)):
                self.open("li", False)
                self.put("a", False, self.words(1, 9), ' href="/x"')
                self.close("li")
            if inner:
                self.close("ul")
            self.close(tag)
            return
        tag, name = {
            "header": ("header", ("header", "masthead", "hero")), "footer": ("footer", ("footer", "copyright", "legal")), "aside": ("aside", ("sidebar", "rail", "widget")),
            "ad": ("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo")), "notice": ("div", ("cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "newsletter")),
            "form": ("form", ("search", "signup", "subscribe", "form")), "comments": ("section", ("comments", "comment", "replies", "discussion", "disqus")), "login": ("div", ("login", "modal", "dialog")),
        }[kind]
        if tag != "div" and r.random() < 0.35:
            tag = "div"
            attributes = self.name(*name)
        else:
            attributes = self.name(*name) if tag in ("div", "section") or r.random() < 0.3 else ""
        self.open(tag, False, attributes)
        big = kind in ("comments", "aside", "footer") and r.random() < 0.5
        for _ in range(r.randint(1, 8 if big else 3)):
            what = r.random()
            if what < 0.45:
                self.put(r.choice(("p", "p", "div", "span")), False, self.words(2, 70 if kind in ("comments", "ad", "notice", "footer", "aside") else 15))
            elif what < 0.6:
                self.put("a", False, self.words(1, 4), ' href="#"')
            elif what < 0.7:
                self.put(r.choice(("h2", "h3", "h4")), False, self.words(1, 5))
            elif what < 0.8 and kind in ("form", "notice", "comments", "login"):
                self.put("button", False, self.words(1, 2))
                self.open("input", False, ' type="text"')
            else:
                self.out.append(self.words(2, 40))
        self.close(tag)

    def paragraph(self) -> None:
        r = self.r
        kind = r.random()
        if kind < 0.72:
            self.open("p", True, "" if r.random() < 0.9 else ' class="' + r.choice(("lead", "x", "text")) + '"')
            self.out.append(self.words(1, 120))
            if r.random() < 0.3:
                self.put(r.choice(("b", "em", "i", "strong", "a", "span", "code")), True, self.words(1, 12))
                self.out.append(self.words(1, 30))
            if r.random() < 0.15:
                self.open("br", True)
            if r.random() < 0.9:
                self.close("p")
        elif kind < 0.8:
            self.put(r.choice(("h2", "h3", "h4")), True, self.words(1, 9))
        elif kind < 0.87:
            tag = r.choice(("ul", "ol"))
            self.open(tag, True)
            for _ in range(r.randint(1, 7)):
                self.put("li", True, self.words(1, 25))
            self.close(tag)
        elif kind < 0.92:
            self.put(r.choice(("blockquote", "pre", "figcaption")), True, self.words(2, 40))
        elif kind < 0.95:
            self.open("table", True)
            for _ in range(r.randint(1, 4)):
                self.open("tr", True)
                for _ in range(r.randint(1, 4)):
                    self.put("td", True, self.words(1, 6))
                self.close("tr")
            self.close("table")
        else:
            self.put("div", True, self.words(3, 80))

    def entries(self) -> None:
        """An article that is a list of links."""
        r = self.r
        if r.random() < 0.5:
            self.paragraph()
        tag = r.choice(("ul", "ol"))
        self.open(tag, True)
        for _ in range(r.randint(6, 30)):
            self.open("li", True)
            self.put("a", True, self.words(3, 14), ' href="/x"')
            if r.random() < 0.3:
                self.out.append(self.words(1, 20))
            self.close("li")
        self.close(tag)

    def thread(self) -> None:
        """An article of posts, each in a block of its own."""
        r = self.r
        for _ in range(r.randint(2, 8)):
            self.open("div", True, self.name("message", "post", "entry", main=True))
            for _ in range(r.randint(1, 3)):
                self.put("p", True, self.words(8, 90))
            self.close("div")

    def article(self, layout: float) -> None:
        r = self.r
        if r.random() < 0.9:
            tag = "h1" if r.random() < 0.9 else "h2"
            if r.random() < 0.25:
                self.open("header", True)
                self.put(tag, True, self.words(1, 14))
                self.close("header")
            else:
                self.put(tag, True, self.words(1, 14))
        if r.random() < 0.3:  # an open bold over what follows
            self.open("p", True)
            self.open("b", True)
            self.out.append(self.words(1, 60))
            self.open("br", True)
        if r.random() < 0.06:
            self.entries()
        elif r.random() < 0.06:
            self.thread()
        else:
            for _ in range(r.randint(1, r.choice((3, 8, 25)))):
                self.paragraph()
                if r.random() < 0.06:
                    self.junk()
        if r.random() < 0.25:
            self.junk()

    def page(self):
        r = self.r
        self.out.append('<!DOCTYPE html><html lang="xx">')
        self.labels += [True]  # the page itself; then html
        self.labels += [True]
        self.open("head", False)
        self.open("meta", False, ' charset="utf-8"')
        self.out.append(f"<title>{self.words(1, 9)}</title><style>p{{}}</style>")
        self.close("head")
        self.open("body", True)
        wraps = []
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            self.open("div", True, r.choice(("", ' id="wrapper"', ' class="container"', ' class="row"')))
            wraps.append("div")
        for _ in range(r.randint(0, 4)):
            self.junk()
        if r.random() < 0.35:
            self.open("main", True)
            wraps.append("main")
        if r.random() < 0.25:
            self.open("div", True, self.name(*_MAIN_NAMES, main=True))
            wraps.append("div")
        kind = r.random()
        tag = "article" if kind < 0.6 else r.choice(("div", "section", "div", "main"))
        attributes = (self.name(*_MAIN_NAMES, main=True) if r.random() < (0.2 if kind < 0.6 else 0.9) else "")
        self.open(tag, True, attributes)
        self.article(kind)
        self.close(tag)
        if r.random() < 0.35:
            self.junk()
        while "main" in wraps and (wraps[-1] == "div" or r.random() < 0.7):
            self.close(wraps.pop())
        for _ in range(r.randint(0, 4)):
            self.junk()
        while wraps:
            self.close(wraps.pop())
        self.out.append("</body></html>")
        source = "".join(self.out)
        if r.random() < 0.15:
            source = source[: int(len(source) * r.uniform(0.5, 1))]
        return source, self.labels


@lru_cache(maxsize=1)
def model() -> Forest:
    """The trained forest; the same in every process."""
    xs, ys, ws = [], [], []
    pages = [(Page(source), labels) for source, labels in training_pages(PAGES)]
    weights = token_weights(pages[:TOKEN_PAGES])
    for page, labels in pages[TOKEN_PAGES:]:
        xs.append(features(page, weights))
        ys.append(np.array(labels[: len(page.tags)], float))
        # what a wrong label costs: about the text below the node
        ws.append(np.sqrt(1 + xs[-1][:, 2 * len(KINDS) + 6]) / 8 + 0.5)
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws), weights)


# ---------------------------------------------------------------- the operator


def main_texts(sources: list[str | None], forest: Forest) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    rows = [features(p, forest.weights) for p in pages]
    chance = forest.chance(np.concatenate(rows))
    ends = np.cumsum([len(r) for r in rows])
    return [text_of(p, decode(chance[e - len(r) : e], p.parents)) for p, r, e in zip(pages, rows, ends.tolist(), strict=True)]


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``df``."""
    forest = model()

    def run(batches):
        for batch in slices(batches, html_col, CHUNK_BYTES):
            texts = main_texts(batch.column(2).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select("page_id", "url", html_col).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
