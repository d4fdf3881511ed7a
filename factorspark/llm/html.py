"""Main text of web pages: boosted trees over the nodes of the DOM, decoded along the tree.

Every block element gets the probability that main text stands in it. A node counts as main text only below nodes that do: of all such
labellings of the tree the most likely one is taken, so ancestors and descendants never contradict each other. The
classifier learns from composed pages, whose labels are known by construction.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import ship, steps
from factorspark.llm.gbt import Trees, fit

#: Composed pages to learn from, and the seed they are drawn with.
TRAINING_PAGES, SEED = 500, 7
#: Characters of html whose nodes are classified together, and nodes of a long page that are classified at a time.
TOGETHER, ROWS = 1 << 19, 1 << 14

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts, styles and form controls, whose text is never main text. Formulas, buttons and fallbacks are inline content.
_SILENT = frozenset("script style template title select option optgroup datalist textarea".split())
_CONTAINER = frozenset("html body article main section div nav header footer aside form fieldset table thead tbody tfoot tr td th ul ol dl dd li blockquote center figure details dialog hgroup search menu".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 dt pre address figcaption caption summary legend".split())
_BLOCK = _CONTAINER | _LEAF | {"#text"}
#: Start tags that end an open element of the same list, up to a container around it.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_AROUND = frozenset("ul ol dl table article main section div nav header footer aside form body".split())
_AROUND_P, _AROUND_HEAD = _AROUND | {"li", "td", "th"}, _AROUND - {"ul", "ol", "dl"}

_KINDS = ("article", "main", "section", "div", "p", "#text", "heading", "list", "li", "table", "nav", "header", "footer", "aside", "form", "quote", "figure", "root", "other")
_KIND_OF = {**{t: "heading" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")}, **{t: "list" for t in ("ul", "ol", "dl", "menu")}, **{t: "li" for t in ("dt", "dd")},
            **{t: "table" for t in ("thead", "tbody", "tfoot", "tr", "td", "th")}, "blockquote": "quote", "pre": "quote", "figcaption": "figure", "html": "root", "body": "root",
            "fieldset": "form", "legend": "form", "search": "form", "#root": "root"}
#: Words in class, id and role that name the purpose of an element.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip links sitemap",
    "header": "header masthead banner logo topbar top brand branding site hero title bar",
    "footer": "footer foot copyright colophon legal bottom imprint",
    "side": "sidebar side aside rail widget widgets related popular recommended recommendations trending complementary left right secondary more teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast newsletter subscribe subscription paywall announcement message warning disclaimer infobar privacy",
    "advert": "ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted banner commercial",
    "form": "form login signin signup register search contact input field",
    "comment": "comment comments commentlist reply replies respond response responses disqus discussion thread feedback review reviews reader guestbook",
    "share": "share sharing social tools buttons follow tags byline author meta print",
    "hidden": "hidden hide invisible offscreen sr",
    "content": "content article post entry story text main body page maincontent articlebody prose copy document",
}
_GROUP_OF: dict[str, set[str]] = {}
for _name, _listed in TOKENS.items():
    for _token in _listed.split():
        _GROUP_OF.setdefault(_token, set()).add(_name)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?]")
#: Left out of the composed pages that trees learn from: the two words of a button would stand for all short blocks.
_BUTTON = re.compile(r"<button>.*?</button>")


class Node:
    __slots__ = ("tag", "parent", "groups", "text", "links", "first", "depth", "nth", "children", "label", "run")

    def __init__(self, tag: str, parent: int, depth: int, nth: int, groups: frozenset[str]):
        self.tag, self.parent, self.depth, self.nth, self.groups = tag, parent, depth, nth, groups
        self.text: list[str] = []  # own text, that of inline elements included
        self.links = self.children = 0


def _groups_in(names: str) -> frozenset[str]:
    return frozenset(g for part in _PART.findall(names) for g in _GROUP_OF.get(part.lower(), ()))


_groups_cached = lru_cache(maxsize=50_000)(_groups_in)


def _groups(names: str) -> frozenset[str]:
    """Groups of all words in an attribute; long values are not kept, so that the cache stays small."""
    return _groups_cached(names) if len(names) <= 500 else _groups_in(names)


class Level:
    """An open block element, and the inline elements that are open in it, innermost last."""

    __slots__ = ("tag", "node", "inline", "count")

    def __init__(self, tag: str, node: int, inline: list[str] | None = None, count: Counter | None = None):
        self.tag, self.node, self.inline, self.count = tag, node, inline or [], count or Counter()


class Tree(HTMLParser):
    """Block elements of a page in page order. Inline content between blocks of a container gets a node of its own, ``#text``.

    What is open is counted by tag, so the time is linear in the page, however many elements are never closed.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, 0, 0, frozenset())]
        self.levels = [Level("#root", 0)]
        self.places: dict[str, list[int]] = {t: [] for t in _BLOCK}  # levels with a tag
        self.inline: Counter = Counter()  # open inline elements of all levels
        self.silent: list[str] = []  # the open silent element and what is open inside
        self.within: Counter = Counter()
        self.feed(html)
        self.close()

    def _add(self, tag: str, groups: frozenset[str] = frozenset()) -> None:
        up = self.levels[-1].node
        parent = self.nodes[up]
        self.nodes.append(Node(tag, up, parent.depth + 1, parent.children, groups))
        parent.children += 1
        self.places[tag].append(len(self.levels))
        self.levels.append(Level(tag, len(self.nodes) - 1))

    def _cut(self, at: int) -> None:
        """Ends all levels from ``at`` on."""
        for level in self.levels[at:]:
            self.places[level.tag].pop()
            self.inline.subtract(level.inline)
        del self.levels[at:]

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def _pop_to(self, tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        at = self._last(tags)
        if at and at > self._last(stop):
            self._cut(at)

    def _pop_inline(self, level: Level, tag: str) -> None:
        while level.count[tag]:
            last = level.inline.pop()
            level.count[last] -= 1
            self.inline[last] -= 1
            if last == tag:
                return

    def _pop_head(self) -> None:
        """Ends an open head, which is no block, unless a block that it cannot reach into lies between."""
        if self.inline["head"] > 0:
            for at in range(len(self.levels) - 1, -1, -1):
                if self.levels[at].count["head"]:
                    self._cut(at + 1)
                    self._pop_inline(self.levels[at], "head")
                    return
                if self.levels[at].tag in _AROUND_HEAD:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent or tag in _SILENT:
            if not self.silent or tag not in _VOID:
                self.silent.append(tag)
                self.within[tag] += 1
            return
        if tag not in _BLOCK:
            if tag == "br":
                self._text(" ")
            elif tag not in _VOID:
                top = self.levels[-1]
                top.inline.append(tag)
                top.count[tag] += 1
                self.inline[tag] += 1
            elif tag == "hr":
                self._pop_to(("#text", "p"), _AROUND)
            return
        if self.levels[-1].tag == "#text":
            self._cut(len(self.levels) - 1)
        self._pop_to(("p",), _AROUND_P)
        top = self.levels[-1]
        if top.tag in _LEAF and tag in _LEAF and not top.inline:
            self._cut(len(self.levels) - 1)
        if tag == "body":
            self._pop_head()
        elif tag in _ENDS:
            self._pop_to(_ENDS[tag], _AROUND)
            if tag == "tr":
                self._pop_to(("tr",), _AROUND)
        groups = frozenset().union(*(_groups(v) for k, v in attrs if v and k in ("class", "id", "role", "aria-label")))
        hide = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v) for k, v in attrs)
        self._add(tag, groups | {"hidden"} if hide else groups)

    def _speak(self, left: int) -> None:
        """Ends what is open inside a silent element beyond the first ``left``."""
        self.within.subtract(self.silent[left:])
        del self.silent[left:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self.silent)
        self.handle_starttag(tag, attrs)
        self._speak(before)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if self.within[tag] > 0:
                at = len(self.silent) - 1
                while self.silent[at] != tag:
                    at -= 1
                self._speak(at)
                return
            # never closed: ends with the element around it
            if tag not in ("body", "html") and not self.inline[tag] and not self.places.get(tag):
                return
            self._speak(0)
        if tag in ("body", "html"):
            return
        if tag in _BLOCK:
            self._pop_to((tag,))
        else:
            self._pop_inline(self.levels[-1], tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self._text(data)

    def _text(self, data: str) -> None:
        top = self.levels[-1]
        if top.tag in _CONTAINER or top.node == 0:
            if data.isspace() or not data:
                return
            # inline elements that are open go on inside the new node
            self._add("#text")
            moved, top = top, self.levels[-1]
            top.inline, top.count, moved.inline, moved.count = moved.inline, moved.count, top.inline, top.count
        node = self.nodes[top.node]
        node.text.append(data)
        if top.count["a"]:
            node.links += len(data)


FEATURES = [*(f"kind:{k}" for k in _KINDS), *(f"own:{g}" for g in TOKENS), *(f"above:{g}" for g in TOKENS), "above:article", "above:main", "above:cut", "depth", "nth", "siblings", "share", "offset",
            "chars", "words", "marks", "nodes", "density", "links", "paragraphs", "items", "parent_links", "parent_chars", "before_chars", "after_chars", "words_of_paragraph"]
_CUTS = frozenset(("nav", "header", "footer", "aside", "form"))


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node: its kind, what its attributes and those above say, its subtree, its siblings and its place in the page."""
    return np.concatenate(list(feature_rows(nodes)))


def feature_rows(nodes: list[Node], step: int = ROWS) -> Iterator[np.ndarray]:
    """The rows of ``features`` in order, ``step`` at a time, so that a long page holds its numbers but not its whole matrix."""
    n, g = len(nodes), list(TOKENS)
    chars, words, marks, links, size, paragraphs, items = (np.zeros(n) for _ in range(7))
    for i, x in enumerate(nodes):
        if x.text:
            text = "".join(x.text)
            chars[i], words[i], marks[i], links[i] = len(text), len(text.split()), len(_MARKS.findall(text)), x.links
        size[i], paragraphs[i], items[i] = 1, x.tag in ("p", "#text"), x.tag == "li"
    own = chars.copy()
    total = np.stack([chars, words, marks, links, size, paragraphs, items])
    parent = [x.parent for x in nodes]
    for i in range(n - 1, 0, -1):
        total[:, parent[i]] += total[:, i]
    chars, words, marks, links, size, paragraphs, items = total
    kind, own_groups, above = np.zeros(n, np.int8), np.zeros((n, len(g)), np.int8), np.zeros((n, len(g) + 3), np.int32)
    for i, x in enumerate(nodes):
        kind[i] = _KINDS.index(_KIND_OF.get(x.tag, x.tag if x.tag in _KINDS else "other"))
        for name in x.groups:
            own_groups[i, g.index(name)] = 1
        if i:
            p = parent[i]
            above[i] = above[p]
            above[i, : len(g)] += own_groups[p]
            above[i, len(g)] += nodes[p].tag == "article"
            above[i, len(g) + 1] += nodes[p].tag == "main"
            above[i, len(g) + 2] += nodes[p].tag in _CUTS
    up = np.array(parent)
    up[0] = 0
    offset = np.cumsum(own) - own
    depth, nth, siblings = (np.array(v, float) for v in ([x.depth for x in nodes], [x.nth for x in nodes], [nodes[p].children for p in up]))
    for a in range(0, n, step):
        r = slice(a, a + step)
        u = up[r]
        rest = [depth[r], nth[r], siblings[r], chars[r] / max(1.0, chars[0]), offset[r] / max(1.0, chars[0]), np.log1p(chars[r]), np.log1p(words[r]),
                marks[r] / np.maximum(1, words[r]), np.log1p(size[r]), chars[r] / size[r], links[r] / np.maximum(1, chars[r]), paragraphs[r], items[r], links[u] / np.maximum(1, chars[u]), np.log1p(chars[u]),
                np.log1p(np.maximum(0, offset[r] - offset[u])), np.log1p(np.maximum(0, offset[u] + chars[u] - offset[r] - chars[r])), words[r] / np.maximum(1, paragraphs[r])]
        yield np.concatenate([np.eye(len(_KINDS))[kind[r]], own_groups[r], above[r], np.stack(rest, axis=1)], axis=1)


def decode(parent: list[int], margin: np.ndarray) -> list[bool]:
    """The most likely labelling in which a node is main text only if its parent is. The root is.

    A cut node costs the odds of its whole subtree; a kept one its own and the better choice for each child.
    """
    keep_cost, cut_cost = np.logaddexp(0, -margin).tolist(), np.logaddexp(0, margin).tolist()
    for i in range(len(parent) - 1, 0, -1):
        cut_cost[parent[i]] += cut_cost[i]
        keep_cost[parent[i]] += min(keep_cost[i], cut_cost[i])
    kept = [True] * len(parent)
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and keep_cost[i] <= cut_cost[i]
    return kept


def main_text(nodes: list[Node], kept: list[bool]) -> str:
    blocks = (" ".join("".join(x.text).split()) for x, k in zip(nodes, kept, strict=True) if k and x.text)
    return "\n".join(b for b in blocks if b)


class Composer:
    """Pages with known main text, drawn from a seed. Main text is marked with a character of the private area, which is taken out again."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(least, most)):
            w = "".join(r.choice("abcdefghilmnoprstuvéèüöñß") for _ in range(r.randint(1, 11)))
            out.append(w + r.choice(["", "", "", "", "", ",", ".", "." if r.random() < 0.5 else " &amp;"]))
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def prose(self, main: bool, least: int = 1, most: int = 70) -> str:
        r = self.r
        text = self.words(least, r.choice([most, most, max(least, most // 8)]))
        if r.random() < 0.2:
            text += f" <a href='/x'>{self.words(1, 4)}</a> {self.words(1, 8)}"
        if r.random() < 0.15:
            text = f"<b>{text}" + r.choice(["</b>", ""])
        return (self.MARK if main else "") + text

    def element(self, tag: str, names: list[str], inner: str, bare: float = 0.0) -> str:
        r = self.r
        key = r.choice(["class", "class", "class", "id"])
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice(["-1", "-wrap", " box", "-area", " block", " clearfix", "-container"])
        attr = "" if not names or r.random() < bare else f' {key}="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def link_list(self, least: int = 2, most: int = 9) -> str:
        r = self.r
        items = [f"<a href='/y'>{self.words(1, r.choice([1, 1, 3, 6]))}</a>" for _ in range(r.randint(least, most))]
        return r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " ".join(items), " | ".join(items), "".join(f"<p>{i}</p>" for i in items[:4])])

    def paragraphs(self, main: bool, least: int, most: int) -> str:
        r = self.r
        style, out = r.random(), []
        for _ in range(r.randint(least, most)):
            text = self.prose(main)
            end = r.choice(["<br>", "", ""])
            out.append(f"<p>{text}{end}" if style < 0.2 else f"<div>{text}</div>" if style < 0.3 else f"<p class='{r.choice(['text', 'par', 'lead', 'intro', 'x1'])}'>{text}</p>" if style < 0.4 else f"<p>{text}</p>")
        return "".join(out)

    def junk(self, kind: str) -> str:
        r = self.r
        e, prose = self.element, lambda a=1, b=30: self.prose(False, a, b)
        if kind == "menu":
            return r.choice([lambda: e("nav", ["nav", "menu", "main-nav", "breadcrumb", "pagination"], self.link_list(), 0.7), lambda: e("div", ["menu", "navbar", "navigation", "breadcrumbs", "nav-links", "pager", "toc"], self.link_list()), lambda: f"<ul id='menu'>{''.join(f'<li><a href=/a>{self.words(1, 2)}</a></li>' for _ in range(r.randint(3, 9)))}</ul>"])()
        if kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{prose(1, 12)}</p>", self.link_list(), self.words(1, 8)])
            return r.choice([lambda: e("header", ["header", "site-header", "masthead"], inner, 0.6), lambda: e("div", ["header", "masthead", "topbar", "banner", "top", "logo", "site-title"], inner)])()
        if kind == "footer":
            inner = r.choice([f"&copy; {self.words(1, 5)} &middot; {prose(1, 14)}", f"<p>{prose(1, 25)}</p>", self.link_list(), f"<p>&copy; {r.randint(1990, 2030)}</p><p>{prose()}</p>"])
            return r.choice([lambda: e("footer", ["footer", "site-footer"], inner, 0.7), lambda: e("div", ["footer", "footer-inner", "copyright", "legal", "bottom", "colophon"], inner)])()
        if kind == "side":
            inner = "".join(r.choice([f"<h3>{self.words(1, 4)}</h3>", self.link_list(), f"<p>{prose(1, 40)}</p>", prose(1, 20)]) for _ in range(r.randint(1, 4)))
            return r.choice([lambda: e("aside", ["sidebar", "related", "widget", "rail", "more"], inner, 0.6), lambda: e(r.choice(["div", "div", "section", "td"]), ["sidebar", "right-rail", "widget", "related", "popular-posts", "side", "secondary", "recommended", "teaser"], inner)])()
        if kind == "notice":
            inner = r.choice([prose(1, 40), f"<p>{prose(1, 30)}</p>", f"<p>{prose(1, 30)}</p><button>{self.words(1, 2)}</button>", f"<span>{prose(1, 20)}</span> <a href='/p'>{self.words(1, 2)}</a>"])
            tag = r.choice(["div", "div", "section", "p", "aside", "dialog"])
            return e(tag, ["notice", "cookie-notice", "cookie-banner", "alert", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "announcement", "privacy-message", "site-notice", "warning", "infobar", "disclaimer"], inner if tag != "p" else prose(1, 40))
        if kind == "advert":
            inner = r.choice([prose(1, 30), f"<p>{prose(1, 30)}</p>", f"<a href='/ad'>{prose(1, 12)}</a>", f"<h4>{self.words(1, 5)}</h4><p>{prose()}</p>"])
            tag = r.choice(["div", "div", "div", "section", "aside", "p"])
            return e(tag, ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "adsbygoogle", "sponsor", "promotion"], inner if tag != "p" else prose(1, 30))
        if kind == "form":
            inner = r.choice([f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>", f"<p>{prose(1, 15)}</p><input><select><option>{self.words(1, 2)}</select>", f"<fieldset><legend>{self.words(1, 3)}</legend>{self.words(1, 8)}<textarea>{self.words(1, 5)}</textarea></fieldset>", f"{self.words(1, 6)} <input type=submit>"])
            return r.choice([lambda: e("form", ["search", "login-form", "signup", "contact"], inner, 0.7), lambda: e("div", ["form", "login", "search-box", "signup"], inner)])()
        if kind == "share":
            return e("div", ["share", "social", "tags", "share-buttons", "follow", "tools"], self.link_list(2, 5))
        if kind == "hidden":
            return r.choice([f"<div hidden>{prose()}</div>", f"<div style='display:none'><p>{prose()}</p></div>", f"<p class='sr-only'>{prose(1, 8)}</p>", f"<div aria-hidden='true'>{prose()}</div>"])
        one = lambda: r.choice([f"<p>{prose(1, 60)}</p>", f"<p>{prose(1, 60)}</p><p>{prose(1, 40)}</p>", f"<h4>{self.words(1, 3)}</h4><div>{prose(1, 60)}</div>", prose(1, 40), f"<b>{self.words(1, 2)}</b> {prose(1, 40)}"])
        tag, inside = r.choice([("div", ["comment", "reply", "comment-body", "review"]), ("li", ["comment", "reply"]), ("article", ["comment", "comment-item", "reply"]), ("p", ["comment", "reader"])])
        inner = "".join(e(tag, inside, one() if tag != "p" else self.prose(False, 1, 40), 0.2) for _ in range(r.randint(1, 6)))
        inner = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.5 else "") + (f"<ol>{inner}</ol>" if tag == "li" else inner)
        return e(r.choice(["div", "section", "aside"]), ["comments", "comments-area", "comment-list", "reader-comments", "disqus_thread", "discussion", "responses", "replies", "feedback"], inner)

    def article(self) -> str:
        r, parts = self.r, []
        head = f"<h1>{self.MARK}{self.words(1, 12)}</h1>"
        if r.random() < 0.8:
            parts.append(f"<header>{head}</header>" if r.random() < 0.2 else head)
        parts.append(self.paragraphs(True, 1, r.choice([1, 3, 10, 25])))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            parts.append(r.choice([
                lambda: f"<h2>{self.MARK}{self.words(1, 7)}</h2>" + self.paragraphs(True, 1, 5), lambda: "<ul>" + "".join(f"<li>{self.prose(True, 1, 15)}</li>" for _ in range(r.randint(1, 7))) + "</ul>",
                lambda: f"<blockquote>{r.choice(['<p>', ''])}{self.prose(True)}</blockquote>", lambda: f"<pre>{self.MARK}{self.words(2, 30)}</pre>",
                lambda: "<table>" + "".join(f"<tr><td>{self.MARK}{self.words(1, 4)}</td><td>{self.MARK}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
                lambda: f"<figure><img src=a><figcaption>{self.MARK}{self.words(2, 12)}</figcaption></figure>", lambda: f"<div>{self.paragraphs(True, 1, 4)}</div>", lambda: f"<section>{self.paragraphs(True, 1, 4)}</section>",
            ])())
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), self.junk(r.choice(["advert", "advert", "share", "side", "notice", "form", "menu", "hidden", "comment", "footer"])))
        inner = "".join(parts)
        return r.choice([
            lambda: f"<article>{inner}</article>", lambda: f"<article>{inner}</article>", lambda: self.element("article", ["post", "article", "entry", "story"], inner, 0.2), lambda: f"<main>{inner}</main>",
            lambda: f"<main><article>{inner}</article></main>", lambda: f"<main><div class='content'>{inner}</div></main>", lambda: self.element("div", ["content", "main", "post", "article-body", "entry-content", "story", "text", "maincontent"], inner),
            lambda: self.element("section", ["content", "article", "story"], inner), lambda: inner, lambda: f"<div>{inner}</div>",
        ])()

    def page(self) -> str:
        r = self.r
        before = [self.junk(k) for k in ("header", "menu", "notice", "advert", "form", "side", "hidden") if r.random() < (0.6 if k in ("menu", "header") else 0.25)]
        after = [self.junk(k) for k in ("comment", "side", "advert", "share", "menu", "form", "notice", "footer") if r.random() < (0.8 if k == "footer" else 0.3)]
        if r.random() < 0.7:
            r.shuffle(before)
        main = self.article() if r.random() < 0.95 else ""
        near = after[: r.randint(0, len(after))]
        if r.random() < 0.4:
            main = r.choice(["<div>{}</div>", "<div class='page'>{}</div>", "<div id='wrapper'>{}</div>", "<div class='container'><div class='row'>{}</div></div>", "<table><tr><td>{}</table>"]).format(main + "".join(near))
            after = after[len(near) :]
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            body = r.choice(["<div id='page'>{}</div>", "<div class='wrapper'>{}</div>", "<div>{}</div>", "<form id='aspnetForm'>{}</form>", "<div class='site'>{}</div>"]).format(body)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(seed: int, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of all block nodes of composed pages."""
    composer, rows, classes = Composer(seed), [], []
    for _ in range(pages):
        nodes = Tree(_BUTTON.sub("", composer.page())).nodes
        has = [any(Composer.MARK in t for t in x.text) for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            has[nodes[i].parent] |= has[i]
        for x in nodes:
            x.text = [t.replace(Composer.MARK, "") for t in x.text]
        rows.append(features(nodes)[1:])
        classes.append(np.array(has[1:], float))
    return np.concatenate(rows), np.concatenate(classes)


@lru_cache(maxsize=2)
def model(pages: int = TRAINING_PAGES, seed: int = SEED) -> Trees:
    return fit(*labelled(seed, pages))


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the nodes of short pages are classified together, those of a long one in slices."""
    parsed = [Tree(p or "").nodes for p in pages]
    if not parsed:
        return []
    if len(parsed) == 1:
        margin = np.concatenate([trees.margin(rows) for rows in feature_rows(parsed[0])])
    else:
        margin = trees.margin(np.concatenate([features(nodes) for nodes in parsed]))
    cuts = np.cumsum([len(nodes) for nodes in parsed])[:-1]
    return [main_text(nodes, decode([x.parent for x in nodes], m)) for nodes, m in zip(parsed, np.split(margin, cuts), strict=True)]


def extract_pages(pages: DataFrame, training_pages: int = TRAINING_PAGES, seed: int = SEED) -> DataFrame:
    """Extracts the main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    The whole html is read. A null or empty one, and a page without main text, give an empty text. Rows stay as they are, repeated ones and
    null ids too; other columns are not read; an empty table gives an empty result. The trees learn from ``training_pages``
    composed pages on the driver and are broadcast: some thousand numbers, whatever the input.
    """
    trees = pages.sparkSession.sparkContext.broadcast(model(training_pages, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            texts: list[str] = []
            for a, b in steps([len(h or "") for h in html], TOGETHER):
                texts += extract(html[a:b], trees.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ship(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
