"""HTML extraction by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements. Each element has features of its own and of its subtree
and siblings: text and link density, attribute tokens, depth, place among siblings. Boosted
trees give each the odds of being main text, and a dynamic program over the tree chooses
labels that agree: content starts under an outer element at a price, boilerplate may be cut
out of it at a price, and nothing under a cut is content again.

The trees are trained on pages that ``sample_pages`` generates with their labels, a fixed
number of them. Character references are decoded, white space in a block becomes one space,
blocks are joined by one space; void, raw and unfinished tags are handled as browsers do.

A null or empty page, or one without text, gives an empty string. Ids may be null or repeat,
an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: One attribute: a name of any characters but space, ``/``, ``>`` and a later ``=``, and a value after ``=``, in quotes or not.
ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)?))?")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAMING = {"class", "id", "role", "itemprop", "aria-label"}
WORDS = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "head"}
SWALLOWED = {"script", "style", "textarea", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What the start of an element closes, up to the nearest holder.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "body", "main", "text", "blog", "page"}
OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "consent", "footer", "header", "menu", "nav", "navigation", "newsletter", "notice", "pager", "popup", "promo", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "form", "search", "login", "modal", "disqus", "copyright", "legal"}
GROUPS = [{"p", "blockquote", "pre", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dd", "dt"}, {"div", "section", "body", "html"}, {"article", "main"}, {"nav", "footer", "header", "aside", "menu"}, {"form", "button", "label", "fieldset", "input", "option"}, {"a"}, {"table", "tr", "td", "th", "tbody", "thead"}]
KIND = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
N_FEATURES = len(GROUPS) + 21


@dataclass
class Page:
    """Elements in document order and runs of text, each with its element and whether a block begins before it."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    attributes: list[str] = field(default_factory=lambda: [""])
    naming: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    runs: list[tuple[int, str, bool]] = field(default_factory=list)


def tag_end(source: str, pos: int) -> tuple[int, str]:
    """Where the tag whose name ends at pos ends, and the values of its naming attributes; -1 if the page ends first.

    As in browsers, a quote holds a value only after ``=``, and only such a value may hold ``>``.
    """
    names = []
    while True:
        m = ATTRIBUTE.match(source, pos)
        at = m.end()
        if at < len(source) and source[at] == ">":
            if m[1].lower() in NAMING:
                names.append(m[2] or m[3] or m[4] or "")
            return at + 1, " ".join(names)
        if at >= len(source):
            return -1, ""
        if source[at] in "\"'" and m[0].rstrip().endswith("="):
            return -1, ""  # an opened value that nothing closes
        if m[1].lower() in NAMING:
            names.append(m[2] or m[3] or m[4] or "")
        pos = max(at, pos + 1)


class Stack:
    """Open elements, with the depths at which each tag name and each block is open, so that no look-up walks the stack."""

    def __init__(self, page: Page):
        self.page, self.held, self.hidden = page, [0], 0
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, i: int) -> None:
        name = self.page.tags[i]
        self.depths.setdefault(name, []).append(len(self.held))
        if name in BLOCKS:
            self.blocks.append(len(self.held))
        self.hidden += name in RAW
        self.held.append(i)

    def pop_to(self, depth: int) -> None:
        while len(self.held) > depth:
            name = self.page.tags[self.held.pop()]
            self.depths[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.hidden -= name in RAW

    def deepest(self, names) -> int:
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)


def parse(source: str | None) -> Page:
    """One pass over the page; the work grows with its length, whatever it holds."""
    page, fresh = Page(), True
    source = source or ""
    stack, runs = Stack(page), page.runs
    at = pos = 0
    while True:
        start = source.find("<", pos)
        after = source[start + 1 : start + 2] if start >= 0 else ""
        closing = after == "/"
        named = NAME.match(source, start + 1 + closing) if start >= 0 else None
        if start >= 0 and not named and (after not in ("!", "?", "/") or start + 2 >= len(source)):
            pos = start + 1
            continue
        end = start if start >= 0 else len(source)
        if end > at and not stack.hidden:
            text = source[at:end]
            if text.strip():
                runs.append((stack.held[-1], html.unescape(text), fresh))
                fresh = False
            elif not fresh and runs:
                runs.append((stack.held[-1], " ", False))
        if start < 0:
            return page
        if not named:
            comment = source.startswith("<!--", start)
            close = source.find("-->" if comment else ">", start + 2)
            at = pos = len(source) if close < 0 else close + (3 if comment else 1)
            continue
        close, naming = tag_end(source, named.end())
        if close < 0:
            return page
        at = pos = close
        name = named[0].lower()
        if name in BLOCKS:
            fresh = True
        if closing:
            depth = stack.deepest([name])
            if depth:
                stack.pop_to(depth)
            continue
        if name in CLOSES:
            ends, holders = CLOSES[name]
            inside = stack.deepest(holders)
            open_ends = [stack.depths[n][-1] for n in ends if stack.depths.get(n) and stack.depths[n][-1] > inside]
            if open_ends:
                stack.pop_to(min(open_ends))
        elif name in BLOCKS and name != "br" and stack.blocks and page.tags[stack.held[stack.blocks[-1]]] == "p":
            stack.pop_to(stack.blocks[-1])
        if name == "body" and stack.depths.get("head"):
            stack.pop_to(stack.depths["head"][-1])
        if name in VOID:
            continue
        page.tags.append(name)
        page.attributes.append(source[named.end() : close - 1])
        page.naming.append(naming)
        page.parents.append(stack.held[-1])
        if name == "svg" and page.attributes[-1].endswith("/"):
            continue
        if name in SWALLOWED:
            shut = re.compile(rf"</{name}\b", re.I).search(source, at)
            at = pos = shut.start() if shut else len(source)
        stack.push(len(page.tags) - 1)


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    tags, parents = page.tags, page.parents
    own = [0] * n
    stops = [0] * n
    blocks = [0] * n
    order = [0.0] * n
    total = 0
    for i, text, fresh in page.runs:
        size = len(text)
        own[i] += size
        stops[i] += text.count(".") + text.count(",")
        blocks[i] += fresh
        total += size
    chars, links, nodes, paras, marks, parts = own[:], [0] * n, [1] * n, [0] * n, stops, blocks
    depth, kids, place, twins = [0] * n, [0] * n, [0] * n, [0] * n
    good, bad = [0] * n, [0] * n
    above_good, above_bad, above_nav, above_main = [0] * n, [0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(n):
        for w in WORDS.findall(page.naming[i].lower()):
            good[i] += w in CONTENT_WORDS
            bad[i] += w in OTHER_WORDS
        if i:
            p = parents[i]
            depth[i], place[i] = depth[p] + 1, kids[p]
            kids[p] += 1
            same[p, tags[i]] = same.get((p, tags[i]), 0) + 1
            above_good[i], above_bad[i] = above_good[p] + (good[p] > 0), above_bad[p] + (bad[p] > 0)
            above_nav[i] = above_nav[p] + (KIND.get(tags[p]) in (5, 6))
            above_main[i] = above_main[p] + (KIND.get(tags[p]) == 4)
        order[i] = i / n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if tags[i] == "a":
            links[i] = chars[i]
        if tags[i] == "p":
            paras[i] += 1
        chars[p] += chars[i]
        links[p] += links[i]
        nodes[p] += nodes[i]
        paras[p] += paras[i]
        marks[p] += marks[i]
        parts[p] += parts[i]
    out = np.zeros((n, N_FEATURES))
    for i in range(n):
        k = KIND.get(tags[i])
        if k is not None:
            out[i, k] = 1
        p = max(parents[i], 0)
        c = chars[i]
        out[i, len(GROUPS) :] = (
            depth[i], math.log1p(c), math.log1p(nodes[i]), c / nodes[i], links[i] / c if c else 0, math.log1p(paras[i]), 100 * marks[i] / c if c else 0,
            good[i], bad[i], above_good[i], above_bad[i], above_nav[i], above_main[i], place[i], kids[p], same.get((p, tags[i]), 1) / max(1, kids[p]),
            c / max(1, chars[p]), c / max(1, total), order[i], c / max(1, parts[i]), links[p] / max(1, chars[p]),
        )
    return out


@dataclass
class Forest:
    """Trees of fixed depth: per tree the feature and limit of each inner node and the value of each leaf."""

    depth: int
    split: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for split, limit, leaf in zip(self.split, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, split[at]] > limit[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24) -> Forest:
    """Logistic gradient boosting on quantile bins, level by level."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner = 2**depth - 1
    splits, limits, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    f = np.zeros(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = at - first
            best = np.full(wide, 1e-6)
            for j, e in enumerate(edges):
                cell = local * (bins + 1) + binned[:, j]
                gs = np.bincount(cell, g, wide * (bins + 1)).reshape(wide, -1).cumsum(1)
                hs = np.bincount(cell, h, wide * (bins + 1)).reshape(wide, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1))[:, : len(e)]
                if not len(e):
                    continue
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                for k in np.flatnonzero(value > best):
                    best[k], splits[t, first + k], limits[t, first + k] = value[k], j, e[top[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), splits[t, at]] > limits[t, at])
        leaf = at - inner
        leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        f += leaves[t][leaf]
    return Forest(depth, splits, limits, leaves)


def sample_pages(n: int = 400, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """Generated pages, and the marks of the elements that hold main text (attribute data-k)."""
    r = random.Random(seed)
    syllables = ["ka", "ri", "to", "men", "lu", "sta", "ne", "vo", "shi", "dor", "pe", "an", "the", "ing", "é", "ü"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def prose(a: int, b: int) -> str:
        w = [word() for _ in range(r.randint(a, b))]
        return " ".join(x + r.choice(["", "", "", "", "", ",", ".", "%%%", "&amp;"]) if r.random() < 0.4 else x for x in w).capitalize() + r.choice([".", ".", "", "!"])

    for _ in range(n):
        count, main = 0, set()
        plain = r.random() < 0.3

        def element(tag: str, inner: str, content: bool = False, names: str = "") -> str:
            nonlocal count
            count += 1
            if content:
                main.add(str(count))
            named = f' class="{names}"' if names and not plain else ""
            return f'<{tag} data-k="{count}"{named}>{inner}' + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>")

        links = lambda a, b: "".join(element("li", element("a", prose(1, 3))) for _ in range(r.randint(a, b)))
        top = [element("nav" if r.random() < 0.6 else "div", element("ul", links(3, 9)), names="menu nav")]
        if r.random() < 0.5:
            top.insert(0, element("header", element("a", prose(1, 3)) + (element("p", prose(3, 8)) if r.random() < 0.5 else ""), names="header"))
        if r.random() < 0.5:
            top.append(element("div", prose(4, 20), names=r.choice(["ad", "cookie notice", "banner", "breadcrumbs", "promo"])))
        body = [element("h1", prose(2, 14), True)] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
            x = r.random()
            if x < 0.72:
                body.append(element("p", element("b", prose(1, 40), True) + " " + prose(1, 20) if r.random() < 0.2 else prose(1, r.choice([3, 20, 120])), True))
            elif x < 0.8:
                body.append(element("h2", prose(2, 8), True))
            elif x < 0.86:
                body.append(element("ul", "".join(element("li", prose(4, 18), True) for _ in range(r.randint(2, 5))), True))
            elif x < 0.9:
                body.append(element("blockquote", element("p", prose(10, 40), True), True))
            elif x < 0.94:
                body.append(element("table", element("tr", "".join(element("td", prose(1, 6), True) for _ in range(3)), True), True))
            else:
                body.append(element(r.choice(["div", "aside"]), prose(4, 20), names=r.choice(["ad", "related", "share", "newsletter signup"])))
        if not body:
            body = [element("p", prose(20, 80), True)]
        if r.random() < 0.15:
            body = [prose(20, 90)]
        shell = r.choice(["article", "article", "main", "div", "section"])
        middle = element(shell, "".join(body), True, r.choice(["post content", "entry", "article body", ""]))
        if r.random() < 0.4:
            middle = element("main" if shell != "main" else "div", middle, True, "main")
        after = []
        if r.random() < 0.4:
            replies = "".join(element(r.choice(["div", "article", "li"]), element("p", prose(3, 40)), names="comment") for _ in range(r.randint(1, 6)))
            after.append(element(r.choice(["section", "div"]), element("h3", prose(1, 3)) + replies, names="comments"))
        if r.random() < 0.4:
            after.append(element(r.choice(["aside", "div"]), element("h3", prose(1, 3)) + element("ul", links(2, 7)) + (element("p", prose(5, 25)) if r.random() < 0.5 else ""), names="sidebar widget"))
        if r.random() < 0.3:
            after.append(element("form", element("label", prose(1, 3)) + element("button", prose(1, 2)), names="signup form"))
        if r.random() < 0.85:
            after.append(element("footer" if r.random() < 0.7 else "div", "&copy; " + prose(3, 16) if r.random() < 0.6 else element("p", "&copy; " + prose(3, 20)), names="footer"))
        page = "<html><head><title>" + prose(2, 6) + "</title><style>p{}</style></head><body>" + "".join(top) + middle + "".join(after)
        yield (page if r.random() < 0.2 else page + "</body></html>"), main
        if r.random() < 0.05:
            yield prose(10, 80), {"#page"}


@lru_cache(maxsize=1)
def trained() -> Forest:
    """The trees, trained once in a process; always the same."""
    xs, ys = [], []
    for source, main in sample_pages():
        page = parse(source)
        marks = [re.search(r'data-k="(\d+)"', a) for a in page.attributes]
        xs.append(features(page))
        ys.append(np.array([bool(m and m[1] in main) or (i == 0 and "#page" in main) for i, m in enumerate(marks)], float))
    return boost(np.vstack(xs), np.concatenate(ys))


#: What it costs, in log-odds, to start content under an outer element and to cut boilerplate out of it.
START, CUT = 2.0, 1.0


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each element is content, by the best labelling of the whole tree."""
    n = len(page.tags)
    yes = (-np.logaddexp(0, -odds)).tolist()
    no = (-np.logaddexp(0, odds)).tolist()
    inside, cut, outer = yes, no[:], no[:]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        inside[p] += max(inside[i], cut[i] - CUT)
        cut[p] += cut[i]
        outer[p] += max(outer[i], inside[i] - START)
    state = [0] * n  # 0: outer, 1: content, 2: cut
    state[0] = int(inside[0] - START > outer[0])
    for i in range(1, n):
        above = state[page.parents[i]]
        state[i] = 2 if above == 2 else (1 if inside[i] >= cut[i] - CUT else 2) if above == 1 else int(inside[i] - START > outer[i])
    return [s == 1 for s in state]


def main_text(page: Page, content: list[bool]) -> str:
    out, fresh = [], False
    for i, text, begins in page.runs:
        fresh |= begins
        if content[i]:
            out.append(" " + text if fresh else text)
            fresh = False
        else:
            fresh = True
    return " ".join("".join(out).split())


def extract(sources: list[str | None], forest: Forest) -> list[str]:
    """The main texts of a group of pages; their elements pass the trees together."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    odds = forest.odds(np.vstack([features(p) for p in pages]))
    ends = np.cumsum([len(p.tags) for p in pages])
    return [main_text(p, decode(p, odds[e - len(p.tags) : e])) if p.runs else "" for p, e in zip(pages, ends)]


def extract_pages(pages: DataFrame, group: int = 256) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    forest = trained()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            held = sources.tolist()
            yield pd.Series([t for k in range(0, len(held), group) for t in extract(held[k : k + group], forest)], dtype=object)

    text = F.pandas_udf(run, "string")
    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
