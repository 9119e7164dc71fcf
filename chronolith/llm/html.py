"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A classifier's costs of calling a block content or
boilerplate become the capacities of its edges to the two terminals; neighbours in the page and in the document tree
are tied by smoothness edges, the stronger the closer they are in the tree. The maximum flow separates content from
boilerplate at the least total cost, so a short paragraph goes with the long ones around it.

The classifier is a logistic regression over what the elements around a block, its class and id words, link share,
length and wording say. The pages carry no labels, so it learns from written ones, whose blocks are known: articles of
several layouts between menus, notices, sidebars, forms, comments and footers, with and without telling names. Where it
finds no content at all, class and id words that articles may also have don't count.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter, deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows

_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content isn't markup.
_RAW = {"script", "style", "iframe", "textarea", "title"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""=\s*["']|>""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS_P = {"button", "caption", "td", "th", "li", "dd", "dt", "body", "html", "article", "section", "main", "div", "blockquote"}

_BAD_TAG = {"nav": -9, "footer": -9, "aside": -9, "form": -9, "menu": -9, "dialog": -9, "button": -9, "fieldset": -9, "head": -9, "search": -9, "select": -9, "option": -9, "template": -9}
_GOOD_TAG = {"article": 5, "main": 4, "p": 1, "blockquote": 1, "pre": 1, "h1": 1, "h2": 1, "h3": 1, "figcaption": 0.5}
_BAD_WORD = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget|related|recommend\w*|trending|popular|footer|foot|masthead|topbar|toolbar|share|sharing|social|comments?\w*|commentlist|respond|replies|reply|disqus|discussion|tags?|pagination|pager|search|skip|hidden|copyright|legal|disclaimer)(?=$|[-_\s\d])", re.I)
#: Of these, words that an article may also have to do with: they don't count where a page has nothing else.
_WEAK_WORD = re.compile(r"^[-_\s]*(?:notice|notification|alert|legal|discussion|disclaimer|side|widget|related|recommend\w*|trending|popular|share|sharing|social|tags?|search|banner|overlay|modal|login|consent|foot|skip|copyright)$", re.I)
_MODIFIER = re.compile(r"\b(?:has|have|with|without|no|is|js)[-_][\w-]+", re.I)
_HEADER_WORD = re.compile(r"(?:^|[-_\s])(?:page|site|top|main|global)?-?header(?=$|[-_\s\d])", re.I)
_GOOD_WORD = re.compile(r"(?:^|[-_\s])(?:article\w*|content|entry|story|post|main|body|text|prose|maincontent)(?=$|[-_\s\d])", re.I)
_SAYS = re.compile(r"^(?:©|\(c\)|copyright\b|all rights reserved|share this|follow us|subscribe|sign up|log ?in|accept (?:all )?cookies|we use cookies|advertisement|read more|related (?:articles|posts)|leave a (?:comment|reply)|skip to)", re.I)

#: Capacity of one unit of cost; ties of blocks whose nearest common element is near and far.
UNIT, NEAR, FAR = 250, 150, 20


class Element:
    """An open element; low and good are the least cost and the sum of the positive ones from the root, first as they
    are, then without weak words."""

    __slots__ = ("depth", "good", "inside", "low", "number", "tag", "up")

    def __init__(self, tag: str, number: int, up: "Element | None", cost: float = 0.0, weak: float = 0.0):
        self.tag, self.number, self.up = tag, number, up
        own = (cost, cost - weak)
        self.depth = up.depth + 1 if up else 0
        self.inside = tag in ("article", "main") or bool(up and up.inside)
        self.low = tuple(min(a, b) for a, b in zip(own, up.low)) if up else (0.0, 0.0)
        self.good = tuple(max(a, 0.0) + b for a, b in zip(own, up.good)) if up else (0.0, 0.0)


class Block:
    __slots__ = ("links", "parts", "size", "text", "under")

    def __init__(self, under: Element):
        self.parts, self.under, self.links, self.size, self.text = [], under, 0, 0, ""


def tokens(page: str):
    """(text, name, attributes) in order: text before a tag and the tag, "" at the end; name has / in front for an end tag.

    One pass: quotes count after = alone, as in browsers; one that never closes ends with its tag, and after a tag that
    doesn't end because of its quotes, quotes don't count any more. A tag that never ends takes the rest with it.
    """
    at = start = 0
    quotes, n = True, len(page)
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            yield page[start : n if lt < 0 else lt], "", ""
            return
        sign = page[lt + 1]
        if sign in "!?":
            close = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            if close < 2:
                yield page[start:lt], "", ""
                return
            yield page[start:lt], "", ""
            at = start = close + 1
            continue
        name = _NAME.match(page, lt + 1)
        if not name:
            at = lt + 1
            continue
        pos, close = name.end(), -1
        while quotes:
            stop = _STOP.search(page, pos)
            if not stop:
                quotes = False
            elif stop[0] == ">":
                close = stop.start()
                break
            else:
                shut = page.find(stop[0][-1], stop.end())
                if shut < 0:
                    close = page.find(">", stop.end())
                    quotes = close >= 0
                    break
                pos = shut + 1
        if not quotes:
            close = page.find(">", name.end())
        if close < 0:
            yield page[start:lt], "", ""
            return
        tag = name[0].lower()
        yield page[start:lt], tag, page[name.end() : close]
        at = start = close + 1
        if tag in _RAW and page[close - 1] != "/":
            end = _RAW_END[tag].search(page, at)
            if not end:
                return
            shut = page.find(">", end.end())
            if shut < 0:
                return
            at = start = shut + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    under = Element("", 0, None)
    opened: Counter[str] = Counter()
    out: list[Block] = []
    now, links, number = Block(under), 0, 0

    def end():
        nonlocal now
        if now.parts:
            now.text = " ".join(entities.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        now = Block(under)

    def leave():
        nonlocal under
        opened[under.tag] -= 1
        under = under.up

    def say(text: str):
        if text:
            now.parts.append(text)
            size = len(text.strip())
            now.size += size
            now.links += size if links else 0

    for text, tag, attrs in tokens(page):
        say(text)
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK:
                end()
                if opened[tag] > 0:
                    while under.tag != tag:
                        leave()
                    leave()
                    links = 0
                now = Block(under)
            continue
        if tag in _RAW:
            continue
        if tag == "br":
            say(" ")
        elif tag in _BLOCK:
            end()
            if tag in _CLOSES or under.tag == "p":
                shut = _CLOSES.get(tag, {"p"}) | {"p"}
                while under.tag in shut:
                    leave()
            if tag not in _VOID:
                number += 1
                opened[tag] += 1
                under = Element(tag, number, under, *_element(tag, attrs, under.inside))
            links = 0
            now = Block(under)
        elif tag == "a":
            links += 1
    end()
    return out


def _element(tag: str, attrs: str, inside: bool) -> tuple[float, float]:
    """What being inside this element says for content; and how much of that is due to weak words."""
    cost, weak = _BAD_TAG.get(tag, _GOOD_TAG.get(tag, 0.0)), 0.0
    if tag == "header" and not inside:
        cost = -9.0
    if attrs:
        words = ""
        for name, a, b, c in _ATTR.findall(attrs):
            value, name = a or b or c, name.lower()
            if name in ("class", "id", "role"):
                words += " " + value
            elif name == "itemprop":
                cost += 4 if value.lower() == "articlebody" else 0
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                cost -= 9
        words = _MODIFIER.sub("", words) if words else ""
        if words and tag not in ("body", "html", "article", "main"):
            bad = [x[0] for x in _BAD_WORD.finditer(words)]
            sure = (_HEADER_WORD.search(words) and not inside) or re.search(r"\b(?:navigation|contentinfo|complementary|dialog)\b", words, re.I) or (bad and not all(map(_WEAK_WORD.match, bad)))
            if bad or sure:
                cost -= 9
                weak = 0.0 if sure else -9.0
            elif _GOOD_WORD.search(words):
                cost += 3
    return cost, weak


def traits(block: Block, weak: bool = True) -> list[float]:
    """What the classifier looks at."""
    low, good = block.under.low[not weak], block.under.good[not weak]
    share, words = block.links / block.size if block.size else 0.0, len(block.text.split())
    return [
        1.0, float(low <= -5), min(good, 8.0) / 8, float(words >= 25), float(10 <= words < 25), float(words < 4), max(0.0, share - 0.3),
        float(block.text.endswith((".", "!", "?", "”", "»", '"'))), float(words < 30 and bool(_SAYS.search(block.text))),
    ]


def written_pages(n: int = 300, seed: int = 3):
    """Pages as training has them: each block of an article, and no other, has words that begin with x."""
    rng = random.Random(seed)
    text = lambda k, mark="": " ".join(mark + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    links = lambda k: "".join(f"<li><a href=#>{text(rng.randrange(1, 4))}</a></li>" for _ in range(k))
    pick = rng.choice
    for _ in range(n):
        blocks = [f"<h1>{text(rng.randrange(2, 10), 'x')}</h1>"]
        for _ in range(rng.randrange(2, 12)):
            tag, k = pick([("p", rng.randrange(25, 90))] * 5 + [("p", rng.randrange(4, 25)), ("h2", rng.randrange(1, 7)), ("blockquote", 20), ("ul", rng.randrange(3, 14)), ("pre", 12)])
            inner = text(k, "x") + ("" if tag in ("h2", "pre") else pick(".!?."))
            if tag == "p" and rng.random() < 0.3:
                inner = inner.replace(" x", " <a href=#>x", 1) + "</a>"
            if tag == "p" and rng.random() < 0.1:
                inner = pick(["All rights reserved", "Read more", "Copyright", "Subscribe"]) + " " + text(pick((1, 3, 12)), "x") + "."
            blocks.append(f"<ul><li>{inner}</li><li>{text(5, 'x')}</li></ul>" if tag == "ul" else f"<{tag}>{inner}</{tag}>")
        opened, closed = pick([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<div>", "</div>"), ("<main><article>", "</article></main>")])
        before = [
            pick([f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(6)}</ul></div>', f"<div><ul>{links(6)}</ul></div>"]),
            pick([f"<header><p>{text(6)}</p></header>", f'<div class="site-header"><h1>{text(3)}</h1><p>{text(12)}.</p></div>', ""]),
            pick([f'<div class="cookie-notice"><p>We use cookies. {text(30)}.</p><button>{text(1)}</button></div>', f"<div><p>We use cookies {text(12)}.</p></div>", ""]),
        ]
        after = [
            pick([f"<aside><p>{text(40)}.</p></aside>", f'<div class="sidebar"><h3>{text(2)}</h3><ul>{links(5)}</ul><p>{text(30)}.</p></div>', f"<div><h3>{text(2)}</h3><ul>{links(5)}</ul></div>", ""]),
            pick([f'<div id="comments"><p>{text(45)}.</p><p>{text(9)}!</p></div>', f'<section class="comment-list"><div>{text(60)}.</div></section>', ""]),
            pick([f'<div class="ad"><p>{text(26)}!</p></div>', f"<form><label>{text(2)}</label><input></form>", f'<div class="newsletter"><p>Subscribe {text(12)}.</p></div>', ""]),
            pick([f"<footer><p>{text(26)}.</p></footer>", f'<div class="footer">© {text(6)}</div>', f"<div><p>© {text(6)}</p></div>"]),
        ]
        yield "<body>" + "".join(before) + opened + "".join(blocks) + closed + "".join(after) + "</body>"


@cache
def weights(ridge: float = 0.003, rounds: int = 15) -> tuple[float, ...]:
    """The classifier, by Newton's method on the blocks of written_pages()."""
    found = [b for page in written_pages() for b in blocks(page)]
    x = np.array([traits(b) for b in found])
    y = np.array([any(w[0] == "x" for w in b.text.split()) for b in found], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * w)
    return tuple(w.tolist())


def cost(block: Block, weak: bool = True) -> float:
    """The classifier's log-odds: above 0 for content, below for boilerplate."""
    return sum(a * b for a, b in zip(weights(), traits(block, weak)))


def closeness(a: Block, b: Block) -> int:
    """Smoothness capacity by the distance in the tree to the nearest common element."""
    x, y, far = a.under, b.under, 0
    while x is not y and NEAR >> max(0, far - 2) > FAR:
        if x.depth >= y.depth:
            x, far = x.up, far + 1
        else:
            y, far = y.up, far + 1
    return max(FAR, NEAR >> max(0, far - 2))


def min_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut: gain > 0 ties to the source, < 0 to the sink.

    Augments along shortest paths in the levels of a breadth-first search (blocking flows), so crowded pages stay
    polynomial. Of several minimum cuts the one with the smallest source side is taken.
    """
    n = len(gains)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to)), to.append(b), room.append(there)
        graph[b].append(len(to)), to.append(a), room.append(back)

    for v, g in enumerate(gains):
        if g > 0:
            add(s, v, g, 0)
        elif g < 0:
            add(v, t, -g, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        used = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while used[v] < len(graph[v]):
                e = graph[v][used[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                used[v] += 1
            else:
                if v == s:
                    break
                v = to[path.pop() ^ 1]
                used[v] += 1


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by spaces; "" where there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    gains = [round(UNIT * cost(b)) for b in found]
    if all(g <= 0 for g in gains):
        gains = [round(UNIT * cost(b, weak=False)) for b in found]
    edges = [(k, k + 1, closeness(found[k], found[k + 1])) for k in range(len(found) - 1)]
    last: dict[int, int] = {}  # element -> its last child block, for ties across what lies between siblings
    for k, b in enumerate(found):
        parent = b.under.up.number if b.under.up else 0
        if parent in last and last[parent] < k - 1:
            edges.append((last[parent], k, NEAR // 2))
        last[parent] = k
    if all(g <= 0 for g in gains):
        return ""
    content = [True] * len(found) if all(g >= 0 for g in gains) else min_cut(gains, edges)
    return " ".join(b.text for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages, from the whole html.

    Null and empty html and pages without content give an empty text; n_chars counts code points. Repeated rows and
    null ids keep their rows; an empty table gives no rows; other columns are ignored.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x.as_py()).encode("utf-8", "replace").decode() for x in batch.column(2)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return one

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
