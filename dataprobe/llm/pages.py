"""Main text of web pages: boosted trees judge the nodes of the document tree, and one choice is made for the whole tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.boosting import BoostedTrees
from dataprobe.llm.common import pieces, row_column, with_new_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements by what the HTML standard says of them (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg math object audio video canvas head title textarea select "
                   "button option datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul".split())
#: An opening tag ends the open element of its group, up to the nearest holder.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}

#: Tag groups and attribute words that the features tell apart.
TAG_GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"},
    {"form", "fieldset", "label", "dialog"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"div", "section"}, {"a"},
    {"figure", "figcaption"},
]
WORD_GROUPS = [
    set("article content post entry story body main text prose copy".split()),
    set("nav navigation navbar menu breadcrumb breadcrumbs pagination pager toolbar topbar masthead header".split()),
    set("sidebar aside rail widget related recommended more trending popular tags".split()),
    set("ad ads adv advert advertisement adslot banner promo promoted sponsor sponsored".split()),
    set("footer foot copyright legal colophon credits".split()),
    set("comment comments reply replies discussion disqus respond feedback reader".split()),
    set("cookie cookies notice consent gdpr alert popup modal overlay disclaimer warning".split()),
    set("subscribe newsletter signup login register search form share social follow".split()),
]
_GROUP_OF_TAG = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group}
_GROUP_OF_WORD = {word: k for k, group in enumerate(WORD_GROUPS) for word in group}


@lru_cache(maxsize=65_536)
def _attribute_groups(text: str) -> int:
    """The word groups in class, id and role, as bits."""
    bits = 0
    for match in _ATTRIBUTE.finditer(text):
        for word in _WORD.findall(match[1] or match[2] or match[3] or ""):
            k = _GROUP_OF_WORD.get(word.lower())
            if k is not None:
                bits |= 1 << k
    return bits


class Page:
    """The elements of a page in document order, and its visible runs of text.

    Node 0 stands for the page. ``end[v]`` is the number after the last node below ``v``. A run is
    ``(node, block, text)``; runs of one block belong to one paragraph.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.end, self.words = [-1], [-1], [0], [0], [0]
        self.runs: list[tuple[int, int, str]] = []
        names, stack, block, at, hidden = [""], [0], 0, 0, 0

        def close(level: int) -> None:
            nonlocal hidden, block
            while len(stack) > level:
                v = stack.pop()
                self.end[v] = len(self.tag)
                hidden -= names[v] in HIDDEN
                block += names[v] in BLOCK

        raw, lowered = None, None
        for match in _TOKEN.finditer(source):
            begin = match.start()
            if begin < at:
                continue
            if begin > at and not hidden:
                self.runs.append((stack[-1], block, source[at:begin]))
            at = match.end()
            name = (match[2] or match[5] or "").lower()
            if not name:
                continue
            if match[1] or match[4]:
                for level in range(len(stack) - 1, 0, -1):
                    if names[stack[level]] == name:
                        close(level)
                        break
                continue
            if name in BLOCK:
                block += 1
                for level in range(len(stack) - 1, 0, -1):      # a block ends an open paragraph
                    if names[stack[level]] == "p":
                        close(level)
                        break
                    if names[stack[level]] in BLOCK:
                        break
            if name in ENDS:
                ended, holders = ENDS[name]
                for level in range(len(stack) - 1, 0, -1):
                    if names[stack[level]] in holders:
                        break
                    if names[stack[level]] in ended:
                        close(level)
                        break
            v = len(self.tag)
            attributes = match[3] or match[6] or ""
            self.tag.append(_GROUP_OF_TAG.get(name, -1))
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.end.append(v + 1)
            self.words.append(_attribute_groups(attributes) if attributes else 0)
            names.append(name)
            if name == "br" and not hidden:
                self.runs.append((stack[-1], block, " "))
            if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in HIDDEN:
                continue
            stack.append(v)
            hidden += name in HIDDEN
            if name in RAW:
                lowered = source.lower() if lowered is None or len(lowered) != len(source) else lowered
                stop = (lowered if len(lowered) == len(source) else source).find(f"</{name}", at)
                if stop < 0:
                    stop = len(source)
                at = stop
        if at < len(source) and not hidden:
            self.runs.append((stack[-1], block, source[at:]))
        close(0)


FEATURES = 24 + len(TAG_GROUPS) + 2 * len(WORD_GROUPS) + 6


def node_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node of each page, and each node's weight in the decision (from its own text)."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(base[:-1], sizes)
    n = base[-1]
    tag = np.concatenate([p.tag for p in pages])
    parent = np.concatenate([p.parent for p in pages]) + shift
    top = base[:-1]
    parent[top] = top
    depth = np.concatenate([p.depth for p in pages])
    end = np.concatenate([p.end for p in pages]) + shift
    words = np.concatenate([p.words for p in pages])
    own = np.zeros((n, 4))
    runs = [(base[k] + v, len(s), s.count(" "), s.count(",") + s.count(".")) for k, p in enumerate(pages) for v, _, s in p.runs
            if not s.isspace()]
    if runs:
        run = np.array(runs)
        for c in range(3):
            own[:, c] = np.bincount(run[:, 0], run[:, c + 1], n)
        own[:, 3] = np.bincount(run[:, 0], minlength=n)
    at = np.arange(n)

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[at]

    # Bits that hold for a node or one above it.
    word_bits, tag_bits = words.copy(), np.where(tag >= 0, 1 << np.maximum(tag, 0), 0)
    for level in range(1, int(depth.max()) + 1):
        v = np.flatnonzero(depth == level)
        word_bits[v] |= word_bits[parent[v]]
        tag_bits[v] |= tag_bits[parent[v]]
    chars, spaces, marks, parts = (below(own[:, c]) for c in range(4))
    linked = below(own[:, 0] * ((tag_bits >> 11) & 1))
    nodes = end - at
    paragraphs, headings, links = (below((tag == k).astype(float)) for k in (6, 7, 11))
    page_chars = np.repeat(chars[top], sizes) + 1
    before = np.concatenate([[0], np.cumsum(own[:, 0])])[:-1]
    before = before - np.repeat(before[top], sizes)
    children = np.bincount(parent, minlength=n) - np.isin(at, top)
    order = np.lexsort((at, parent))
    place = np.empty(n, dtype=np.int64)
    first = np.searchsorted(parent[order], parent[order], side="left")
    place[order] = np.arange(n) - first
    some = chars + 1
    sibling_links = (linked[parent] - linked) / (chars[parent] - chars + 1)
    columns = [
        np.log1p(chars), np.log1p(spaces), marks / some, linked / some, 100 * nodes / some, np.log1p(paragraphs),
        np.log1p(headings), np.log1p(links), parts, chars / (parts + 1), own[:, 0] / some, np.log1p(own[:, 0]),
        chars / page_chars, before / page_chars, (before + chars) / page_chars, depth,
        depth / np.repeat(np.maximum.reduceat(depth, top), sizes).clip(1), np.log1p(children), np.log1p(children[parent]),
        place, place / children[parent].clip(1), chars / (chars[parent] + 1), sibling_links, np.log1p(nodes),
        *[(tag == k).astype(float) for k in range(len(TAG_GROUPS))],
        *[((words >> k) & 1).astype(float) for k in range(len(WORD_GROUPS))],
        *[((word_bits >> k) & 1).astype(float) for k in range(len(WORD_GROUPS))],
        *[((tag_bits >> k) & 1).astype(float) for k in range(6)],
    ]
    return np.column_stack(columns), 0.3 + np.log1p(own[:, 0])


def decide(page: Page, keep: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """Is each node's own text kept? ``keep`` and ``drop`` are weighted log likelihoods of the nodes.

    A subtree is kept whole, dropped whole, or mixed: then its root counts by itself and its children are decided one by
    one, at a price. The likeliest assignment of the whole tree is taken, from the leaves up, so a node
    never contradicts the choice made for a subtree that holds it.
    """
    n = len(page.tag)
    kept, dropped = np.concatenate([[0], np.cumsum(keep)]), np.concatenate([[0], np.cumsum(drop)])
    end = np.array(page.end)
    all_kept, all_dropped = (kept[end] - kept[:-1]).tolist(), (dropped[end] - dropped[:-1]).tolist()
    own = np.maximum(keep, drop).tolist()
    best, state, mixed = [0.0] * n, [0] * n, [0.0] * n
    for v in range(n - 1, -1, -1):
        value, choice = max((all_dropped[v], 0), (all_kept[v], 1), (mixed[v] + own[v] - MIXED_PRICE, 2))
        best[v], state[v] = value, choice
        if v:
            mixed[page.parent[v]] += value
    out = np.zeros(n, dtype=bool)
    for v in range(n):
        if v and state[page.parent[v]] != 2:
            state[v] = state[page.parent[v]]
        out[v] = keep[v] >= drop[v] if state[v] == 2 else state[v] == 1
    return out


#: Log likelihood that a mixed subtree costs.
MIXED_PRICE = 1.0


def page_text(page: Page, kept: np.ndarray) -> str:
    """The kept runs, block by block: references decoded, white space inside a block made one space, ends trimmed."""
    blocks: list[str] = []
    current, parts = None, []
    for v, block, text in [*page.runs, (0, -1, "")]:
        if block != current:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                blocks.append(line)
            current, parts = block, []
        if block >= 0 and kept[v]:
            parts.append(text)
    return "\n\n".join(blocks)


def extract_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    if not sources:
        return []
    pages = [Page(s) for s in sources]
    x, weight = node_features(pages)
    p = np.clip(model.predict(x), 1e-4, 1 - 1e-4)
    keep, drop = weight * np.log(p), weight * np.log(1 - p)
    out, at = [], 0
    for page in pages:
        to = at + len(page.tag)
        out.append(page_text(page, decide(page, keep[at:to], drop[at:to])))
        at = to
    return out


# --- Training pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "ba de ki lo mu na pe ri so tu va we xi yo za ther ing tion al ent".split()


def _prose(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(least, most))]
    for i in range(0, len(words), r.randint(5, 14)):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += r.choice([".", ".", ",", "?"])
    return " ".join(words) + r.choice([".", ".", "", "!"])


def _links(r: random.Random, count: int) -> str:
    items = [f'<a href="/{i}">{_prose(r, 1, 5)}</a>' for i in range(count)]
    return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " ".join(items),
                     lambda: "".join(f"<div>{x}</div>" for x in items)])()


def training_page(r: random.Random) -> tuple[str, str]:
    """A made-up page with the usual parts in varying mark-up, and its main text's marker: main parts hold ``data-main``,
    other parts inside them ``data-other``."""
    def named(tags: str, words: str, body: str, more: str = "") -> str:
        tag = r.choice(tags.split())
        name = r.choice(words.split())
        key = r.choice(["class", "class", "id"])
        bare = tag not in ("div", "section") and r.random() < 0.5
        return f"<{tag}{more}" + ("" if bare else f' {key}="{name}"') + f">{body}</{tag}>"

    def other(inside: bool = False) -> str:
        mark = " data-other" if inside else ""
        return r.choice([
            lambda: named("div div aside section", "ad ads advert banner promo sponsored ad-slot", _prose(r, 4, 30), mark),
            lambda: named("div section aside", "share social related newsletter-signup", _links(r, r.randint(2, 6)), mark),
            lambda: named("div div p", "notice cookie-notice alert disclaimer", f"<p>{_prose(r, 5, 40)}</p>" if r.random() < .5 else _prose(r, 5, 40), mark),
            lambda: named("form", "subscribe search login", f"<label>{_prose(r, 1, 6)}</label><input><button>go</button> {_prose(r, 0, 8)}", mark),
        ])()

    def comments(mark: str = "") -> str:
        one = [named("div li article section", "comment reply comment-body", f"<p>{_prose(r, 3, 70)}</p>") for _ in range(r.randint(1, 6))]
        return named("section div aside", "comments comment-list discussion reader-comments", f"<h3>{_prose(r, 1, 3)}</h3>" * (r.random() < .6) + "".join(one), mark)

    blocks = [f"<h1>{_prose(r, 2, 12)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
        blocks.append(r.choice([
            *[lambda: f"<p>{_prose(r, 1, 160)}</p>"] * 6, lambda: f"<p><b>{_prose(r, 3, 60)}<br><p>{_prose(r, 5, 60)}</p>",
            lambda: f"<h2>{_prose(r, 1, 9)}</h2>", lambda: f"<blockquote>{_prose(r, 5, 60)}</blockquote>",
            lambda: "<ul>" + "".join(f"<li>{_prose(r, 1, 20)}</li>" for _ in range(r.randint(2, 7))) + "</ul>",
            lambda: f'<p>{_prose(r, 5, 60)} <a href="/x">{_prose(r, 1, 6)}</a> {_prose(r, 3, 40)}</p>',
            lambda: f"{_prose(r, 4, 60)}<br><br>", lambda: f"<table><tr><td>{_prose(r, 1, 9)}</td><td>{_prose(r, 1, 9)}</td></tr></table>",
            lambda: f"<div>{_prose(r, 10, 90)}</div>"])())
        if r.random() < 0.12:
            blocks.append(other(True))
    if r.random() < 0.12:
        blocks.append(comments(" data-other"))
    body = "".join(blocks)
    main = named("article article article main div section", "content article post entry-content story-body main-text text", body, " data-main")
    around = [named("div main section", "wrapper page container layout content", main)] if r.random() < 0.3 else [main]
    if r.random() < 0.85:
        around.insert(0, named("nav nav ul div header", "nav menu navbar main-menu breadcrumb", _links(r, r.randint(2, 12))))
    if r.random() < 0.4:
        around.insert(0, named("header div", "header masthead topbar", f"<h1>{_prose(r, 1, 5)}</h1>" * (r.random() < .5) + _prose(r, 1, 15)))
    for _ in range(r.choice([0, 1, 1, 2])):
        around.insert(r.randint(0, len(around)), other())
    if r.random() < 0.35:
        around.append(comments())
    if r.random() < 0.4:
        around.insert(r.randint(0, len(around)), named("aside aside div", "sidebar aside rail widget", f"<h3>{_prose(r, 1, 4)}</h3>{_links(r, r.randint(2, 8))}<p>{_prose(r, 3, 30)}</p>"))
    if r.random() < 0.9:
        around.append(named("footer footer div", "footer site-footer copyright", r.choice(["&copy; ", "", ""]) + r.choice(
            [lambda: _prose(r, 2, 40), lambda: _links(r, 5), lambda: f"<p>{_prose(r, 2, 25)}</p>{_links(r, 3)}"])()))
    return ("<!DOCTYPE html><html><head><title>" + _prose(r, 1, 9) + "</title></head><body>" + "".join(around)
            + r.choice(["</body></html>", ""]))


def node_labels(source: str) -> np.ndarray:
    """For a training page: does each node lie in a main part, and in no other part inside it?"""
    page = Page(source)
    opened = [m for m in _TOKEN.finditer(source) if (m[2] or m[5]) and not (m[1] or m[4])]
    marks = [m[3] or m[6] or "" for m in opened]
    if len(marks) != len(page.tag) - 1:
        raise ValueError("a training page must not hold tags inside raw text")
    out = np.zeros(len(page.tag), dtype=bool)
    for v, mark in enumerate(marks, 1):
        out[v] = "data-main" in mark or (out[page.parent[v]] and "data-other" not in mark)
    return out


@lru_cache(maxsize=2)
def page_model(n_pages: int = 1000, seed: int = 7) -> BoostedTrees:
    """Boosted trees over the nodes of ``n_pages`` made-up pages, the same for the same numbers."""
    r = random.Random(seed)
    sources = [training_page(r) for _ in range(n_pages)]
    x, weight = node_features([Page(s) for s in sources])
    y = np.concatenate([node_labels(s) for s in sources]).astype(np.float64)
    return BoostedTrees.fit(x, y, weight)


def extract_main_text(pages: DataFrame, html: str = "html", model: BoostedTrees | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points; columns of these names are replaced.

    A null page, and one without main text, has an empty text. Pages are read whole. References are decoded once,
    white space (also no-break spaces) inside a block becomes one space, and blocks are joined by two line breaks.
    """
    trees = model or page_model()

    @F.arrow_udf("string")
    def text(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            out: list[str] = []
            for piece in pieces(iter([pa.record_batch({"html": array})]), "html", 1 << 20):
                out += extract_texts([s or "" for s in piece["html"].to_pylist()], trees)
            yield pa.array(out, type=pa.string())

    found = pages.select(row_column(pages).alias("row"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html")).select(
        "row", text("html").alias("text"))
    return found.select(*with_new_columns(pages.columns, "row", text=F.col("text"),
                                          n_chars=F.char_length("text").cast("long")))
