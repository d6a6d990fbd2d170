"""HTML main-text extraction by composite text density.

A page becomes a tree of elements. Of every element the characters, tags, link characters and link tags below it
are counted, and its density is characters per tag, adjusted by how much of its text and tags are links. Inline markup is no element of
its own here: it is part of the block around it. The densities of an element's children are summed; the element of the page's body with
the greatest sum is the core, and the least density on its path to the body is the threshold. Every element at or over
the threshold gives the subtree with the greatest sum below it; in what is so chosen, blocks of links (three or more,
nearly all of the text) under the threshold go.

What the densities cannot tell is a feature of an element: parts that their element or their class, id or role call something else
than the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) have no text, so no density.
An element called ``article`` or ``main`` is found by its sums like any other.

Text: character references decoded, white space inside a block turned into one space, blocks trimmed and joined by one
space in page order. Nothing is cut off by length or depth; the tree is built without recursion.

Defined cases: a null or empty html, or one without text outside such parts, gives an empty text. Broken markup is read as
browsers do in the plain cases: unclosed paragraphs, list items and cells end where the next begins, stray end tags count
for nothing, an unclosed script runs to the end. Repeated rows get equal values.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body head html li dd dt option td th tr tbody thead tfoot title".split())
#: Inline markup, which counts as part of the block around it.
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may turn out to be menus inside an article.
LISTING = frozenset("ul ol dl div section table p".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that are never part of an article.
OTHER_ELEMENTS = RAW | frozenset("head nav footer aside form button select option menu dialog template svg math object embed applet canvas audio video label input datalist search".split())
#: Words in a class, id or role that name something else than the article.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar aside complementary contentinfo footer cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skip "
    "copyright disclaimer form search banner masthead topbar".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
HEADER_WORDS = frozenset(["header", "pageheader", "siteheader"])
_LISTS = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
_SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}


def _is_other(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is something else than article text; ``inside`` a main or article, headers belong to it."""
    if tag in OTHER_ELEMENTS or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    words: set[str] = set()
    for name, *values in _NAMED.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        else:
            words.update(w.lower() for w in _SPLIT.split(value))
    if words & COMMENT_WORDS:
        return True
    if tag in ("article", "main"):
        return False
    return bool(words & OTHER_WORDS) or not inside and bool(words & HEADER_WORDS)


class Page:
    """The elements of a page in page order (a parent comes before its children) and its text runs."""

    def __init__(self, html: str):
        self.tag, self.parent, self.other = ["#root"], [0], [False]
        self.runs: list[tuple[int, str]] = []  # element and text; element -1 is a border between blocks
        self._read(html)

    def _read(self, html: str) -> None:
        stack, held = [0], Counter()
        lower = None
        inside = 0  # open main and article elements

        def close(k: int) -> None:
            nonlocal inside
            while len(stack) > k:
                t = self.tag[stack.pop()]
                held[t] -= 1
                inside -= t in ("main", "article")

        def close_one_of(names: frozenset, border: frozenset) -> None:
            if any(held[n] for n in names):
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in names:
                        return close(k)
                    if t in border:
                        return None

        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.match(html, at)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if not m[0].startswith(("<!", "<?")):
                    self.runs.append((stack[-1], m[0]))
                continue
            tag, attrs = name.lower(), m[3] if m[2] else m[6]
            if m[1] or m[4]:
                if held[tag]:
                    close_one_of(frozenset([tag]), frozenset())
                if tag in BLOCK:
                    self.runs.append((-1, ""))
                continue
            if held["head"] and tag not in IN_HEAD:
                close_one_of(frozenset(["head"]), frozenset())
            if tag in ENDS_P and held["p"]:
                close_one_of(frozenset(["p"]), frozenset(["td", "th", "button"]))
            if tag in _SIBLINGS:
                close_one_of(_SIBLINGS[tag], _LISTS[tag])
            if tag in BLOCK or tag == "br":
                self.runs.append((-1, ""))
            above = stack[-1]
            me = len(self.tag)
            self.tag.append(tag)
            self.parent.append(above)
            self.other.append(self.other[above] or _is_other(tag, attrs, inside > 0))
            if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use", "g", "circle", "rect"):
                continue
            if tag in RAW:
                lower = lower if lower is not None else html.lower() if len(html.lower()) == len(html) else html
                stop = lower.find("</" + tag, at)
                at = end if stop < 0 else stop
                if stop >= 0:
                    at = html.find(">", stop) + 1 or end
                continue
            stack.append(me)
            held[tag] += 1
            inside += tag in ("main", "article")

    def text(self) -> str:
        keep = self._kept()
        blocks, piece = [], []
        for node, run in self.runs:
            if node < 0:
                if piece:
                    blocks.append(piece)
                    piece = []
            elif keep[node]:
                piece.append(entities.unescape(run) if "&" in run else run)
        blocks.append(piece)
        return " ".join(filter(None, (" ".join("".join(p).split()) for p in blocks)))

    def _kept(self) -> list[bool]:
        """For each element whether its own text belongs to the main text."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        link = [False] * n
        for k in range(1, n):
            link[k] = link[parent[k]] or tag[k] == "a"
        chars, link_chars = [0] * n, [0] * n
        for node, run in self.runs:
            if node >= 0 and not self.other[node]:
                size = len(" ".join(run.split()))
                chars[node] += size
                if link[node]:
                    link_chars[node] += size
        inline = [t in INLINE for t in tag]
        tags, link_tags = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if not self.other[k]:
                up = parent[k]
                chars[up] += chars[k]
                link_chars[up] += link_chars[k]
                tags[up] += tags[k] + (not inline[k])
                link_tags[up] += link_tags[k] + (tag[k] == "a")
        root = next((k for k, t in enumerate(tag) if t == "body" and not self.other[k]), 0)
        density = _densities(chars, link_chars, tags, link_tags, root)
        total = [0.0] * n
        for k in range(n - 1, 0, -1):
            if not self.other[k]:
                total[parent[k]] += total[k] if inline[k] else density[k]
        below = [False] * n  # in the body
        below[root] = True
        for k in range(root + 1, n):
            below[k] = below[parent[k]] and not self.other[k]
        core = max((k for k in range(root, n) if below[k] and not inline[k]), key=lambda k: (total[k], -k))
        threshold, k = density[core], core
        while k != root:
            k = parent[k]
            if not inline[k]:
                threshold = min(threshold, density[k])
        best = list(range(n))  # the element of the greatest sum at or below each
        for k in range(n - 1, root, -1):
            up = parent[k]
            if below[k] and (inline[best[up]] or not inline[best[k]] and total[best[k]] > total[best[up]]):
                best[up] = best[k]
        chosen = [False] * n
        for k in range(root, n):
            if below[k] and not inline[k] and density[k] >= threshold and chars[k]:
                chosen[best[k]] = True
        kept = [False] * n
        for k in range(root, n):
            if below[k]:
                menu = tag[k] in LISTING and link_tags[k] >= 3 and link_chars[k] >= 0.8 * chars[k] and density[k] < threshold
                kept[k] = chosen[k] or k != root and kept[parent[k]] and not menu
        return kept


def _densities(chars, link_chars, tags, link_tags, root: int) -> list[float]:
    """Characters per tag, adjusted by links: their share here against their share in the whole."""
    c, lc = np.array(chars, float), np.array(link_chars, float)
    t, lt = np.maximum(np.array(tags, float), 1), np.maximum(np.array(link_tags, float), 1)
    plain = np.maximum(c - lc, 1)
    base = np.log(c / plain * lc + lc[root] / max(c[root], 1) * c + math.e)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.log(np.maximum(c / np.maximum(lc, 1) * t / lt, 1)) / np.log(np.maximum(base, 1 + 1e-9))
    return np.where(c > 0, c / t * np.where(np.isfinite(weight), weight, 0), 0.0).tolist()


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""

    def run(ids, urls, htmls):
        texts = [main_text(h) for h in htmls]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
