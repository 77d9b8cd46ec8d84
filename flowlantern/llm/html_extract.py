"""Main text of web pages, by text-to-tag ratio.

The events of the standard library's parser are turned, while they come, into *lines*: the text between two borders of blocks, with
the number of tags met since the line before and the characters that lie in links. Scripts, styles, forms, menus, notices and the like are
recognised by element, role, visibility and the words of class and id, and take no part. The ratios (characters outside links to a tag, on a
log scale) of the other lines are smoothed by a Gaussian, and two-means clustering sets the threshold above which a line is content. The content
lines choose the region: the ``article`` or ``main`` element that holds most of them, else the smallest block that holds most of them, else the
clusters themselves. Of the region every line that is not boilerplate is kept whole, however short.

Null and empty pages give an empty text. A page of any length is one row of one task, read once; nothing is shuffled.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup option p pre search section select summary"
    " table tbody td template textarea tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# never shown as text of a page, or controls
SILENT = frozenset(
    "script style noscript template iframe object svg canvas audio video map head title textarea select option optgroup datalist button"
    " noframes applet".split())
ASIDE = frozenset("nav aside footer dialog menu search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar tablist tooltip status".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
TRACKED = BLOCKS | SILENT
CLOSES = {  # an element that starts ends an open one of these, up to the nearest of the borders
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
OPTIONAL_END = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup html body head".split())
# words of class or id
READERS = frozenset("comment comments commentlist commentlists disqus respond replies reply discussion feedback".split())
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion banner banners sidebar"
    " sidebars menu menus submenu nav navs navbar navigation subnav breadcrumb breadcrumbs footer foot footnav cookie cookies consent gdpr notice notices alert"
    " alerts warning popup popups modal overlay lightbox newsletter subscribe subscription signup share sharing sharer social related recommended recommendations recommend"
    " widget widgets pagination pager paging masthead copyright login search searchbox toolbar topbar skip skiplink toc teaser teasers tagcloud"
    " byline outbrain taboola disclaimer".split())
HEADERS = frozenset("header topheader siteheader pageheader".split())
# such a word in a compound turns its sense: with-sidebar, no-ads, comments-open
TURNS = frozenset("with has have no not without free open closed enabled disabled".split())
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SOFT, HEADER, FIRM = 1, 2, 3
_names: dict[str, int] = {}


def name_flag(name: str) -> int:
    """What the words of a class or id say: 0, SOFT, HEADER or FIRM (readers' comments)."""
    found = _names.get(name)
    if found is None:
        found = 0
        for one in name.split():
            words = {w.lower() for w in _WORD.findall(one)} | {one.lower()}
            if words & TURNS:
                continue
            found = max(found, FIRM if words & READERS else SOFT if words & BOILER else HEADER if words & HEADERS else 0)
        if len(_names) < 100_000:
            _names[name] = found
    return found


class Page(HTMLParser):
    """Lines and blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.own, self.core, self.closed = [-1], [""], [0], [False], [True]
        self.open = [0]
        self.pieces: list[str] = []
        self.tags = self.links = self.link = 0
        self.lines: list[tuple[int, str, int, int]] = []  # block, text, characters in links, tags

    def parse_marked_section(self, i, report=1):  # also with keywords that the base class refuses
        return self.parse_bogus_comment(i)

    def border(self):
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append((self.open[-1], text, self.links, self.tags))
                self.tags = 0
            self.pieces, self.links = [], 0

    def pop_to(self, depth: int):
        """Ends the blocks above ``depth`` of the open ones; the lowest of them ends by its own tag, the others by force."""
        for k, e in enumerate(self.open[depth:]):
            self.closed[e] = k == 0 or self.tag[e] in OPTIONAL_END
        del self.open[depth:]

    def find(self, tags, stop=frozenset()) -> int:
        for d in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[d]]
            if t in tags:
                return d
            if t in stop:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            elif tag == "hr":
                self.border()
            return
        if tag == "a":
            self.link += 1
        if tag not in TRACKED and not attrs:
            return
        inline = tag not in TRACKED
        if inline:
            flag = self.flag(tag, attrs)[0]
            if not flag:
                return
        self.border()
        if tag not in IN_HEAD:
            d = self.find(("head",))
            if d:
                self.pop_to(d)
        if tag in CLOSES:
            d = self.find(*CLOSES[tag])
            while d:
                self.pop_to(d)
                d = self.find(*CLOSES[tag])
        elif tag in BLOCKS and tag not in SILENT:
            d = self.find(("p", "title"), BLOCKS - {"p", "title"} - HEADINGS)
            if d:
                self.pop_to(d)
        own, core = self.flag(tag, attrs)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.own.append(own)
        self.core.append(core)
        self.closed.append(False)
        self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.link = max(0, self.link - 1)
        top = self.open[-1]
        if tag not in TRACKED and self.tag[top] != tag:
            d = self.find((tag,), BLOCKS)
            if not d:
                return
        else:
            d = self.find((tag,))
        self.border()
        if d:
            self.pop_to(d)

    def handle_data(self, data):
        if self.tag[self.open[-1]] in ("script", "style"):
            return
        self.pieces.append(data)
        if self.link:
            self.links += len(data.strip())

    @staticmethod
    def flag(tag: str, attrs) -> tuple[int, bool]:
        at = {k: v or "" for k, v in attrs} if attrs else {}
        role = at.get("role", "").lower()
        core = tag in ("article", "main") or role in ("main", "article") or at.get("itemprop", "").lower() == "articlebody"
        if tag in SILENT or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
            return FIRM, core
        if tag in ("html", "body", "main") or role == "main":
            return 0, core
        own = 0
        if tag in ASIDE or role in ROLES:
            own = FIRM
        elif tag == "form":
            own = SOFT
        elif tag == "header":
            own = HEADER
        if "class" in at or "id" in at:
            names = name_flag(at.get("class", "")), name_flag(at.get("id", ""))
            said = FIRM if FIRM in names else SOFT if SOFT in names else max(names)
            if core and said != FIRM:
                said = 0 if tag == "article" and not set(at.get("class", "").lower().split()) & BOILER else said
            own = FIRM if FIRM in (own, said) else own or said
        return own, core


def smoothed(values: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and scaled."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    pad = np.convolve(values, kernel)[radius:radius + len(values)]
    return pad / np.convolve(np.ones(len(values)), kernel)[radius:radius + len(values)]


def threshold(values: np.ndarray) -> float:
    """Border between the two clusters of two-means; below all values if there are not two."""
    lo, hi = float(values.min()), float(values.max())
    while True:
        cut = (lo + hi) / 2
        upper = values > cut
        if upper.all() or not upper.any():
            return -1.0
        a, b = float(values[~upper].mean()), float(values[upper].mean())
        if (a, b) == (lo, hi):
            return cut if b >= 2 * a else -1.0
        lo, hi = a, b


MOST = 0.6  # a block stands for the page if it holds this share of the content


def main_text(html: str) -> str:
    """The main text of one page."""
    page = Page()
    page.feed(html)
    page.close()
    page.border()
    return _selected(page)


def _selected(page: Page) -> str:
    parent, own, core, tag = page.parent, page.own, page.core, page.tag
    lines = page.lines
    if not lines:
        return ""
    n = len(parent)
    size = [0] * n  # characters outside links
    for e, text, links, _ in lines:
        size[e] += max(0, len(text) - links)
    for e in range(n - 1, 0, -1):
        size[parent[e]] += size[e]

    # a block that was never closed, or a wrapper named like boilerplate, does not take the article with it
    loose = [e for e in range(1, n) if own[e] and (not page.closed[e] or own[e] != FIRM) and tag[e] not in ("script", "style")]
    if loose:
        held = [False] * n
        plain = [0] * n
        for e, text, links, _ in lines:
            at, up = e, False
            while at > 0:
                up = up or bool(own[at])
                at = parent[at]
            if not up:
                plain[0] += max(0, len(text) - links)
        for e in range(1, n):
            if core[e] and not own[e] and size[e] > plain[0]:
                at = parent[e]
                while at > 0:
                    held[at] = True
                    at = parent[at]
        for e in loose:
            if held[e] or (plain[0] == 0 and own[e] == SOFT and tag[e] in ("div", "section", "form", "table")):
                own[e] = 0

    state = [0] * n  # strongest flag on the way up; a header inside an article is only HEADER
    inside = [False] * n
    for e in range(1, n):
        p = parent[e]
        inside[e] = core[e] or inside[p]
        flag = own[e]
        if flag == HEADER and not inside[p]:
            flag = FIRM
        state[e] = FIRM if FIRM in (flag, state[p]) or SOFT in (flag, state[p]) else max(flag, state[p])

    heading = [False] * n
    for e in range(1, n):
        heading[e] = tag[e] in HEADINGS or (heading[parent[e]] and tag[e] != "div")
    live = [k for k, (e, *_) in enumerate(lines) if not state[e] or (state[e] == HEADER and heading[e])]
    if not live:
        return ""
    at = [lines[k][0] for k in live]
    own_chars = np.array([max(0, len(lines[k][1]) - lines[k][2]) for k in live], float)
    ratio = smoothed(np.log1p(own_chars / np.maximum(1, [lines[k][3] for k in live])))
    linked = [lines[k][2] * 2 > len(lines[k][1]) for k in live]
    content = (ratio > threshold(ratio)) & (own_chars > 0) & ~np.array(linked)
    texts = [lines[k][1] for k in live]
    if not content.any():
        return ""

    weight = [0.0] * n
    for e, c, s in zip(at, content, own_chars):
        if c:
            weight[e] += s
    for e in range(n - 1, 0, -1):
        weight[parent[e]] += weight[e]
    region = _core(parent, core, state, weight)
    menus = not region
    region = region or _block(parent, tag, weight)
    if region:
        chosen, outer = region
        within = [False] * n
        for e in range(1, n):
            within[e] = e in chosen or within[parent[e]]
        first = min(chosen)
        title = [False] * n
        for e in range(1, first):
            p = e
            while p > 0 and p != outer:
                p = parent[p]
            title[e] = outer > 0 and p == outer and tag[e] == "h1"
        # outside an article, lines that are mostly links are a menu
        drop = [menus and x and not c for x, c in zip(linked, content)]
        return " ".join(t for e, t, d in zip(at, texts, drop) if not d and (within[e] or title[e]))
    # no block stands out: the clusters, with the headings before them and single lines between them that are no links
    keep = content.copy()
    m = len(texts)
    for i in range(m):
        if not content[i] and not linked[i]:
            near = content[max(0, i - 2):i].any() and content[i + 1:i + 3].any()
            keep[i] = near or (heading[at[i]] and content[i + 1:i + 2].any())
    return " ".join(t for t, k in zip(texts, keep) if k)


def _core(parent, core, state, weight):
    """The article (or several beside it of like size) with most content, and the ``main`` around it."""
    found = [e for e in range(1, len(parent)) if core[e] and not state[e] and weight[e] > 0]
    if not found:
        return None
    best = max(found, key=lambda e: (weight[e], -e))
    if weight[best] * 2 < weight[0]:
        return None
    outer = best
    while True:
        below = [e for e in found if e > best and _is_below(parent, e, best) and weight[e] >= MOST * weight[best]]
        if not below:
            break
        best = max(below, key=lambda e: (weight[e], -e))
    beside = {e for e in found if parent[e] == parent[best] and weight[e] * 2 >= weight[best]}
    return beside | {best}, outer if outer != best else 0


def _is_below(parent, e, top) -> bool:
    while e > top:
        e = parent[e]
    return e == top


def _block(parent, tag, weight):
    """The deepest block that holds most of the content, unless that is the whole page."""
    best = 0
    for e in range(1, len(parent)):
        if parent[e] == best and weight[e] >= 0.8 * weight[0] and tag[e] not in HEADINGS and tag[e] not in ("p", "li", "td", "pre"):
            best = e
    while best > 0 and tag[best] in ("tr", "tbody", "ul", "ol", "dl", "blockquote"):
        best = parent[best]
    return ({best}, 0) if best > 0 and tag[best] not in ("html", "body") else None


def extracted(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Adds the main text of column ``html`` and its length in code points, in place of columns of these names; the others pass through."""
    out = pages.drop(*[c for c in (text, n_chars) if c != html])
    schema = T.StructType([*out.schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches):
        for batch in batches:
            found = [main_text(v) if v else "" for v in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=[*batch.schema.names, text, n_chars])

    return out.mapInArrow(run, schema)
