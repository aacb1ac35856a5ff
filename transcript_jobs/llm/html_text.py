"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures.

A page is read in one pass into blocks with word count, link density, the zone that open elements put them in and
what names of class, id and role hint at; the tree is trained at the start on the small labelled table below, and
decides alone. Pages are independent: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import Aside, table, text_or_empty

# Elements that end a block.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that hold running text themselves.
PROSE_TAGS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption summary".split())
# Elements whose content is never text of a page.
SILENT = set("script style noscript template svg math iframe object canvas audio video textarea title datalist".split())
# Those that hold no elements and, without an end tag, reach to the end of the page.
RAW_TAGS = set("script style textarea title".split())
# Those that "/>" closes, and within which it closes anything.
FOREIGN_TAGS = set("svg math".split())
# Elements without content.
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words of class, id and role that mark what is not the article.
OUTER_TAGS = set("nav header footer menu head".split())
ASIDE_TAGS = set("aside form dialog button select option fieldset".split())
OUTER_WORDS = set(
    "nav navbar navigation navigations menu menus submenu header masthead topbar toolbar footer colophon contentinfo breadcrumb "
    "breadcrumbs pagination pager skip skiplink".split()
)
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsors sponsored "
    "promo promos promoted promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts "
    "disclaimer paywall newsletter subscribe subscription signup signin login register sidebar sidebars aside rail widget "
    "widgets complementary related recommended recommendations trending popular comment comments commentlist reply replies "
    "respond responses disqus discussion share sharing social popup modal overlay search searchbox form dialog".split()
)
MAIN_WORDS = set("article post entry content story main maincontent articlebody".split())
# Those of OUTER_WORDS that, beside one of MAIN_WORDS other than main, may name the head of the article (entry-header).
HEAD_WORDS = set("header masthead".split())
# Words that say nothing of what an element holds, beside one of the words above.
NEUTRAL_WORDS = set(
    "area bar block body bottom box button buttons col column container element footer form group head header holder icon icons "
    "inner inline item items left link links list listing module outer panel placeholder post posts region right row section site slot "
    "stories thread title top unit user wrap wrapper zone x y z".split()
)
# Parts of a name that tell what an element has around or within it, not what it is (has-sidebar, comments-open).
STATE_WORDS = set("has with no without open closed enabled disabled".split())
# Those of ASIDE_WORDS that, as part of a longer name, may name a layout (sidebar-left).
LAYOUT_WORDS = set("sidebar sidebars rail".split())

# A quotation mark opens a value only after "="; what is matched once is not tried again in another way.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in RAW_TAGS}
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PART = re.compile(r"[a-z]+")

#: NAMED is MAIN by a name alone: it counts as MAIN where it holds a NAMED_SHARE of the page's text, else as OPEN.
NOT_MAIN, OPEN, MAIN, NAMED = 0, 1, 2, 3
NAMED_SHARE = 0.2
#: What names tell of an element: nothing; perhaps that it is aside; that, but it may be a wrapper; that it is aside.
NONE, PERHAPS, LAYOUT, ASIDE = 0, 1, 2, 3


def _tokens(page: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, tag, attributes) of the marks of a page; a comment or silent element is one mark without a tag.

    A silent element without an end tag is only its start tag, unless it is of RAW_TAGS.
    """
    out: list[tuple[int, int, str, str, str]] = []
    inside: list[tuple[str, int]] = []  # open silent elements and where their marks begin in out
    depth = dict.fromkeys(SILENT, 0)
    at = 0
    while m := _TOKEN.search(page, at):
        start, at, tag = m.start(), m.end(), (m["tag"] or "").lower()
        if tag not in SILENT:
            out.append((start, at, m["close"] or "", tag, m["attrs"] or ""))
            continue
        if m["close"]:
            while depth[tag]:
                name, first = inside.pop()
                depth[name] -= 1
                if name == tag:
                    start = out[first][0]
                    del out[first:]
                    break
        elif m["attrs"].endswith("/") and (tag in FOREIGN_TAGS or any(depth[f] for f in FOREIGN_TAGS)):
            pass
        elif tag in RAW_TAGS:
            at = _RAW_END[tag].search(page, at).end()
        else:
            inside.append((tag, len(out)))
            depth[tag] += 1
        out.append((start, at, "", "", ""))
    return out


def _named(tag: str, token: str, is_id: bool, zone: int) -> int:
    """What one name says: ASIDE if it is made of marking words alone (and neutral ones and those of the article, where the element holds blocks), PERHAPS if one is among others."""
    parts = set(_PART.findall(_HUMP.sub(" ", token).lower()))
    marks = ASIDE_WORDS if zone >= MAIN else ASIDE_WORDS | OUTER_WORDS
    if not parts & marks or parts & STATE_WORDS:
        return NONE
    if tag in PROSE_TAGS:  # an id of a heading or paragraph is the name of its place
        return ASIDE if not is_id and parts <= marks else PERHAPS
    head = parts & marks <= HEAD_WORDS and parts & MAIN_WORDS - {"main"}
    if not parts <= marks | NEUTRAL_WORDS | MAIN_WORDS or head:
        return PERHAPS
    return LAYOUT if parts & marks <= LAYOUT_WORDS and len(parts) > 1 else ASIDE


def _zone(tag: str, attrs: str, zone: int, firm: bool, hint: int, lone: bool) -> tuple[int, bool, int]:
    """(zone, whether it is so for good, hint of names) within an element, from those around it.

    Elements decide the zone, names are a hint; a name with a word of MAIN_WORDS makes a zone NAMED, but not beside a marking word
    (main-nav). A main leads out of what names say of the elements around it, and
    a page's ``lone`` article out of what may be a layout.
    """
    names, own, claims = set(), NONE, False
    if tag not in ("html", "body") and attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return NOT_MAIN, True, hint
            if name in ("class", "id", "role"):
                for token in value.split():
                    parts = set(_PART.findall(_HUMP.sub(" ", token).lower()))
                    names |= parts
                    claims |= bool(parts & MAIN_WORDS) and not (parts & (ASIDE_WORDS | OUTER_WORDS) and not parts & STATE_WORDS)
                    if tag not in ("main", "article") or token.lower() in ASIDE_WORDS:
                        own = max(own, _named(tag, token, name == "id", zone))
    if firm or tag in ASIDE_TAGS:
        return NOT_MAIN, True, hint
    if tag == "main" or tag == "article" and (hint < LAYOUT or lone and hint == LAYOUT):
        return MAIN, False, NONE if tag == "main" or own < ASIDE or names & MAIN_WORDS else own
    if tag in ("footer", "nav", "menu") or tag in OUTER_TAGS and zone < MAIN:
        return NOT_MAIN, False, max(hint, own)
    if claims and own < LAYOUT and hint < LAYOUT and zone == OPEN:
        return NAMED, False, max(hint, own)
    return zone, False, max(hint, own)


class Block(NamedTuple):
    text: str
    linked: int
    zone: int
    hint: int
    prose: bool


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order: text, words of it within links, zone, hint of names, whether in a running-text element."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", OPEN, False, NONE)]
    depth: Counter[str] = Counter()  # open elements by name
    text: list[str] = []
    linked: list[str] = []
    prose, in_link, at = False, 0, 0

    def end() -> None:
        words = "".join(text).split()
        if words:
            _, zone, firm, hint = stack[-1]
            out.append(Block(" ".join(words), len("".join(linked).split()), NOT_MAIN if firm else zone, hint, prose))
        text.clear()
        linked.clear()

    def take(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            linked.append(piece if in_link else " ")

    def leave() -> None:
        depth[stack.pop()[0]] -= 1

    tokens = _tokens(page)
    starts = [tag for _, _, close, tag, _ in tokens if not close]
    lone = starts.count("article") == 1 and "main" not in starts
    for start, stop, close, tag, attrs in tokens:
        take(page[at:start])
        at = stop
        if not tag:
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in BLOCK_TAGS:
            end()
            prose = tag in PROSE_TAGS and not close
            in_link = 0
        if close:
            if tag == "a":
                in_link = 0
            if depth[tag]:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if tag not in BLOCK_TAGS and stack[i][1:] != stack[i - 1][1:]:
                    end()
                while len(stack) > i:
                    leave()
            continue
        if tag == "a":
            in_link = 1
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS:  # a paragraph or item ends where the next block begins
            while len(stack) > 1 and stack[-1][0] in ("p", "option") or tag == stack[-1][0] in ("li", "dt", "dd", "tr", "td", "th"):
                leave()
        new = _zone(tag, attrs, *stack[-1][1:], lone)
        if tag in BLOCK_TAGS or new != stack[-1][1:]:
            if tag not in BLOCK_TAGS:
                end()
            stack.append((tag, *new))
            depth[tag] += 1
    take(page[at:])
    end()
    return settled(out)


def settled(page: list[Block]) -> list[Block]:
    """NAMED blocks as MAIN ones, or as OPEN ones if others hold nearly all words of the page that aren't links or aside."""
    own = lambda b: max(0, b.text.count(" ") + 1 - b.linked) * (b.hint < LAYOUT)
    named, every = (sum(own(b) for b in page if b.zone in zones) for zones in ((NAMED,), (OPEN, MAIN, NAMED)))
    zone = MAIN if named >= NAMED_SHARE * every else OPEN
    return [b._replace(zone=zone) if b.zone == NAMED else b for b in page]


#: Levels of word counts and link densities: from so many on, the next.
WORD_LEVELS, LINK_LEVELS = (1, 6, 12, 24), (0.34, 0.67)
FEATURES = ["zone", "hint", "page_has_main", "prose", "words", "link_density", "words_before", "links_before", "words_after", "links_after"]

# The labelled table: blocks of pages in order, as a reader sees them; a line is a page. A block is the zone of its
# elements (o outside, n neither, m article), its names (- none, ? perhaps aside, ! aside), p for running-text elements (b others),
# its words, "/" and words of links among them, then "=" and 1 for the article's text, 0 for anything else.
LABELLED = """
o-b3=0 o-b1/1=0 o-b1/1=0 o-b2/2=0 m-p8=1 m-p3=1 m-p95/4=1 m-p60=1 m!b12=0 m-p4=1 m-p40/2=1 m-p72=1 m!p9/3=0 m!p30=0 m!p4=0 n-b7=0 o-b6/2=0
o-p1/1=0 o-p1/1=0 o-p2/2=0 o-p1/1=0 n!b9=0 m-p11=1 m-p120=1 m-p85/20=1 m-p2=1 m-p1=1 m-p1=1 m-p18=1 o-b9/1=0
n!b4/1=0 n-b3=0 n-p2/2=0 n-p2/2=0 n-p3/3=0 m-p6=1 m-p5/5=1 m-p140/9=1 m-p88=1 m-p7/7=0 m-p9/9=0 m-p8/8=0 n-p35=0 n-p50/4=0 n-b5/5=0
n-p7=1 n-p66=1 n-p3=1 n-p90/8=1 n-p24=1 n-b2/2=0 n-b3/3=0 n-b4/4=0 n-b9=0
n-b2=0 n-b1/1=0 n-b1/1=0 n-b3/3=0 n-b80=1 n-b45/5=1 n-b6=1 n-b110=1 n-b5/4=0 n-b2/2=0 n-b8/6=0
n-b4=0 n-p1/1=0 n-p2/2=0 n-b5=0 n-b18=1 n-b75/2=1 n-b3=1 n-b75=1 n!p60=0 n!p42=0 n!p5/1=0 n-b4=0
m-p5=1 m?p6=1 m?p88=1 m?p45/3=1 m-p70=1 m?p3=1 m?p55=1 m!p40=0 m!b25=0 o-p20=0 o-p70=0
n-p6=1 n?p5=1 n?p70=1 n?p35=1 n?b2/2=0 n?b3/3=0 n?b4=0 n-p48=1 n!b6=0 n!p64/2=0
n?b5=0 n?b2/2=0 n?b6/5=0 n-p9=1 n-p77=1 n?b90=1 n?b28/2=1 n-p3=1 n-p1=1
m-b2=1 m-b1=1 m-b1=1 m-b14=1 m-b1=1 m-b9=1 m-p33=1 m-b3/1=1 m-b70/6=1 m-b3/3=0 m-b2/2=0 m-b5/5=0 m-b4/4=0
o-b1/1=0 o-b80=0 o-p45/3=0 m-p9/9=1 m-p52=1 m-p4/4=1 m-p61=1 m-p12/12=1 m-p58=1 o-p90=0 n!p35=0 n-p12=0 n-b25=0
n!p8=0 n!p25/2=0 n-p30=1 n-p1=1 n-p2=1 n-p75=1 n-p5/5=0 n-p6/6=0 n-p4/4=0 n-b7/5=0 o-p40=0
m-p1=1 n-b6=0 n-p80=0 n-p20/1=0 n!p110=0 o-b3=0
n-p4=1
n-b11=1
n-b2/2=0 n-p3=1
m-p90/70=1 m-p85/30=1 m-p40=1 m-p2/2=0 m-p3/3=0 m-p2/2=0 m-p3/3=0 m-p60=1
n-p70/52=0 n-p66/8=1 n-p58=1 n-p4=1 n-b1=0 n-b40/30=0 n-b3/3=0
m-p25=1 m-p6=1 m-b3=1 m-b5=1 m?b8=1 m?b66=1 m?b2/2=0 m?b3/3=0 m?p4/4=0 m-p30=1 m!b3=0 m!b90=0 m!p2/2=0
n-b4=0 n-b3=0 n-b6=0 n-b2/2=0 n-p14=1 n-p22=1 n-p10=1 n-b5=0 n-b3=0 n-b2=0
o-b7/7=0 o-b6/6=0 o-b9/9=0 m-p95=1 m-p80=1 m-p6/6=1 m-p84=1 o-b30/20=0 o-b12/12=0 o-b60=0
n-b7/7=0 n-b8/8=0 n-b9/9=0 n-p95=1 n-p80=1 n-p3=1 n-b8/8=0 n!b70/60=0 n-p64=1 n!b9/9=0 n-p70=1
m-p7=1 m-p60=1 m-p80=1 m-p44=1 n-p80=0 n-p40=0 n-p100=0 n-b9=0 n-b50=0 n-p3=0
n-p60=0 n-p30/2=0 n-b6=0 m-b60=1 m-b50=1 m-b3=1 m-b70=1 m-b9=1 m-b2=1 n-b60=0 n-p90=0 n-p70/4=0 o-p90=0 o-b80=0
n-p90=0 m-p40=1 m-p2=1 m-p90=1 m-p3=1 m-p14=1 n-p50=0 n-p4=0 n-p45=0 n?p50=0 n?p66=0
o-p60=0 o-b80=0 n-p70=1 n-p30=1 n-p80=1 o-p20=0 o-p45/3=0 o-p3=0
n-p95=1 n-p80=1 o-p90=0 n-p64=1 o-p30=0 n-p30=1 o-b12=0 o-p4=0 n-p50=1
n-b90=1 n-b40=1 o-b70=0 o-p90=0 n-b66=1 o-b30=0 n-b80=1 o-p50=0 o-p5=0 o-b3=0
n-b60=1 n-b70=1 n-b4=1 n-b65=1 n-b2/2=0 n-b3/3=0 n?p2=1 n?p60=1 n?p7=1 n-p64=1
"""
_BLOCK = re.compile(r"([onm])([-?!])([pb])(\d+)(?:/(\d+))?=([01])")


def labelled() -> np.ndarray:
    """The rows of the labelled table: FEATURES, then the label."""
    rows = []
    for line in LABELLED.split("\n"):
        found = _BLOCK.findall(line)
        page = [Block("w " * (int(n) - 1) + "w", int(k or 0), "onm".index(z), (NONE, PERHAPS, ASIDE)["-?!".index(h)], p == "p") for z, h, p, n, k, _ in found]
        if page:
            rows.append(np.column_stack([features(page), [int(f[-1]) for f in found]]))
    return np.concatenate(rows)


class Tree:
    """A binary decision tree (Gini), as arrays. A leaf stands for LEAST_ROWS rows or more."""

    LEAST_ROWS = 3

    def __init__(self, rows: np.ndarray | None = None, depth: int = 8) -> None:
        rows = labelled() if rows is None else rows
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self.depth = depth
        self._grow(rows[:, :-1], rows[:, -1], depth)
        for k in ("feature", "threshold", "left", "right", "value"):
            setattr(self, k, np.array(getattr(self, k)))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        n, best = len(self.feature), (0.0, 0, np.inf)
        for store, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, n), (self.right, n), (self.value, float(y.mean()))):
            store.append(v)
        impurity = len(y) * y.mean() * (1 - y.mean())
        for j in range(x.shape[1]) if depth and impurity else ():
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, j] <= cut
                if min(low.sum(), (~low).sum()) < self.LEAST_ROWS:
                    continue
                left = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
                if impurity - left > best[0] + 1e-9:
                    best = (impurity - left, j, cut)
        if best[0]:
            self.feature[n], self.threshold[n] = best[1:]
            low = x[:, best[1]] <= best[2]
            self.left[n] = self._grow(x[low], y[low], depth - 1)
            self.right[n] = self._grow(x[~low], y[~low], depth - 1)
        return n

    def likely(self, x: np.ndarray) -> np.ndarray:
        """Whether each row is text of the article."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = np.where(x[np.arange(len(x)), self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[node] >= 0.5


def features(page: list[Block]) -> np.ndarray:
    """FEATURES of the blocks of one page: word counts and link densities in levels, as a small table tells no more."""
    words = np.array([b.text.count(" ") + 1 for b in page], float)
    links = np.minimum(1.0, np.array([b.linked for b in page]) / words)
    zone, hint = np.array([b.zone for b in page], float), np.array([b.hint for b in page], float)
    x = np.zeros((len(page), len(FEATURES)))
    x[:, 0], x[:, 1], x[:, 3] = zone, np.minimum(hint, LAYOUT), [b.prose for b in page]
    x[:, 2] = ((zone == MAIN) & (hint < LAYOUT)).any()
    words, links = np.digitize(words, WORD_LEVELS), np.digitize(links, LINK_LEVELS)
    x[:, 4], x[:, 5] = words, links
    x[1:, 6], x[1:, 7] = words[:-1], links[:-1]
    x[:-1, 8], x[:-1, 9] = words[1:], links[1:]
    return x


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.likely(features(found)), strict=True) if keep)


def extract(pages: DataFrame, page: str = "html", tree: Tree | None = None) -> DataFrame:
    """``pages`` without ``page``, with text (main text, empty if none) and n_chars.

    A null page counts as empty. Columns named text or n_chars, in upper or lower case, are replaced; each repeated
    row gets its own text.
    """
    tree, own = tree or Tree(), Aside(pages)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p, tree) for p in b], dtype="object")

    made = own.df.withColumn("_text", of(text_or_empty(own(page))))
    return made.select(*own.back(without=("text", "n_chars"), but=page), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: A page's structure is beyond SQL; the tests compare with pages that are put together from known text.
SQL = None
