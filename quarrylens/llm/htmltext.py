"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a sequence of text blocks, each with its place in the DOM. A
linear classifier on tags, class and id words, link density and length gives
each block a log-odds of being content (a boilerplate word on an ancestor yields
to a nearer article, main or content word, unless it names foreign text such as
comments); its costs are the capacities to the two
terminals. Neighbours in page order and blocks under one parent are tied by
smoothness edges. The minimum cut of this graph is the cheapest labelling; the
blocks on the content side are the text.

A block whose own cost outweighs all its ties keeps its label in every minimum
cut, so such blocks are merged with the terminals first and max-flow runs over
what is left. Pages are independent and bounded by themselves: one vectorized
function, no shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML element groups (WHATWG HTML).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title noscript template svg math canvas object iframe audio video map datalist".split())
OFF_TAGS = frozenset("nav footer aside form menu button select option dialog fieldset legend textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul body".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies copyright disclaimer discussion disqus dropdown feedback foot footer form gdpr header hero login masthead"
    " menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted"
    " promotion recommended related replies reply respond rss search share sharing shoutbox sidebar signin signup skip social"
    " sponsor sponsored subscribe subscription tagcloud teaser toc toolbar tools widget widgets".split()
)
# Of these, names of what isn't the page's own text, wherever it stands: no content word inside overrules them.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments commentlist consent cookie cookies copyright"
    " disclaimer discussion disqus gdpr newsletter pagination popup promo promoted promotion recommended related replies reply"
    " respond shoutbox signin signup sponsor sponsored subscribe subscription tagcloud".split()
)
#: First words of a class that tell about its element's neighbours or state (has-sidebar).
STATES = frozenset("has have no not with without is show shows hide".split())
ON_WORDS = frozenset("article articlebody body content entry main maincontent page post prose story text".split())
# Weights of the classifier.
BIAS, IN_ARTICLE, OUT_OF_ARTICLE, OFF, ON, HEADING, LINKS, LENGTH, MARKS = 1.3, 6.0, -7.0, -14.0, 2.0, 1.0, -5.0, 1.2, 0.8
#: Part of OFF where a boilerplate word stands against a content word: long text without links outweighs it.
DOUBT = 0.1
#: How surely an element is boilerplate: by a tag or as hidden, by a foreign word, by another word, in doubt.
HARD, FOREIGN, SOFT, DOUBTFUL, CLEAR = 4, 3, 2, 1, 0
ADJACENT, SIBLING = 0.5, 0.7

_TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)"
    r"|<(script|style|xmp|noframes|noembed)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # quotes count where a value begins; any other is a character like others
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>])*+)>"
    r"|<[!?/][^>]*>"
    r"|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NAMES = frozenset("class id role itemprop aria-label".split())
_INVISIBLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "links", "off", "on", "inside", "tag", "parent")

    def __init__(self, text: str, links: int, place: tuple, tag: str) -> None:
        self.text, self.links, self.tag = text, links, tag
        self.off, self.on, self.inside, self.parent = place


@lru_cache(maxsize=4096)
def _said(attrs: str) -> tuple[int, bool]:
    """What an element's attributes say: how surely it is boilerplate, and whether it is content."""
    off, on, words = CLEAR, False, False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if (
            (name == "hidden" and value.lower() != "false")
            or (name == "style" and _INVISIBLE.search(value))
            or (name == "aria-hidden" and value.strip().lower() == "true")
        ):
            return HARD, False
        for part in value.split() if name in _NAMES else ():
            if name == "class" and part.lower() == "hidden":
                off = max(off, SOFT)
            names = [w.lower() for w in _WORD.findall(part)]
            on = on or not ON_WORDS.isdisjoint(names)
            if names and names[0] in STATES:
                continue
            words = words or not OFF_WORDS.isdisjoint(names)
            off = max(off, FOREIGN if not FOREIGN_WORDS.isdisjoint(names) else SOFT if words else CLEAR)
    return (DOUBTFUL if off == SOFT and words and on else off), on


def _traits(tag: str, attrs: str, off: int, on: bool, inside: bool) -> tuple[int, bool, bool]:
    says, says_on = _said(attrs) if attrs and tag not in ("body", "html") and ("=" in attrs or "hidden" in attrs) else (CLEAR, False)
    if tag in OFF_TAGS or (tag == "header" and not inside):
        # a form around a whole page is as weak as a word
        says = max(says, SOFT if tag == "form" else HARD)
    if tag in ("article", "main"):
        inside = True
        if says < SOFT and off <= SOFT:
            off = CLEAR
    elif says_on and says == CLEAR and off == SOFT:
        off = DOUBTFUL
    return max(off, says), on or says_on, inside


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with what their ancestors say about them."""
    out: list[Block] = []
    # (tag, off, on, inside, number)
    stack: list[tuple] = [("", CLEAR, False, False, 0)]
    text: list[str] = []
    links = silent = in_link = number = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                near = next((x for x in reversed(stack) if x[0] not in INLINE), stack[0])
                up = next((x for x in reversed(stack) if x[0] not in INLINE and x is not near), stack[0])
                out.append(Block(joined, links, (*near[1:4], up[4]), near[0]))
            text.clear()
        links = 0

    def pop_to(at: int) -> None:
        nonlocal silent, in_link
        for x in stack[at:]:
            silent -= x[0] in SILENT
            in_link -= x[0] == "a"
        del stack[at:]

    for m in _TOKEN.finditer(page):
        if m[5] is not None:
            if not silent:
                raw = m[5]
                raw = entities.unescape(raw) if "&" in raw else raw
                text.append(raw)
                if in_link:
                    links += len(raw)
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "br":
            text.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m[2]:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == tag:
                    pop_to(at)
                    break
                if inline and stack[at][0] not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == "p" or (tag == stack[at][0] and tag in ("li", "dd", "dt", "tr", "td", "option")):
                    pop_to(at)
                    break
                if stack[at][0] not in INLINE:
                    break
        if tag == "body":
            for at in range(1, len(stack)):
                if stack[at][0] == "head":
                    pop_to(at)
                    break
        if tag in VOID:
            continue
        number += 1
        stack.append((tag, *_traits(tag, m[4], *stack[-1][1:4]), number))
        silent += tag in SILENT
        in_link += tag == "a"
    flush()
    return out


def log_odds(b: Block, has_article: bool, doubted: int = DOUBTFUL) -> float:
    """Of being content. What is surely boilerplate up to `doubted` is in doubt."""
    off = float(b.off > CLEAR) if b.off > doubted else DOUBT * (b.off > CLEAR)
    z = BIAS + OFF * off + ON * (b.on and off < 1) + HEADING * (b.tag in HEADINGS)
    if has_article:
        z += IN_ARTICLE if b.inside else OUT_OF_ARTICLE
    z += LINKS * min(1.0, b.links / len(b.text))
    z += LENGTH * min(3.0, math.log1p(len(b.text) / 40)) - LENGTH
    return z + MARKS * (b.text[-1] in ".!?\"'»”:;")


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node lies on the source side of a minimum cut, where node i
    is tied to the source by max(odds, 0), to the sink by max(-odds, 0), and to
    others by `edges`. Undecided nodes that cost the same go to the sink."""
    n = len(odds)
    ties: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        ties[a][b] = ties[a].get(b, 0.0) + w
        ties[b][a] = ties[b].get(a, 0.0) + w
    own, label = list(odds), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(own[i]) > sum(ties[i].values()):
            label[i] = own[i] > 0
            for j, w in ties[i].items():
                del ties[j][i]
                own[j] += w if label[i] else -w
                queue.append(j)
            ties[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        s, t = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(ties[i]) for i in free}
        flow[s], flow[t] = {}, {}
        for i in free:
            a, b = (s, i) if own[i] > 0 else (i, t)
            flow[a][b] = abs(own[i])
            flow[b].setdefault(a, 0.0)
        while True:
            back, todo = {s: s}, deque([s])
            while todo and t not in back:
                i = todo.popleft()
                for j, w in flow[i].items():
                    if w > 1e-12 and j not in back:
                        back[j] = i
                        todo.append(j)
            if t not in back:
                break
            path, j = [], t
            while j != s:
                path.append((back[j], j))
                j = back[j]
            push = min(flow[i][j] for i, j in path)
            for i, j in path:
                flow[i][j] -= push
                flow[j][i] = flow[j].get(i, 0.0) + push
        for i in free:
            label[i] = i in back
    return label


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by one space; empty if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    has_article = any(b.inside and b.off < SOFT for b in found)
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = ADJACENT
        j = last_of.get(b.parent)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING
        last_of[b.parent] = i
    keep = min_cut([log_odds(b, has_article) for b in found], edges)
    for doubted in (SOFT, FOREIGN):
        if not any(keep):
            # boilerplate words on a wrapper of everything
            has_article = any(b.inside and b.off <= doubted for b in found)
            keep = min_cut([log_odds(b, has_article, doubted) for b in found], edges)
    return " ".join(b.text for b, k in zip(found, keep) if k)


@F.pandas_udf(T.StringType())
def _main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages`.

    The whole html is read, whatever its length; character references are
    decoded, white space in a block is one space. Null, empty and text-free
    pages have an empty text; rows that repeat are rows again.
    """
    p = pages.select(pages["page_id"], pages["url"], _main_text(F.coalesce(pages["html"], F.lit(""))).alias("text"))
    return p.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
