"""Main text of web pages by two-pass block rules.

A page is split at block tags. First pass: blocks in containers that never hold the article (menus,
footers, forms, adverts, notices, comments, ... by tag, role, class or id) are boilerplate, as are blocks
made of links; the others are decided by length and stop-word density, or left ambiguous when short.
A page's mark of its article (``article``, ``main``) is evidence: fewer stop words are asked for in it and
no block is bad for its text alone; outside, more are asked for unless most running text is there. Second
pass: ambiguous blocks take the label of the nearest decided block of their container, content on a tie;
in an article they are boilerplate only between two blocks that are.

A name is a whole class or id, and weak evidence: it never excludes an article element by itself. One above
an article excludes it only if the text outside such names is no less than each such article's, or if the
article has such a name as well. Where tags, roles and names would exclude all blocks of a page, its texts decide.

Defined results: null and empty pages give an empty text; markup that is broken off ends the page
there; a page's text is read whole, of any length, in time in proportion to it; repeated rows give repeated
results; other columns are kept, but for one named as the result is, which it replaces.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import of_texts

# Tags and names of containers.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math object select canvas audio video noframes xmp".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button head header".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored promo promoted promotion banner sidebar sidebars rail menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices notification notifications alert "
    "popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations more "
    "comment comments commentlist disqus replies reply respond discussion widget widgets toolbar pagination pager copyright legal disclaimer toc skip "
    "outbrain taboola teaser teasers".split()
)
ARTICLE_NAMES = frozenset("article articlebody post postbody entry story main content maincontent".split())
STOP_WORDS = frozenset(
    "a about all an and are as at be but by for from had has have he her his i in is it its more not of on or she so that the their there they this to was we were "
    "which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich ihr im ist mit nach nicht noch sich sie sind über um und von war "
    "wie wird zu zum zur "
    "al como con de del el en era es esta este fue ha la las lo los más me mi muy no o para pero por que se ser sin sobre su sus también un una y "
    "au aux avec ce ces cette dans du elle est et il ils je leur les mais ne nous ont ou où par pas plus pour qui sa sont sur une vous".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINK_HIGH = 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\s=>\"'/]++|\s++|/|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(eq=False)
class Element:
    tag: str
    boilerplate: bool
    article: int
    link: bool
    hidden: bool = False
    named: tuple[Element, ...] = ()  # itself and those above that have a container's name
    holds: bool = False  # an article without such a name is below


@dataclass
class Block:
    boilerplate: bool
    article: int
    hidden: bool = False
    named: tuple[Element, ...] = ()
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""

    @cached_property
    def density(self) -> float:
        """The share of stop words."""
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def is_boilerplate_name(token: str) -> bool:
    """Whether a class or id is a container's name as a whole: ``cookie-notice`` is, ``has-sidebar`` is not."""
    parts = _NAME.findall(_CAMEL.sub(" ", token).lower())
    return bool(parts) and all(p in BOILERPLATE_NAMES for p in parts)


def describe(tag: str, attributes: str, above: Element | None, number: int) -> Element:
    """An element's place: in boilerplate, and the number of the article it is in (0: none)."""
    boilerplate, article = above is not None and above.boilerplate, above.article if above else 0
    hidden, named = above is not None and above.hidden, above.named if above else ()
    names: set[str] = set()
    own_name = False
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                names |= set(_NAME.findall(_CAMEL.sub(" ", value).lower()))
                own_name |= any(map(is_boilerplate_name, value.split()))
            elif name == "role":
                if value.lower() == "main":
                    names.add("main")
                boilerplate |= value.lower() in BOILERPLATE_ROLES
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden |= name != "aria-hidden" or tag != "body"
    if tag not in ("html", "body"):
        boilerplate |= tag in BOILERPLATE_TAGS and not (tag == "header" and article)
    boilerplate |= hidden
    own_name &= tag not in ("html", "body", "main") and not (tag in ("h1", "p") and article)
    is_article = tag in ("article", "main") or "main" in names or tag in ("div", "section") and bool(names & ARTICLE_NAMES) and "wrapper" not in names
    if not boilerplate and not article and is_article:
        article = number
    element = Element(tag, boilerplate, article, tag == "a" or above is not None and above.link and tag not in BLOCK_TAGS, hidden, named)
    if own_name and (named or tag != "article"):
        element.named = (*named, element)
    elif tag in ("article", "main") and not boilerplate:
        for e in named:
            e.holds = True
    return element


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, empty ones left out."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # of the stack's tags, so that no end tag searches it in vain
    at, number, block = 0, 0, Block(False, 0)

    def close(place: int) -> bool:
        """End the elements from a place of the stack; whether one of them was a block."""
        gone = [e.tag for e in stack[place:]]
        opened.subtract(gone)
        del stack[place:]
        return not BLOCK_TAGS.isdisjoint(gone)

    def text(piece: str) -> None:
        if piece:
            block.pieces.append(piece)
            if stack and stack[-1].link:
                block.link_chars += len(piece)

    def split() -> None:
        nonlocal block
        if block.pieces:
            block.text = " ".join(entities.unescape("".join(block.pieces)).split())
            if block.text:
                out.append(block)
        top = stack[-1] if stack else None
        block = Block(top.boilerplate, top.article, top.hidden, top.named) if top else Block(False, 0)

    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
        elif m := _TAG.match(page, lt):
            at, tag, closing = m.end(), m[2].lower(), bool(m[1])
            if tag == "br":
                text(" ")
            elif closing:
                if opened[tag] > 0:
                    place = len(stack) - 1
                    while stack[place].tag != tag and (tag in BLOCK_TAGS or stack[place].tag not in BLOCK_TAGS):
                        place -= 1
                    # an inline end tag does not close blocks
                    if stack[place].tag == tag and close(place):
                        split()
                elif tag in BLOCK_TAGS:
                    split()
            elif tag in RAW_TAGS and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                gt = page.find(">", end.start()) if end else -1
                at = len(page) if gt < 0 else gt + 1
            elif tag in VOID_TAGS:
                if tag in BLOCK_TAGS:
                    split()
            else:
                if tag in BLOCK_TAGS:
                    # a block start ends an open paragraph; an item ends its open sibling
                    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
                    walls = ("ul", "ol", "dl", "table", "article", "section", "div", "main", "body")
                    for i in range(len(stack) - 1, -1, -1) if any(opened[x] > 0 for x in ("p", *ends)) else ():
                        if stack[i].tag == "p" or stack[i].tag in ends:
                            close(i)
                            break
                        if stack[i].tag in walls:
                            break
                number += 1
                stack.append(describe(tag, m[3], stack[-1] if stack else None, number))
                opened[tag] += 1
                if tag in BLOCK_TAGS:
                    split()
        else:
            # not a tag: the sign stands for itself, unless a tag is broken off here
            if re.compile(r"</?[a-zA-Z]").match(page, lt):
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
    split()
    return out


def by_text(block: Block) -> str:
    """good, bad or short by a block's text alone."""
    n, stops = len(block.text), block.density
    if n < LENGTH_LOW:
        return "bad" if block.link_chars else "short"
    if stops >= STOP_HIGH or stops >= STOP_LOW and n >= LENGTH_HIGH:
        return "good"
    return "short" if stops >= STOP_LOW or n >= LENGTH_HIGH and not block.link_chars else "bad"


def first_pass(found: list[Block]) -> None:
    """Label blocks good, bad, or short and open for the second pass."""
    amount = {True: 0, False: 0}
    for b in found:
        b.label = "bad" if b.boilerplate or b.link_chars > LINK_HIGH * len(b.text) else by_text(b)
        amount[b.article > 0] += len(b.text) * (b.label == "good")
    marked = any(b.article and not b.boilerplate for b in found) and amount[True] >= amount[False]
    for b in found:
        if b.boilerplate or b.link_chars > LINK_HIGH * len(b.text):
            continue
        if b.article:
            b.label = "good" if len(b.text) >= LENGTH_LOW and b.density >= STOP_LOW else "short"
        elif marked and b.label == "good" and (len(b.text) < LENGTH_HIGH or b.density < STOP_HIGH):
            b.label = "short"


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of the same container."""
    groups: dict[int, list[Block]] = {}
    for b in found:
        if not b.boilerplate:
            groups.setdefault(b.article, []).append(b)
    for article, own in groups.items():
        sides: list[list[tuple[int, str]]] = [[] for _ in own]
        for order in (range(len(own)), range(len(own) - 1, -1, -1)):
            last = None
            for i in order:
                if own[i].label != "short":
                    last = i
                elif last is not None:
                    sides[i].append((abs(i - last), own[last].label))
        for b, near in zip(own, sides, strict=True):
            if b.label == "short":
                if article:
                    b.label = "bad" if [label for _, label in near] == ["bad", "bad"] else "good"
                else:
                    b.label = min(near, key=lambda x: (x[0], x[1] != "good"), default=(0, "bad"))[1]


def exclude(found: list[Block]) -> None:
    """Exclude blocks by the names above them, as far as the page's texts allow."""
    outside, articles = 0, {0: 0}
    for b in found:
        if not b.boilerplate and (not b.named or all(e.holds for e in b.named)) and b.link_chars <= LINK_HIGH * len(b.text) and by_text(b) == "good":
            if not b.named:
                outside += len(b.text)
            elif b.article:
                articles[b.article] = articles.get(b.article, 0) + len(b.text)
    spare = not outside or max(articles.values()) > outside
    for b in found:
        b.boilerplate |= any(not (spare and e.holds) for e in b.named)
    if all(b.boilerplate for b in found):
        for b in found:
            b.boilerplate, b.article = b.hidden, 0


def main_text(page: str) -> str:
    found = blocks(page)
    exclude(found)
    first_pass(found)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


@F.pandas_udf(T.StringType())
def _main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p or "") for p in pages], dtype=object)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with each page's main text."""
    return of_texts(pages).withColumn(name, _main_text(F.col(html_col)))
