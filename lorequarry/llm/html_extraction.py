"""Main-text extraction from HTML pages with two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block by its own figures:
link density, length and stop-word density. Pass two lets the ambiguous blocks (short ones, those of middling
figures) inherit the label of the nearest decided neighbours, those of their own container first.
Containers only speak against: what stands in a menu, footer, form and the like is bad, as is what stands
outside the page's surest container of an article, where there is one. Inside it, and on pages without one, the same
figures decide: a list of links is bad there too, and text without stop words goes with its neighbours.

Defined results: a null or empty page, and a page without article text, give the empty string;
pages of any length are read whole; unclosed and stray tags never fail; rows repeat in the
output as in the input; only page_id, url and html are read, so extra columns don't matter.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup"
    " option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are a block each rather than hold several.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary legend pre".split())
RAW_TAGS = frozenset("script style template textarea title noframes noembed iframe xmp svg math object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never main text, whatever stands in it.
BOILERPLATE_TAGS = frozenset("head nav footer aside form dialog menu button select datalist meter progress output fieldset noscript search".split())
#: Words in class, id and similar attributes that mark a container as boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners billboard breadcrumb"
    " breadcrumbs captcha comment comments commentlist consent cookie cookies copyright cta disclaimer discussion disqus"
    " feedback footer footnav form gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter"
    " notice notices notification outbrain overlay pager pagination paywall popular popup promo promoted promotion recommended"
    " rail related replies reply respond rss search share sharing sidebar signin signup skyscraper social sponsor sponsored"
    " subscribe subscription taboola teaser teasers ticker toolbar topbar trending warning widget widgets".split()
)
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
#: Such containers are boilerplate only where they aren't the article's own.
HEAD_WORDS = frozenset("header masthead".split())
#: Words that mute even an inline element.
INLINE_WORDS = frozenset("ad ads advert advertisement adverts comment comments cookie cookies newsletter promo share sharing social sponsor sponsored subscribe".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
#: How sure a container is of holding the article: by its tag, as the main part of the page, by its name.
BY_TAG, BY_ROLE, BY_NAME = 3, 2, 1
# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to a in is that it for was on are as with be by at this from or an have not he his they which but you we"
    " de la le les et des en un une du que est pour qui dans sur au pas par plus avec il elle ce son se ne"
    " der die das und zu den von mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " el los las y del por con una su para lo como más o pero sus al".split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDS = re.compile(r"[^\W\d_]+")

GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the block rules."""

    short_chars: int = 70
    long_chars: int = 200
    #: for the few dozen stop words a language has here
    stop_low: float = 0.005
    stop_high: float = 0.15
    max_link_density: float = 0.33
    heading_reach: int = 200


@dataclass
class Block:
    """A run of text between block-level tags."""

    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    heading: bool = False
    boilerplate: bool = False
    level: int = 0
    #: number of the nearest open element that holds several blocks
    container: int = 0
    #: share of stop words, of blocks that aren't short
    stop: float = 0.0
    text: str = ""
    label: str = ""
    #: what gave the label: container, links, stop words, neighbours or, on a page without a good block, that it is the best there is
    rule: str = ""


@dataclass(frozen=True)
class Marks:
    """What an element's own tag says: boilerplate, how surely the article, not shown at all."""

    bad: bool
    level: int
    hidden: bool


def marks(name: str, rest: str, inside: int) -> Marks:
    """The marks of a start tag within a container that holds the article as surely as inside says."""
    bad = name in BOILERPLATE_TAGS or (name == "header" and not inside)
    level = BY_TAG if name == "article" else BY_ROLE if name == "main" else 0
    is_block = name in BLOCK_TAGS
    hidden = bad and not is_block
    if "=" in rest or "hidden" in rest:
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key in ("class", "id", "itemprop", "data-role"):
                words = {x.lower() for x in NAME_PARTS.findall(value)}
                if not is_block:
                    hidden |= bool(words & INLINE_WORDS)
                elif words & BOILERPLATE_WORDS - (HEAD_WORDS if inside else set()):
                    bad = True
                elif words & CONTENT_WORDS and name in ("div", "section", "td"):
                    level = max(level, BY_NAME)
            elif key == "role":
                bad |= value.lower() in BOILERPLATE_ROLES
                level = max(level, {"article": BY_TAG, "main": BY_ROLE}.get(value.lower(), 0))
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
    # an article within an article is what readers add
    return Marks(bad or (name == "article" and inside == BY_TAG), level, hidden)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, each with what its containers say of it."""
    out: list[Block] = []
    block = Block()
    #: open elements: name, boilerplate here or above, how surely the article here or above, number
    stack: list[tuple[str, bool, int, int]] = []
    at, links, opened = 0, 0, 0
    size = len(page)

    def say(text: str) -> None:
        if not text or (stack and stack[-1][1] and stack[-1][0] not in BLOCK_TAGS):
            return  # nothing, or within a hidden inline element
        text = html_lib.unescape(text) if "&" in text else text
        block.parts.append(text)
        if links:
            block.link_chars += len("".join(text.split()))

    def end() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                top = stack[-1] if stack else ("", False, 0, 0)
                block.boilerplate, block.level = top[1], top[2]
                block.container = next((x[3] for x in reversed(stack) if x[0] in BLOCK_TAGS and x[0] not in LEAF_TAGS), 0)
                block.heading = any(x[0] in HEADINGS for x in stack[-3:])
                out.append(block)
        block = Block()

    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, rest = m["close"] or m["close2"], m["rest"] or m["rest2"] or ""
        is_block = name in BLOCK_TAGS
        if name in RAW_TAGS:
            if closing or (rest.endswith("/") and name in ("svg", "math")):
                continue
            shut = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = shut.end() if shut else size if name in ("script", "style") else at
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        if is_block:
            end()
            links = 0
        if name in VOID_TAGS:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # an inline end tag doesn't close the blocks around it
            if depth is not None and (is_block or not any(x[0] in BLOCK_TAGS for x in stack[depth:])):
                del stack[depth:]
            continue
        if not is_block and not rest and name not in BOILERPLATE_TAGS:
            continue  # a bare inline element changes nothing
        if is_block:
            while stack and (stack[-1][0] in ("p", "head") or stack[-1][0] not in BLOCK_TAGS):
                stack.pop()
            if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] in ({name} | {"dt": {"dd"}, "dd": {"dt"}, "td": {"th"}, "th": {"td"}}.get(name, set())):
                stack.pop()
        _, bad, level, _ = stack[-1] if stack else ("", False, 0, 0)
        m = marks(name, rest, level)
        if is_block or m.hidden:  # other inline text belongs to its block
            opened += 1
            stack.append((name, bad or m.bad or m.hidden, max(level, m.level), opened))
    end()
    return out


def decide(block: Block, rules: Rules, level: int) -> tuple[str, str]:
    """Pass one: the label of a block by itself, and the rule that gave it, on a page whose surest container of the article has a level."""
    text = block.text
    if block.boilerplate or block.level < level:
        return BAD, "container"
    if block.link_chars > rules.max_link_density * len(text.replace(" ", "")):
        return BAD, "links"
    if len(text) < rules.short_chars:
        return SHORT, ""
    words = WORDS.findall(text.lower())
    block.stop = stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(text) <= rules.long_chars:
        return (NEAR if stop >= rules.stop_high else SHORT), ""
    return (GOOD, "stop words") if stop >= rules.stop_high else (NEAR if stop >= rules.stop_low else SHORT, "")


def nearest(first: list[str], groups: list[int]) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided ones before and after it in its group."""
    out: list[list[int | None]] = [[None, None] for _ in first]
    for side, order in ((0, range(len(first))), (1, range(len(first) - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            out[i][side] = last.get(groups[i])
            if first[i] in (GOOD, BAD):
                last[groups[i]] = i
    return [(a, b) for a, b in out]


def promote(blocks: list[Block], rules: Rules) -> None:
    """On a page without a good block, the nearly good ones are good; if it has none of them, all that no rule speaks
    against, unless a long block has stop words, but too few, or links make a block bad: then the page has no text."""
    if any(b.label == GOOD for b in blocks):
        return
    undecided = [b for b in blocks if b.label != BAD]
    some = [b for b in undecided if b.label == NEAR]
    if not some and all(len(b.text) <= rules.long_chars or not b.stop for b in undecided) and not any(b.rule == "links" for b in blocks):
        some = undecided
    for b in some:
        b.label, b.rule = GOOD, "best of the page"


def settle(blocks: list[Block], rules: Rules, level: int) -> None:
    """Pass two: ambiguous blocks take the label of the nearest decided neighbours: of their container, else of the article, else of the page."""
    promote(blocks, rules)
    first = [b.label for b in blocks]
    inside = [int(not b.boilerplate and b.level >= level) for b in blocks]
    kin = nearest(first, [b.container if inside[i] else -1 for i, b in enumerate(blocks)])
    article, page = nearest(first, inside), nearest(first, [0] * len(blocks))
    for i, b in enumerate(blocks):
        if first[i] in (GOOD, BAD):
            continue
        b.rule = "neighbours"
        near = (kin[i], article[i]) if level else (kin[i],)
        left, right = next((x for x in near if x != (None, None)), page[i])
        labels = {first[x] for x in (left, right) if x is not None}
        if len(labels) < 2:
            b.label = labels.pop() if labels else BAD
        elif b.heading and first[right] == GOOD and sum(len(x.text) for x in blocks[i + 1 : right]) <= rules.heading_reach:
            b.label = GOOD
        elif kin[i] == (None, None):
            b.label = BAD  # by itself in a container between text and what isn't
        elif first[i] == NEAR:
            b.label = GOOD
        else:
            # of two as near as each other, the one that speaks against
            b.label = first[left] if i - left < right - i else first[right] if right - i < i - left else BAD


def labelled(page: str, rules: Rules = Rules()) -> list[Block]:
    """The blocks of a page with their labels, and the rules that gave them."""
    blocks = blocks_of(page)
    level = max((b.level for b in blocks if not b.boilerplate), default=0)
    for b in blocks:
        b.label, b.rule = decide(b, rules, level)
    settle(blocks, rules, level)
    return blocks


def extract(page: str | None, rules: Rules = Rules()) -> str:
    """The main text of one page: its good blocks, joined by an empty line."""
    return "\n\n".join(b.text for b in labelled(page, rules) if b.label == GOOD) if page else ""


def extract_main_text(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(x, rules) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
