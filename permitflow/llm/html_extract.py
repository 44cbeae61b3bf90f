"""Main-text extraction by two passes of block rules.

The page is cut into blocks at block-level tags, outside of containers that hold no main text. Pass one decides each
block by link density, length and stop-word density: clear prose is text, lists of links and long blocks without
function words are boilerplate, and short blocks stay open. Pass two gives each open block the label of its nearest
decided neighbour.

Containers are known by their element, or by whole names in class, id and role (``cookie-notice``, not ``no-sidebar``).
An ``article`` or ``main`` element is trusted if it holds at least as much decided prose as the rest of the page: then
its bounds are decided neighbours, and what lies outside is boilerplate. A container around the only article of a page
is no container, and if the named containers leave no prose at all they are read after all.

Defined edge cases: null or empty html gives an empty text; unclosed, stray and cut-off tags are tolerated; pages of any
length are read whole; repeated rows give one result each; an empty table gives an empty result; only page_id, url and
html are read, whatever other columns there are.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """the of and to in is that it was for on are as with be this by from at or an not have his her they you we
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
    le la les de des du et en un une que qui dans pour par sur est au avec ce il ne pas plus se son aux
    el la los las de del y en que un una por con para es se no al lo como su más o pero sus le ya""".split()
)
# Elements of HTML.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("head nav header footer aside form button select option dialog menu svg math object canvas audio video noscript template iframe script style title textarea label fieldset".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
# Elements whose end tag may be left out before another of their kind.
REPEATED = frozenset("p li option tr td th dt dd".split())
# Words of class, id and role that name a container which holds no main text.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    notification alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar side widget widgets
    footer header masthead comment comments discussion disqus reply replies respond share sharing social related recommended newsletter
    subscribe subscription signup login toolbar copyright disclaimer complementary contentinfo search""".split()
)
# Words that turn a name into a statement about the page or a state (``no-sidebar``, ``comments-open``); and
# words for the article's own parts, whose headers are its own and whose sidebars are a layout (``content-sidebar``).
DENIALS = frozenset("no not non without with has have is hide hidden show open closed enabled disabled layout".split())
OWN = frozenset("article entry post content".split())
OWN_PARTS = frozenset("header sidebar side banner masthead".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)""", re.S
)
ATTR = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))""", re.I)
WORD = re.compile(r"[^\W\d_]+")
SHORT = 70
LINKS_MOST = 0.5
STOPS_LEAST = 0.2


@dataclass(slots=True)
class Block:
    """A run of text, the characters of it in links, and where it stands."""

    text: str
    links: int
    article: bool
    box: int  # the innermost container around it, or -1
    heading: bool


@dataclass(slots=True)
class Container:
    """An element that may hold no main text: ``named`` by an attribute, else by its kind; ``article``: one is inside.
    ``outer`` is the next container around it, which has a smaller number, or -1."""

    named: bool
    outer: int
    article: bool = False


def _names(attrs: str) -> list[str]:
    """Whole names in class, id and role; a role has a prefix of its own so that ``role=main`` can be told."""
    out = []
    for m in ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        out += [("role:" if m[1].lower() == "role" else "") + v for v in value.split()]
    return out


def hinted(name: str) -> bool:
    """Whether a name says that its container holds no main text: by its last word (``post-comments``) or its first
    (``sidebar-left``), unless another word denies it."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name.removeprefix("role:")).lower()) if w]
    hints = [w for w in words[:1] + words[-1:] if w in HINTS]
    return bool(hints) and not DENIALS.intersection(words) and not (OWN.intersection(words) and OWN_PARTS.issuperset(hints))


def parse(page: str) -> tuple[list[Block], list[Container]]:
    """Blocks of a page, and the containers that they stand in."""
    out: list[Block] = []
    boxes: list[Container] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, container number or -1, is an article
    open_tags: Counter[str] = Counter()  # a stray end tag must not cost a look through the stack
    inner = -1  # the innermost open container
    article = links = in_link = 0

    def close() -> None:
        nonlocal links
        if text:
            t = " ".join("".join(text).split())
            if t:
                heading = any(name in ("h1", "h2", "h3", "h4", "h5", "h6") for name, *_ in stack[-3:])
                out.append(Block(t, min(links, len(t)), article > 0, inner, heading))
            text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            t = _html.unescape(raw) if "&" in raw else raw
            text.append(t)
            if in_link:
                links += len(" ".join(t.split()))

    def pop(to: int) -> None:
        nonlocal inner, article, in_link
        while len(stack) > to:
            name, box, art = stack.pop()
            open_tags[name] -= 1
            if box >= 0:
                inner = boxes[box].outer
            article -= art
            in_link -= name == "a"

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        is_block = name in BLOCK
        if is_block:
            close()
        if m[1]:
            if open_tags[name] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name == "br":
            text.append(" ")
        if name in VOID or m[3].endswith("/") and not is_block and name != "a":
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in REPEATED and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        names = _names(m[3])
        art = name in ("article", "main") or "role:main" in names
        # An article's own header holds its title.
        by_kind = name in OUTSIDE and not (name == "header" and article)
        # Page-wide names describe the page; an article is left out only by a plain name of its own.
        by_name = name not in ("html", "body", "main") and any(x in HINTS if art else hinted(x) for x in names)
        box = -1
        if by_kind or by_name:
            box = len(boxes)
            boxes.append(Container(not by_kind, inner))
            inner = box
        if art and not by_name and inner >= 0:
            boxes[inner].article = True
        stack.append((name, box, art))
        open_tags[name] += 1
        article += art
        in_link += name == "a"
    close()
    for b in reversed(boxes):  # what is in a container is in those around it
        if b.article and b.outer >= 0:
            boxes[b.outer].article = True
    return out, boxes


def outside(found: list[Block], boxes: list[Container], harmless: list[bool]) -> list[Block]:
    """The blocks that stand in ``harmless`` containers alone, if in any."""
    clear: list[bool] = []
    for b, fine in zip(boxes, harmless, strict=True):
        clear.append(fine and (b.outer < 0 or clear[b.outer]))
    return [b for b in found if b.box < 0 or clear[b.box]]


def readable(found: list[Block], boxes: list[Container]) -> list[Block]:
    """The blocks outside of containers."""
    free = [b for b in found if b.box < 0]
    if any(b.article or _mark(b) > 0 for b in free) or not any(b.article for b in found):
        return free
    # Neither an article nor prose is left: those around an article are no containers.
    return outside(found, boxes, [b.article for b in boxes])


def _mark(b: Block) -> int:
    """Pass one: 1 text, -1 boilerplate, 0 open."""
    if b.links > LINKS_MOST * len(b.text):
        return -1
    if len(b.text) < SHORT:
        return -1 if "©" in b.text else 0
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    return 1 if stops >= STOPS_LEAST else -1 if stops < STOPS_LEAST / 4 else 0


def decide(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    marks = [_mark(b) for b in found]
    if 1 not in marks:
        # Not one of the languages served: length and links alone decide.
        marks = [1 if len(b.text) >= SHORT and b.links <= LINKS_MOST * len(b.text) else m for b, m in zip(found, marks, strict=True)]
    prose = [0, 0]
    for b, m in zip(found, marks, strict=True):
        prose[b.article] += len(b.text) if m > 0 else 0
    trusted = any(b.article for b in found) and prose[True] >= prose[False]
    if trusted:
        # Within a trusted article only links are sure boilerplate; outside of it everything is.
        marks = [-1 if not b.article or m < 0 and b.links > LINKS_MOST * len(b.text) else max(m, 0) for b, m in zip(found, marks, strict=True)]

    def nearest(order: range) -> list[tuple[int, int]]:
        """(label, place) of the nearest decided block before each in ``order``; links in an article label nothing."""
        out: list[tuple[int, int]] = [(0, 0)] * len(found)
        last, before = (0, 0), None
        for i in order:
            b = found[i]
            if trusted and (before is None or before.article != b.article):
                last = (1 if b.article else -1, i - order.step)  # the article's bound
            out[i] = last
            if marks[i] > 0 or marks[i] < 0 and not (trusted and b.article):
                last = (marks[i], i)
            before = b
        return out

    n = len(found)
    lefts, rights = nearest(range(n)), nearest(range(n - 1, -1, -1))
    keep: list[bool] = []
    for i, mark in enumerate(marks):
        if not mark:
            (a, at_a), (b, at_b) = lefts[i], rights[i]
            if found[i].heading and b:
                mark = b  # a heading goes with what follows
            elif a and b and a != b:
                # At equal distance it stays: a last short paragraph, or a caption before text.
                mark = 1 if i - at_a == at_b - i else a if i - at_a < at_b - i else b
            else:
                mark = a or b or 1
        keep.append(mark > 0)
    return keep


def main_blocks(page: str) -> list[str]:
    """The texts of main blocks in page order."""
    found, boxes = parse(page)
    free = readable(found, boxes)
    keep = decide(free)
    if not any(keep):
        # Nothing but boilerplate outside: the names of containers may have been misread, their kinds were not.
        free = outside(found, boxes, [b.named for b in boxes])
        keep = decide(free)
    return [b.text for b, k in zip(free, keep, strict=True) if k]


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    return "\n\n".join(main_blocks(page or ""))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page row."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return p.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
