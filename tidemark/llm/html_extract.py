"""Main text of HTML pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its path of open
elements from the root.  For every path the text length and the punctuation of its blocks are
aggregated; both ratios are smoothed along the page (not across the borders of article and main
elements), fused into one score for each path, and paths above a threshold are content.

Markup enters as a factor of that score.  Blocks in an article or main element weigh ``WEIGHT`` times as much as others.
An element whose class, id or role speaks of adverts, notices, comments and the like makes paths of its
own, apart from the same tags without it: where the whole name does (``ad``, ``comment-list``) they weigh ``HINTED``, where
only a part of it does (``notice-period``) outside an article, ``HALF_HINTED``.  No block is taken or left for one word: a path
with a hint is content if it scores high enough beside the page's best path without one.  A page that has no text
without a hint has no main text.

The element that directly holds content brings its own headings, short paragraphs, list
items and cells along; what lies in further divisions and sections below it must score by itself.

Navigation, site headers and footers, asides, forms, dialogs, and hidden elements, which HTML itself declares
to be no content, are set aside before the ratios are taken.

Defined results: a null, empty or textless page has the empty text; an unclosed tag or comment at
the end of a cut page is dropped; rows with equal ids are all returned; columns that aren't kept are
ignored, whatever their names.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_arrow, pieces_of

#: An attribute's value may be quoted only straight after its equals sign; other quotes are plain characters.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
MARKUP = re.compile(rf"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)({ATTRIBUTES})>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style noscript template iframe svg math canvas object video audio textarea title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ASIDE = frozenset("nav footer aside form dialog menu button select datalist fieldset search head".split())
#: An opening tag ends an open element of these kinds, unless a container lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table div article section main body html td th blockquote figure menu".split())
#: Words of a class, id or role that declare an element not to be article text.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies discussion sidebar sidebars widget widgets related recommended recommendation recommendations share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead toolbar topbar copyright disclaimer skip complementary contentinfo search tags hidden".split())
HEADER_HINTS = frozenset(("header",))
#: Words that only say how an element is laid out: beside them a hint speaks for the whole name.
LAYOUT = frozenset("area bar block body bottom box button card cell col column container content feed field footer form group header heading holder inner item items left link links list lists main middle module outer page panel post posts right row section site slot space spot text thread title top tree unit wrap wrapper zone".split())
OPEN_TO_ALL = frozenset("html body main article".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: A path is content from this share of the page's best score on; smoothing reaches this many blocks to each side.
THRESHOLD, REACH = 0.1, 2
LINKED = 0.8
#: The score of a block in an article or main element counts so many times, that of one under a hint so much of it.
WEIGHT, HALF_HINTED, HINTED = 2.0, 0.5, 0.001
#: Elements that only arrange text: what directly holds a block is the next element around them.
ARRANGING = frozenset("ul ol dl table thead tbody tfoot tr blockquote figure header hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SHORT = HEADINGS | frozenset("p li dt dd td th pre caption figcaption".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    aside: bool
    hint: int  # 0: none, 1: a part of a name, 2: a whole name speaks of something else
    inside: bool  # of an article or main element
    within: int  # the innermost article or main element, by its number on the page; 0 for none
    holder: int  # the element that directly holds it


def _hint(value: str, hints: frozenset[str]) -> int:
    """2 if a name in an attribute's value is made of hints and words of layout, 1 if a hint is a part of one, else 0."""
    strength = 0
    for name in value.split():
        words = {t.lower() for t in TOKEN.findall(name)}
        if not hints.isdisjoint(words):
            strength = max(strength, 2 if words <= hints | LAYOUT else 1)
    return strength


def _attributes(raw: str) -> tuple[bool, int, int]:
    """(hidden, hint, hint of a header) by an opening tag's attributes."""
    hidden, hint, head = False, 0, 0
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            hint = max(hint, _hint(value, HINTS))
            head = max(head, _hint(value, HEADER_HINTS))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
    return hidden, hint, head


MARKS = ("", "?", "!")


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    # of each open element: name, whether it is set aside, the strongest hint on it or around it, and whether it is in an article
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    numbers, opened = [0], 0  # of the stack's elements; rises with every element of the page
    path: tuple[str, ...] = ()
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(htmllib.unescape("".join(buffer)).split())
            if text:
                _, aside, hint, inside = stack[-1]
                out.append(Block((*path, MARKS[hint]), text, linked, aside, hint, inside, *_holders(stack, numbers)))
            buffer.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            buffer.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br" or name == "wbr":
            buffer.append(" " if name == "br" else "")
            linked += links and name == "br"
            continue
        if closing:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:], numbers[i:]
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            path = tuple(x[0] for x in stack[1:] if x[0] in BLOCK)
            continue
        if name in BLOCK:
            flush()
            links = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:], numbers[i:]
                    break
                if stack[i][0] in CONTAINERS:
                    break
            ends = CLOSES.get(name)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        del stack[i:], numbers[i:]
                        break
                    if stack[i][0] in CONTAINERS and stack[i][0] not in ("td", "th"):
                        break
        if name in VOID:
            continue
        _, aside, over, inside = stack[-1]
        hidden, hint, head = _attributes(attributes) if attributes.strip() else (False, 0, 0)
        if name == "main":  # nothing around it can be open but by a missing end tag
            aside, over = False, 0
        inside = inside or name in ("article", "main")
        aside = aside or hidden or name in ASIDE or (name == "header" and not inside)
        if name not in OPEN_TO_ALL:
            over = max(over, hint, 0 if inside else head)
        elif name == "article":
            over = max(over, hint)
        if not attributes.rstrip().endswith("/"):
            stack.append((name, aside, over, inside))
            opened += 1
            numbers.append(opened)
            if name in BLOCK:
                path = tuple(x[0] for x in stack[1:] if x[0] in BLOCK)
    flush()
    return out


def _holders(stack: list[tuple[str, bool, int, bool]], numbers: list[int]) -> tuple[int, int]:
    """Numbers of the innermost article or main element and of the element that directly holds the text at hand."""
    at = len(stack) - 1
    while at and stack[at][0] not in BLOCK:
        at -= 1
    if stack[at][0] in SHORT:
        at -= 1
    while at and (stack[at][0] in ARRANGING or stack[at][0] not in BLOCK):
        at -= 1
    within = len(stack) - 1
    while within and stack[within][0] not in ("article", "main"):
        within -= 1
    return numbers[within], numbers[at]


def _smoothed(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    weights = np.exp(-0.5 * np.arange(-REACH, REACH + 1) ** 2)
    padded = np.pad(x, REACH, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def content(found: list[Block]) -> list[Block]:
    """Blocks on content paths, and the short ones that elements with content hold beside them."""
    kept = [b for b in found if not b.aside]
    if all(b.hint == 2 for b in kept):
        return []
    number = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in kept))}
    of = np.array([number[b.path] for b in kept])
    many = np.bincount(of)
    chars = np.array([max(0, len(b.text) - b.linked) for b in kept], float)
    points = np.array([len(PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0 for b in kept], float)
    text_ratio, point_ratio = (np.bincount(of, weights=v) / many for v in (chars, points))
    hint = np.array([b.hint for b in kept])
    # smoothing stops at borders of articles and of elements under a whole hint
    runs = np.split(np.arange(len(kept)), np.flatnonzero(np.diff([b.within for b in kept]) | np.diff(hint == 2)) + 1)
    fused = np.concatenate([_smoothed(text_ratio[of[r]]) * (1 + _smoothed(point_ratio[of[r]])) for r in runs])
    inside = np.array([b.inside for b in kept])
    fused *= np.where(inside, WEIGHT, 1.0) * np.array([1.0, HALF_HINTED, HINTED])[np.where(inside & (hint == 1), 0, hint)]
    score = (np.bincount(of, weights=fused) / many)[of]
    chosen = score >= THRESHOLD * score[hint < 2].max()
    holders = {x for b, c in zip(kept, chosen, strict=True) if c for x in ((b.holder, b.within) if b.inside else (b.holder,))}
    return [b for b, c in zip(kept, chosen, strict=True) if (_legible(b) if c else _beside(b, holders))]


def _legible(b: Block) -> bool:
    return b.inside or b.linked < LINKED * len(b.text) + 1


def _beside(b: Block, holders: set[int]) -> bool:
    """A heading, or a short text that isn't a link, directly in an element that holds content, and under no whole hint."""
    return b.hint < 2 and b.holder in holders and (b.linked < LINKED * len(b.text) + 1 or (b.inside and b.path[-2] in HEADINGS))


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(blocks(page))) if page else ""


def extract(pages: DataFrame, *, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns of each page, with text and n_chars (code points)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            texts = [main_text(p) for p in b.column(len(keep)).to_pylist()]
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return map_arrow(pages.select(*keep, F.col(html_col).alias(fresh("_html", keep))), run, schema)
