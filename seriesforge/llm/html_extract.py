"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The first pass scores each
block by its stop-word density, its length and its link density. Where the
block stands and what the elements around it are called are further evidence
with a weight beside these (``Weights``); only elements that hold no text of an
article by their nature (menus, the page's header, footers, asides, forms) and
hidden ones decide alone. A name on a text's own element (paragraph, heading,
cell) weighs less than one on what surrounds it, and its id nothing, as ids of
texts are made of their words. What follows a heading such as "Comments" up to
the next one of its level, and a sentence that says outside an article that the
site uses cookies, count as named so. A button or label in the middle of a text
belongs to the text. Blocks of a clear score are decided, short ones and those
of a middle score are ambiguous. In the second pass they inherit the
label of their nearest decided neighbours: blocks of an article from those of
the same article, others from all others. Where the two sides differ, a block
of the article, a heading in front of text and a block of fair density stay,
short ones go. An article without any decided block is kept as it is; on a page
without article and good blocks the fair ones count as decided, or if there are
none the short ones.

Defined results: null and empty html give empty text. Malformed markup is read
as far as it goes: a tag that never ends is text, an open script runs to the
end of the page. Every page is one row; long pages are read whole. Columns may
have any names; one called like the text column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

# Common function words of the languages served.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were
    their one all we can her has there been if more when will would who so no she its out up into them than then some could
    der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
    le la les de des du un une et est en que qui dans pour pas au sur se ce il ne plus par avec son sa ses mais ou aux on nous
    vous ils elle elles leur été être cette ces sont comme tout fait si même où entre sans deux
    el los las del que y en un una por con para se no es su al lo como más pero sus le ya o este sí porque esta entre cuando muy
    sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos
    """.split()
)
# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
NEVER_TEXT = frozenset("head title nav footer aside form menu select option textarea button dialog label legend fieldset datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names in a class, id or role that mark what surrounds articles.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar aside widget menu nav navbar navigation navigationbar breadcrumb breadcrumbs masthead "
    "topbar toolbar comment comments commentlist discussion replies reply respond disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login search pagination pager skip legal copyright disclaimer complementary contentinfo".split()
)
# Names that count only as a whole or for the page, since articles have headers and footers too.
WHOLE_HINTS = frozenset("header footer form site-header site-footer page-header page-footer search-form page-form".split())
# Parts that make a name a state of the page, not a kind of element.
STATES = frozenset("has no is not with without open closed enabled disabled hidden layout page single type format status category tag post entry hentry main body content container wrapper".split())
ARTICLES = frozenset(("article", "main"))
# Elements that hold a text itself; controls that can stand in the middle of one.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote caption figcaption".split())
CONTROLS = frozenset(("button", "label"))
# Headings above what readers wrote, and sentences of notices on cookies.
_READERS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|kommentare|commentaires|comentarios)(?: \(?\d+\)?)?:?|(?:leave|post|add|write) a (?:comment|reply)|join the (?:discussion|conversation)", re.I)
_COOKIES = re.compile(r"\b(?:we|(?:this|our) (?:web ?)?site)(?: and (?:our|its) partners)? uses? cookies\b|\b(?:wir|diese (?:web)?seite) verwende[nt] cookies\b|\b(?:nous utilisons|ce site utilise) des cookies\b|\b(?:este sitio )?(?:utiliza|usa|utilizamos|usamos) cookies\b", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|math|canvas|audio|video)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Weights:
    """What speaks for a block and against it. ``density`` switches the stop-word rules off."""

    short: int = 70  # characters under which a block is ambiguous
    long: int = 200
    low: float = 0.15  # stop words among a block's words
    high: float = 0.25
    link_limit: float = 0.4
    density: bool = True
    dense: int = 2
    some: int = 1
    none: int = -1
    length: int = 1
    linked: int = -4
    linked_inside: int = -1  # in an article, where links are part of the text
    article: int = 1
    outside: int = -4  # not in the page's article, where it has one
    hint: int = -5
    text_hint: int = -3  # on the text's own element
    good_from: int = 3
    bad_to: int = -1


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(text)}


def _hidden(attributes: dict[str, str]) -> bool:
    if attributes.get("hidden", "false").lower() != "false":
        return True
    return attributes.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def _hinted(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a name of the element is one that marks what surrounds articles, or such words make up half of it."""
    given = ("class", "role", "aria-label") if tag in TEXT_TAGS else ("class", "id", "role", "aria-label")
    for name in " ".join(attributes.get(k, "") for k in given).split():
        if name.lower() in WHOLE_HINTS:
            return True
        parts = {p.lower() for p in _PARTS.split(name) if p}
        if 2 * len(parts & HINTS) >= len(parts) > 0 and not parts & STATES:
            return True
    return False


class _Block:
    __slots__ = ("parts", "linked", "heading", "barred", "hinted", "article")

    def __init__(self, heading: int, barred: bool, hinted: int, article: int):
        self.parts, self.linked, self.heading, self.barred, self.hinted, self.article = [], 0, heading, barred, hinted, article


def _blocks(html: str) -> list[tuple[str, float, int, bool, int, int]]:
    """(text, link density, level of the heading or 0, barred, hinted, number of its article or 0) in page order.

    Hinted is 2 by a name around the text, 1 by one of the text's own element.
    """
    out: list[tuple[str, float, int, bool, int, int]] = []
    stack: list[tuple[str, bool, int, int]] = []  # open block elements: name, barred, hinted, article
    articles = breaks = in_link = 0
    unseen: list[str] = []  # open inline elements from the first hidden one on
    block = _Block(0, False, 0, 0)
    readers: tuple[int, int] | None = None  # level and article of the heading above what readers wrote

    def flush() -> None:
        nonlocal block, breaks, readers
        text = " ".join(unescape("".join(block.parts)).split())
        if text:
            if readers and (block.article != readers[1] or 0 < block.heading <= readers[0]):
                readers = None
            if block.heading and not readers and _READERS.fullmatch(text):
                readers = (block.heading, block.article)
            named = 2 if readers or (not block.article and _COOKIES.search(text)) else block.hinted
            out.append((text, min(1.0, block.linked / len(text)), block.heading, block.barred, named, block.article))
        name, barred, hinted, article = stack[-1] if stack else ("", False, 0, 0)
        block = _Block(int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0, barred, hinted, article)
        breaks = 0

    def say(text: str) -> None:
        nonlocal breaks
        if text and not unseen:
            block.parts.append(text)
            if text.strip():
                breaks = 0
                if in_link:
                    block.linked += len(" ".join(unescape(text).split()))

    at = 0
    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            block.parts.append(" " if m["raw"] else "")
        elif tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks > 1:
                flush()
        elif (tag in BLOCK_TAGS or tag in NEVER_TEXT) and not (tag in CONTROLS and stack and stack[-1][0] in TEXT_TAGS):
            unseen.clear()
            if m["close"]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
            elif tag not in VOID_TAGS and not m["attrs"].endswith("/"):
                if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == tag:
                    stack.pop()
                if tag not in ("p", "li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == "p":
                    stack.pop()
                _, barred, hinted, article = stack[-1] if stack else ("", False, 0, 0)
                attributes = _attributes(m["attrs"]) if m["attrs"] and tag not in ("html", "body") else {}
                hint = (1 if tag in TEXT_TAGS else 2) * (tag != "main" and _hinted(tag, attributes))
                if tag in ARTICLES and not article and not hint:
                    articles += 1
                    article, hinted = articles, 0  # names around an article say nothing of it
                barred = barred or tag in NEVER_TEXT or (tag == "header" and not article) or _hidden(attributes)
                stack.append((tag, barred, max(hinted, hint), article))
            in_link = 0 if tag != "li" else in_link
            flush()
        elif tag not in VOID_TAGS:
            if unseen:
                if not m["close"]:
                    unseen.append(tag)
                elif tag in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
            elif not m["close"] and m["attrs"] and _hidden(_attributes(m["attrs"])):
                unseen.append(tag)
            if tag == "a":
                in_link = 0 if m["close"] else 1
    say(html[at:])
    flush()
    return out


GOOD, BAD, FAIR, SHORT = 1, 0, 2, 3


def _first_pass(block: tuple[str, float, int, bool, int, int], has_article: bool, w: Weights) -> int:
    """A block's label by its score, FAIR or SHORT if it is ambiguous."""
    text, links, _, barred, hinted, article = block
    if barred:
        return BAD
    score = w.article if article else w.outside * has_article
    score += (0, w.text_hint, w.hint)[hinted] + (w.linked_inside if article else w.linked) * (links > w.link_limit)
    if len(text) < w.short:
        return BAD if score <= w.bad_to else SHORT
    if w.density:
        words = _WORDS.findall(text.lower())
        density = sum(x in STOP_WORDS for x in words) / max(1, len(words))
        score += w.dense if density >= w.high else w.some if density >= w.low else w.none
    score += w.length * (len(text) > w.long)
    if score >= w.good_from:
        return GOOD
    return BAD if score <= w.bad_to else FAIR


def _second_pass(blocks: list, label: list[int]) -> list[int]:
    """Ambiguous blocks get the label of their nearest decided neighbours."""
    n, decided = len(blocks), list(label)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, int] = {}  # by article
        side = [BAD] * n
        for i in order:
            barred, hinted, article = blocks[i][3:]
            side[i] = last.get(article, GOOD if article else BAD)
            if label[i] in (GOOD, BAD):
                if article and not barred and not hinted:
                    last[article] = label[i]
                last[0] = label[i]
        sides.append(side)
    for i, (before, after) in enumerate(zip(*sides)):
        if label[i] in (FAIR, SHORT):
            heading, article = blocks[i][2], blocks[i][5]
            mixed = article or label[i] == FAIR or (heading and after == GOOD)
            decided[i] = before if before == after else GOOD if mixed else BAD
    return decided


def extract_main_text(html: str | None, weights: Weights = Weights()) -> str:
    """The article's blocks, joined by one line feed."""
    blocks = _blocks(html or "")
    has_article = any(b[5] and not b[3] for b in blocks)
    label = [_first_pass(b, has_article, weights) for b in blocks]
    if GOOD not in label and not has_article:
        best = FAIR if FAIR in label else SHORT
        label = [GOOD if x == best else x for x in label]
    label = _second_pass(blocks, label)
    return "\n".join(b[0] for b, kept in zip(blocks, label) if kept == GOOD)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the html) and the main text. A narrow pass."""
    names = [c for c in (keep if keep is not None else [c for c in pages.columns if c != html_col]) if c != text_col]
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField(text_col, T.StringType())])
    source = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*names, html_col])))

    def run(batches):
        for batch in slices(batches):
            texts = [extract_main_text(h) for h in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(texts, pa.string())], names=[*names, text_col])

    return in_batches(source, run, schema)
