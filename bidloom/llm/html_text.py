"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags, and each piece of text is judged by the elements that are open where it
stands. Scripts, styles, markup and everything inside menus, headers, footers, sidebars, notices, adverts, forms and
reader comments (by tag, role, or class and id) is boilerplate at once. A class or id says so by its last word, whatever names of
containers follow (site-footer, comments-area), not by a word that is denied, a state, or before another noun (has-sidebar,
modal-open, copyright-reform). A header, form, sidebar, banner and the like that holds most of the page's articles, or of
its text if it has none, is a wrapper and says nothing. In an article's own header the headings stay. Classes that main
text has as well (related, search, social) are only a hint. The first pass classes the other blocks by length, link density and
stop-word density as good, near-good, short, dull or bad; a hinted block is good or bad. In the second pass the short and
near-good blocks, which say too little alone, take the label of their nearest decided neighbours: good on both sides is
good, bad on both sides is bad; between good and bad a near-good block is good and a short one follows the nearer (the
page's ends count as bad). Headings that a good block follows closely are good. Dull blocks, long ones without stop words,
are bad.

An article or main element is a weight: inside it half the stop-word density is enough, a dull block or one of much linked text counts
as short, and the element's border counts as good inside and as bad outside. Where all this leaves nothing of a page, its near-good
blocks are the main text, or else those that no rule calls bad. Text and spaces are never dropped or cut within a good
block: references are decoded, white space becomes one space, blocks are joined by one line feed.

Stop words are function words of four languages, unless given; ``frequent_words`` counts a corpus's own in Spark. Null html
counts as empty and gives an empty text. Rows may repeat; null ids and urls pass through. Other columns are ignored. A
page takes time in proportion to its length, however its tags are nested or left open.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that begin and end blocks, tags whose content is no text, tags and words of boilerplate regions.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = ("noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video")
BAD_TAGS = frozenset("nav footer aside menu button select".split())
WRAPPING_TAGS = frozenset("header form dialog fieldset label".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login menu navbar navigation newsletter pagination replies respond shoutbox signup sponsor sponsored subscribe".split()
)
WRAPPING_WORDS = frozenset("banner masthead modal notice notices popup promo promoted sidebar sidebars toolbar".split())
HINT_WORDS = frozenset("form header nav pager recommended related reply search share sharing social widget".split())
LAST_HINTS = frozenset("nav pager recommended related share sharing social".split())
CONTAINER_WORDS = frozenset(
    "area bar block body bottom box button buttons col column container content first group head heading holder inner item items last left link links list main message outer panel policy primary right row secondary section slot text title top unit wrap wrapper".split()
)
DENIALS = frozenset("has no non not with without".split())
STATES = frozenset("active enabled fixed on open opened ready sticky visible".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WEIGHT = 0.5
ALL_LINKS = 0.9
LIST_TAGS = frozenset("li td th tr dd dt option".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>|</[^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    boilerplate: bool
    content: bool
    hint: bool = False


GOOD, HINT, BAD, WRAPPING, HEADER = range(5)


@functools.lru_cache(maxsize=10_000)
def _named(name: str) -> int:
    """What a class or id says: its last word before the names of containers."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or not DENIALS.isdisjoint(parts) or len(parts) > 1 and parts[-1] in STATES:
        return GOOD
    while len(parts) > 1 and (parts[-1] in CONTAINER_WORDS or parts[-1].isdigit() or len(parts[-1]) == 1):
        parts.pop()
    if parts[-1] in BAD_WORDS:
        return BAD
    if parts[-1] in WRAPPING_WORDS:
        return WRAPPING
    return HINT if parts[-1] in HINT_WORDS and (len(parts) == 1 or parts[-1] in LAST_HINTS) else GOOD


def _judged(tag: str, attributes: str) -> int:
    """What an element's tag and attributes say about the text in it."""
    if tag in BAD_TAGS:
        return BAD
    if tag in ("body", "html", "article", "main"):
        return GOOD
    found = WRAPPING if tag in WRAPPING_TAGS else GOOD
    if not attributes.strip():
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in BAD_ROLES:
            return BAD
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return BAD
        if name in ("class", "id"):
            said = {_named(x) for x in value.split()}
            if BAD in said:
                return BAD
            found = WRAPPING if WRAPPING in said else HINT if HINT in said and found == GOOD else found
    return found


class _Open:
    """The open elements. Each takes and returns its place in constant time on the whole."""

    def __init__(self):
        self.stack: list[list] = []  # tag, judgement, whether content
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements
        self.judged = [0, 0, 0, 0, 0]
        self.content = 0
        self.left = None  # called with the wrapper of an element that ends

    def push(self, tag: str, judged: int, wrapper: int = -1) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append([tag, judged, tag in CONTENT_TAGS, wrapper])
        self.judged[judged] += 1
        self.content += tag in CONTENT_TAGS

    def _release(self, entry: list) -> None:
        self.judged[entry[1]] -= 1
        self.content -= entry[2]
        if entry[3] >= 0 and self.left is not None:
            self.left(entry[3])

    def _pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            entry = self.stack.pop()
            if entry[0]:
                self.places[entry[0]].pop()
                self._release(entry)
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def open_block(self, tag: str) -> None:
        """A block ends an open paragraph, and a list item or cell the one before it."""
        if self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self._pop_to(self.blocks[-1])
        if tag in LIST_TAGS and self.blocks and self.stack[self.blocks[-1]][0] == tag:
            self._pop_to(self.blocks[-1])

    def close(self, tag: str) -> None:
        """An end tag closes all up to its element; one of an inline element that blocks lie over ends that one alone."""
        if not (places := self.places.get(tag)):
            return
        if tag in BLOCK_TAGS or not self.blocks or places[-1] > self.blocks[-1]:
            self._pop_to(places[-1])
        else:
            entry = self.stack[places.pop()]
            self._release(entry)
            entry[0] = ""


def _tokens(page: str):
    """(text, None) and (None, tag token) in order; raw elements that end are left out whole."""
    at, last = 0, page.rfind(">")
    endless: set[str] = set()
    while True:
        stop = page.find("<", at)
        if stop < 0:
            stop = len(page)
        if stop > at:
            yield page[at:stop], None
        if stop == len(page):
            return
        token = _TOKEN.match(page, stop) if stop < last or page.startswith("<!--", stop) else None
        if token is None:
            if stop > last and page[stop + 1 : stop + 2] in ("!", "?", "/") or stop > last and page[stop + 1 : stop + 2].isalpha():
                return  # a tag that doesn't end
            yield "<", None
            at = stop + 1
            continue
        at = token.end()
        tag = (token[3] or "").lower()
        if tag in RAW_TAGS and not token[2] and tag not in endless:
            end = _RAW_ENDS[tag].search(page, at)
            if end is None:
                endless.add(tag)  # of this tag no element ends any more
            else:
                at = end.end()
                continue
        if tag:
            yield None, token


_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}


def _read(page: str, verdicts: list[int] | None) -> tuple[list[Block], list[tuple[int, int]], int, int]:
    """A page's blocks; of each possible wrapper how much text and how much of an article it holds, and of the page.

    Without ``verdicts`` wrappers count as good; with them each is what its verdict says.
    """
    out: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    refused: list[str] = []  # pieces of the block that are boilerplate
    linked, heading, hint, content = 0, False, False, False
    size = article = 0  # text so far, and that in articles
    wrappers: list[tuple[int, int]] = []

    def left(k: int) -> None:
        wrappers[k] = size - wrappers[k][0], article - wrappers[k][1]

    opened.left = left

    def text_of(parts: list[str]) -> str:
        return _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()

    def flush() -> None:
        nonlocal linked, hint, content
        if text := text_of(pieces):
            out.append(Block(text, linked, heading, False, content, hint))
        elif text := text_of(refused):
            out.append(Block(text, 0, heading, True, content))
        pieces.clear()
        refused.clear()
        linked, hint, content = 0, False, False

    for text, token in _tokens(page):
        if token is None:
            content = content or opened.content > 0
            if opened.judged[BAD] or opened.judged[HEADER] and not heading:
                refused.append(text)
                continue
            pieces.append(text)
            if not text.isspace():
                hint = hint or opened.judged[HINT] > 0
                linked += len(text) if opened.places.get("a") else 0
                size += len(text)
                article += len(text) if opened.content else 0
            continue
        tag, closing = token[3].lower(), bool(token[2])
        if tag in BLOCK_TAGS:
            flush()
            if tag[0] == "h" and tag[1:].isdigit():
                heading = not closing
        if tag in VOID_TAGS or not closing and token[4].endswith("/"):
            continue
        if closing:
            opened.close(tag)
            continue
        if tag in BLOCK_TAGS:
            opened.open_block(tag)
        elif tag == "a":
            opened.close("a")
        judged, wrapper = _judged(tag, token[4]), -1
        if judged == WRAPPING and tag == "header" and opened.content:
            judged = HEADER
        elif judged == WRAPPING:
            wrapper = len(wrappers)
            wrappers.append((size, article))
            judged = GOOD if verdicts is None else verdicts[wrapper]
        opened.push(tag, judged, wrapper)
    flush()
    opened._pop_to(0)
    return out, wrappers, size, article


def blocks(page: str) -> list[Block]:
    """A page's blocks in order; unclosed and stray tags are taken as browsers take them, as far as blocks go."""
    out, wrappers, size, article = _read(page, None)
    if not wrappers:
        return out
    most = [2 * inner > article if article else 2 * own > size for own, inner in wrappers]
    return _read(page, [GOOD if m else BAD for m in most])[0]


def classify(found: list[Block], stop_words: frozenset[str], short: int = 70, long: int = 200, link_density: float = 0.2, low: float = 0.3, high: float = 0.32) -> list[bool]:
    """Whether each block is main text."""
    kinds: list[str] = []
    for b in found:
        words = _WORDS.findall(b.text.lower())
        stop = sum(w in stop_words for w in words) / len(words) if words else 0.0
        density = b.linked / max(len(b.text), 1)
        weight = CONTENT_WEIGHT if b.content else 1.0
        if b.boilerplate or density > (ALL_LINKS if b.content else link_density):
            kind = "bad"
        elif b.hint:
            kind = "good" if len(b.text) > long and stop >= high else "bad"
        elif len(b.text) < short or density > link_density:
            kind = "short"
        elif stop >= high * weight:
            kind = "good" if len(b.text) > long else "near"
        elif stop >= low * weight:
            kind = "near"
        else:
            kind = "short" if b.content else "dull"
        kinds.append(kind)
    # Second pass: kind and distance of the nearest decided block on either side.
    n = len(kinds)
    before, after = _nearest(found, kinds, range(n)), _nearest(found, kinds, range(n - 1, -1, -1))
    out = []
    for i, (b, kind) in enumerate(zip(found, kinds, strict=True)):
        if kind in ("good", "bad", "dull"):
            out.append(kind == "good")
            continue
        (a, da), (c, dc) = before[i], after[i]
        if a == c:
            out.append(a == "good")
        elif kind == "near":
            out.append(True)
        elif b.heading:
            out.append(c == "good")
        else:
            out.append((a if da <= dc else c) == "good")
    for left in (("near",), ("short", "dull")):  # a page without a good block
        if not any(out):
            out = [k in left for k in kinds]
    return out


def _nearest(found: list[Block], kinds: list[str], order: range) -> list[tuple[str, int]]:
    """Kind and distance of the nearest decided block before each block in ``order``."""
    out = [("bad", 0)] * len(found)
    last, at, content = "bad", order.start - order.step, False
    for i in order:
        b = found[i]
        if b.content != content:  # the border of an article counts as good inside and as bad outside
            last, at, content = "good" if b.content else "bad", i - order.step, b.content
        out[i] = (last, abs(i - at))
        # Boilerplate inside an article says nothing about the text around it.
        aside = b.content and (b.boilerplate or b.hint and kinds[i] == "bad")
        if kinds[i] in ("good", "bad", "dull") and not aside:
            last, at = "good" if kinds[i] == "good" else "bad", i
    return out


def main_text(page: str | None, stop_words: frozenset[str]) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, classify(found, stop_words), strict=True) if good)


def frequent_words(pages: DataFrame, count: int = 150, html_col: str = "html") -> list[str]:
    """The words with the most occurrences in all pages' blocks that are no boilerplate region."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            counts: Counter[str] = Counter()
            for page in batch.column(0).to_pylist():
                for b in blocks(page or ""):
                    if not b.boilerplate:
                        counts.update(_WORDS.findall(b.text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    totals = pages.select(F.col(html_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in totals.orderBy(F.desc("n"), "word").limit(count).collect()]  # bounded by ``count``


# Function words of four languages.
STOP_WORDS = (
    "the of and to in a is it that for was with as be by on are this from at or an not have has had but they which you we he she his her their there been if when will would who what can all were its so do "
    "der die das und ist von zu den mit im ein eine nicht auf für als auch dem des sich es bei aus nach wird an um am sind noch wie einer er ich wir ihr hat war oder aber nur "
    "le la les de du et un une en est que qui dans pour pas par sur au avec ce il se sont plus ou aux elle nous vous mais ne je on son sa ses cette ces "
    "el los las y del por con no para su al lo como más o pero sus este esta ya si cuando muy sin sobre ser también hay"
).split()


@functools.cache
def _stop(words: tuple[str, ...]) -> frozenset[str]:
    return frozenset(words)


def extract(pages: DataFrame, stop_words: list[str] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    words = tuple(STOP_WORDS if stop_words is None else stop_words)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, _stop(words)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
