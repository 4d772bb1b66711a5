"""Main text of web pages by two passes of block rules.

The first pass judges each block alone: by the region it stands in, its link density,
its length and its share of stop words.  Blocks too short (or too odd) to judge stay
open, and the second pass gives them the label of the nearest decided neighbours in
their region.  Stop words are those of four languages; prose without them stays open too,
and on a page where they find no text, length and link density alone decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.blocks import lean, put_columns, slices, with_columns

# Element names, and words of class, id and role that name a page's furniture.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("head script style noscript template svg math iframe object nav menu aside footer form button select textarea search dialog audio video canvas".split())
PAGE_ONLY = frozenset("header".split())
MAIN = frozenset("article main".split())
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu menubar nav navbar navigation topnav subnav breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog share sharing social related recommended comment comments commentlist disqus respond reply replies "
    "subscribe subscription newsletter signup login signin search toolbar pagination pager skip skiplink complementary contentinfo form".split()
)
FURNITURE_PAGE_ONLY = frozenset("header".split())
# Last parts of a name that tell a state, and of names about search that tell a text.
STATES = frozenset("active allowed closed count counts disabled enabled off on open ready support supported".split())
FOUND = frozenset("article page result results".split())
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do does each for from had has have he her his how i if in into is it its just like may more most my no not of on one or other our out over she so some such than that the their them then there these they this to under up was we were what when where which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tout un une vous y "
    "aber als am auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer es für hat ich ihr im ist ja mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur "
    "al asi como con del desde donde el ella ellos era eran este esta esto fue ha hay la las lo los más me mi muy nos o para pero por porque que se si sin sobre su sus también te tiene todo una uno y ya".split()
)

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.3
LINKS = 0.4
#: Share of letters and digits among the characters of prose.
LETTERS = 0.8
#: So many times the text of marked articles must stand elsewhere for them to be teasers.
REST = 3
GOOD, BAD, OPEN = 1, -1, 0

_NAMES = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names_furniture(name: str, region: int) -> bool:
    """Whether a class, id or role names furniture: by its last part, or by its first unless a state follows."""
    parts = [x for x in _NAMES.split(name) if x and not x.isdigit()]
    if not parts:
        return False
    first, last = parts[0], parts[-1]
    if last in FURNITURE or not region and FURNITURE_PAGE_ONLY & {first, last}:
        return True
    return first in FURNITURE and last not in STATES and not (first == "search" and last in FOUND)


class _Block:
    __slots__ = ("text", "linked", "outside", "region", "heading")

    def __init__(self, text: str, linked: int, outside: bool, region: int, heading: bool):
        self.text, self.linked, self.outside, self.region, self.heading = text, linked, outside, region, heading


class _Blocks(HTMLParser):
    """Cuts a page into blocks, each with the region it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.open: list[tuple[str, bool, int]] = []  # element, outside the article, region
        self.parts: list[str] = []
        self.linked = self.links = self.breaks = self.regions = 0
        self.depth: Counter[str] = Counter()  # open elements of each name

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, outside, region = self.open[-1] if self.open else ("", False, 0)
            self.blocks.append(_Block(text, self.linked, outside, region, any(t[0] in "h1h2h3h4h5h6" for t in self.open[-3:])))
        self.parts, self.linked, self.breaks = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self._end_block()
            return
        if tag in BLOCK or tag in OUTSIDE:
            self._end_block()
        if tag in VOID:
            return
        if tag == "p" or tag == "li":  # their end tags may be left out
            self._close_open(tag)
        _, outside, region = self.open[-1] if self.open else ("", False, 0)
        if not outside:
            outside = tag in OUTSIDE or tag in PAGE_ONLY and not region or self._furniture(attrs, region, tag)
            if tag in MAIN and not outside:
                if not region or tag == "article":
                    self.regions += 1
                    region = self.regions
        if tag == "a":
            self.links += 1
        self.open.append((tag, outside, region))
        self.depth[tag] += 1

    handle_startendtag = handle_starttag

    def _close_open(self, tag: str) -> None:
        if not self.depth[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop_to(i)
                return
            if self.open[i][0] in BLOCK:
                return

    @staticmethod
    def _furniture(attrs: list[tuple[str, str | None]], region: int, tag: str) -> bool:
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id", "role", "aria-label"):
                if tag in ("html", "body"):
                    continue
                # An article's own names tell its kind or state, not that it is furniture.
                if tag not in MAIN and any(_names_furniture(x, region) for x in value.split()):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if not self.depth[tag]:  # a stray end: nothing to look for
            if tag == "p":
                self._end_block()
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCK or tag in OUTSIDE or any(t in BLOCK for t, _, _ in self.open[i:]):
                    self._end_block()
                self._pop_to(i)
                return

    def _pop_to(self, i: int) -> None:
        for t, _, _ in self.open[i:]:
            self.links -= t == "a"
            self.depth[t] -= 1
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        if not data.isspace():
            self.breaks = 0
        if self.links:
            self.linked += len("".join(data.split()))

    def finish(self) -> list[_Block]:
        self.close()
        self._end_block()
        return self.blocks


def _alone(b: _Block) -> int:
    """The first pass: a block's label from itself."""
    if b.outside:
        return BAD
    if b.linked > LINKS * len(b.text.replace(" ", "")):
        return OPEN if b.region else BAD
    words = [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in b.text.split()) if w]
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if len(b.text) < SHORT:
        return OPEN
    if density >= STOP_HIGH or density >= STOP_LOW and (b.region or len(b.text) >= LONG):
        return GOOD
    if b.region or density >= STOP_LOW or b.heading:
        return OPEN
    return OPEN if _prose(b.text) else BAD


def _prose(text: str) -> bool:
    """Whether a text is mostly letters and digits, of whatever language."""
    solid = [c for c in text if not c.isspace()]
    return sum(unicodedata.category(c)[0] in "LMN" for c in solid) >= LETTERS * len(solid)


def _by_length(b: _Block) -> int:
    """The label of a block of a page on which no stop list fits: long prose is text."""
    if b.outside or b.region or b.heading or b.linked > LINKS * len(b.text.replace(" ", "")):
        return OPEN
    wide = sum(unicodedata.east_asian_width(c) in "WF" for c in b.text)
    return GOOD if len(b.text) + 2 * wide >= SHORT and _prose(b.text) else OPEN


def _settle(blocks: list[_Block], labels: list[int]) -> list[int]:
    """The second pass: open blocks take the label of their nearest decided neighbours.

    Neighbours are those of the same region.  Two that differ leave it to the nearer one,
    a heading to the one that follows.  A region of the article without a decided block
    is text; outside of such regions it is not.
    """
    out = list(labels)
    n = len(blocks)
    before: list[int] = [-1] * n
    after: list[int] = [-1] * n
    last: dict[int, int] = {}
    for i in range(n):
        before[i] = last.get(blocks[i].region, -1)
        if labels[i] != OPEN and not (blocks[i].outside and blocks[i].region):
            last[blocks[i].region] = i
    last = {}
    for i in range(n - 1, -1, -1):
        after[i] = last.get(blocks[i].region, -1)
        if labels[i] != OPEN and not (blocks[i].outside and blocks[i].region):
            last[blocks[i].region] = i
    for i in range(n):
        if labels[i] != OPEN:
            continue
        a, z, inside = before[i], after[i], blocks[i].region > 0
        if a < 0 and z < 0:
            out[i] = GOOD if inside else BAD
        elif a < 0 or z < 0:
            out[i] = labels[max(a, z)]
        elif labels[a] == labels[z]:
            out[i] = labels[a]
        elif inside:
            out[i] = GOOD
        else:
            out[i] = labels[z] if blocks[i].heading or z - i < i - a else labels[a]
    return out


def main_text(html: str) -> str:
    """The article of a page: its blocks in order, joined by one newline."""
    parser = _Blocks()
    parser.feed(html)
    blocks = parser.finish()
    marked = sum(len(b.text) for b in blocks if b.region and not b.outside)
    rest = sum(len(b.text) for b in blocks if not b.region and _alone(b) == GOOD)
    if marked and rest <= REST * marked:
        # A page that marks its article has no text elsewhere.
        for b in blocks:
            b.outside = b.outside or not b.region
    labels = [_alone(b) for b in blocks]
    if GOOD not in labels:
        labels = [_by_length(b) if label == OPEN else label for b, label in zip(blocks, labels, strict=True)]
    labels = _settle(blocks, labels)
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars`` (its code points).

    A null or empty page has the empty text.  Broken mark-up is read as far as it goes:
    missing end tags close with their parent, stray ones are ignored, and an element cut
    off at the end of the page keeps what came before.  Pages are independent: repeated
    rows get equal texts, an empty table gives an empty table, and input columns named
    like a result are replaced.
    """
    schema = with_columns(pages.schema, "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, html_col)):
            texts = [main_text(h) if h else "" for h in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            yield put_columns(batch, schema, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.mapInArrow(lean(run), schema)
