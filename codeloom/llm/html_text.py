"""Operator 8: main text of web pages by two-pass block rules.

A tolerant scanner splits a page into blocks at block-level tags and notes, for
each, its words, the share of stop words, the share of its characters inside
links, whether it stands inside an article, and whether one of its ancestors is
page furniture (menus, headers, footers, sidebars, forms, adverts, notices,
reader comments, known by tag, role, class or id).

First pass: furniture is bad; outside articles, blocks dense in links are bad and long
blocks are good if dense in stop words; inside an article long blocks are good, and
blocks dense in links are undecided (a paragraph may be one link); short blocks stay
undecided. Second pass: an undecided block takes the label of its nearest decided
neighbours within the same container (ties and mixed neighbours: good inside an
article, bad outside); with none, it is good inside an article and bad outside.
Where a page has an article with any text, what lies outside every article is bad.

Articles are chosen by their text: one with less than ``least_share`` of the words of the
page's longest is a teaser and bad, and so is one named as a teaser or card, unless the page
has no other text. Where text outside (``least_outside`` words or more in good blocks)
outweighs every article so far, the page is read as one without articles.

A form is furniture unless it is the page's own: one that holds an article, or unlinked prose
of ``form_words`` words, or that no end tag closes. Inside an article, a box of a
doubtful name ("related", "widget") is furniture unless it holds unlinked prose of
``min_words`` words. A name such as "header" in a class or id marks furniture outside articles only:
inside, it is the headline's box. Of a <header> element inside an article the headings and
what lies in no block of its own are text.

A tag ends at the first > outside a quoted value; a value is quoted only right after its =,
and only if the quote is closed on the page. Any other quote is a character of a name or value.

Defined cases: null or empty html gives an empty text; cut-off pages are read as
far as they go (an unfinished tag is dropped, open elements end with the page);
very long pages are scanned in one linear pass, however deep they nest and whatever
end tags they lack or have too many; repeated rows get equal texts; ids and urls may
be null; an empty table gives no rows; columns besides id, url and html are not read,
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked

# Fixed values of the HTML standard: elements that start a block, elements without content, elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe select button noframes xmp".split())
FURNITURE = frozenset("nav footer aside menu dialog head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART = r"(?:^|[\s_-])(?:{})(?=$|[\s_-])"
_FIRM = (
    r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"side-?bar|menus?|nav\w*|breadcrumbs?|pagination|pager|footer|toolbar|comments?|commentlist|disqus|replies|respond|share|sharing|social"
)
_DOUBTFUL = r"alerts?|related|recommend\w*|widgets?"
_NAMES = re.compile(_PART.format(f"{_FIRM}|{_DOUBTFUL}"), re.I)
_FIRM_NAMES = re.compile(_PART.format(_FIRM) + r"|(?:^|\s)alerts?(?=$|\s)", re.I)
_DOUBTFUL_NAMES = re.compile(rf"(?:^|\s)(?:{_DOUBTFUL})(?:[_-](?:posts?|articles?|stories|links?|items?|news|content|topics|reading|box|bar|area|list|block|container|wrapper))*(?=$|\s)", re.I)
_TEASERS = re.compile(_PART.format(r"teasers?|cards?|previews?|related|recommend\w*|promo\w*|sponsor\w*|ads?|advert\w*|comments?"), re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)  # furniture outside articles
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "als am auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von zu "
    "au aux ce dans de des du elle en est et il la le les mais ne on ou par pas pour qui que se son sur un une "
    "al como con de del el en es la las lo los más mi no o para pero por que se su sus un una y".split()
)
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>][^\s>]*+)"
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"  # the first character may be any
_ATTRIBUTES = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE}?+)?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+")
_ENDS = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case, the first of each name."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
        out.setdefault(name.lower(), value[1:-1] if quoted else value)
    return out


def names_of(given: dict[str, str]) -> list[str]:
    return [given[k] for k in ("class", "id") if k in given]


def is_furniture(tag: str, given: dict[str, str], inside: bool) -> bool:
    """Whether an element is furniture whatever it holds."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not given or tag in ("article", "main", "body", "html", "form"):
        return False
    if any((_FIRM_NAMES if inside else _NAMES).search(n) or not inside and _HEADER.search(n) for n in names_of(given)):
        return True
    return given.get("role", "").lower() in _ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))


class Open(NamedTuple):
    """An open element; blocks counts the block elements among those open up to it, headers those of articles."""

    tag: str
    bad: bool
    box: int
    inside: bool
    unit: int
    doubt: int
    blocks: int
    headers: int


class Block(NamedTuple):
    """A block with text: characters of it inside links, its container, whether it is furniture, its unit (0: outside articles) and the innermost doubtful box around it."""

    text: str
    linked: int
    box: int
    bad: bool
    unit: int
    doubt: int


class Page(NamedTuple):
    blocks: list[Block]
    units: list[str]  # "" (outside), "article", "main" or "teaser"
    doubts: list[tuple[int, bool]]  # of each box that may be furniture: the one around it, and whether it is, by what it holds


class Stack:
    """Open elements, with the places of each tag and of the blocks, so that no look-up walks down the stack."""

    def __init__(self):
        self.open = [Open("", False, 0, False, 0, 0, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    @property
    def top(self) -> Open:
        return self.open[-1]

    def push(self, tag: str, bad: bool, box: int, inside: bool, unit: int, doubt: int) -> None:
        block = tag in BLOCKS
        self.places.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.open.append(Open(tag, bad, box, inside, unit, doubt, self.top.blocks + block, self.top.headers + (tag == "header" and inside)))

    def close(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """Place of the last open element of that tag, 0 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def begin(self, tag: str) -> None:
        """What a start tag ends: a block that cannot hold it, with the inline elements in that."""
        while tag in _ENDS.get(self.open[self.blocks[-1]].tag, ()):
            self.close(self.blocks[-1])

    def end(self, tag: str) -> None:
        """An end tag: it closes its element unless blocks (for p and inline elements) or an article lie between."""
        at = self.last(tag)
        if not at or (tag == "p" or tag not in BLOCKS) and self.top.blocks > self.open[at].blocks:
            return
        if self.last("article") > at and tag not in ("body", "html", "main"):
            return
        self.close(at)


def scanned(page: str, min_words: int, max_link_density: float, form_words: int) -> Page:
    """The page's blocks, its articles and its doubtful boxes."""
    out: list[Block] = []
    stack, containers = Stack(), 0
    units = [""]
    forms: set[int] = set()
    ended: set[int] = set()  # forms that an end tag closes
    prose: dict[int, int] = {}  # the longest unlinked block of each doubtful box, in words
    around, needs, holds = [0], [0], [False]  # of each doubtful box: the one around it, the words of prose that clear it, whether it is cleared
    parts: list[str] = []
    linked: list[str] = []
    plain = lambda parts: " ".join(entities.unescape("".join(parts)).split())

    def flush() -> None:
        if parts and (text := plain(parts)):
            top = stack.top
            block = Block(text, len(plain(linked)), top.box, top.bad, top.unit, top.doubt)
            out.append(block)
            if top.doubt and not top.bad and block.linked <= max_link_density * len(text):
                words = text.count(" ") + 1
                prose[top.doubt] = max(prose.get(top.doubt, 0), words)
        parts.clear()
        linked.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if m is None and (cut := re.search(r"<[a-zA-Z/!?][^<>]*\Z", text)):
            text = text[: cut.start()]
        if text:
            parts.append(text)
            if stack.places.get("a"):
                linked.append(text)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[4] != ">":
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            place = stack.last("form") if tag == "form" else 0
            closed = stack.open[place].doubt if place else 0
            before = len(stack.open)
            stack.end(tag)
            if closed and len(stack.open) < before:
                ended.add(closed)
            continue
        if tag in RAW:
            parts.append(" ")
            end = re.compile(rf"</{tag}(?![\w-])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            stack.begin(tag)
        elif tag == "a":
            stack.end("a")
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        given = attributes(m[3])
        top = stack.top
        bad, box, inside, unit, doubt = top.bad, top.box, top.inside, top.unit, top.doubt
        if tag in ("article", "main"):
            containers += 1
            box, inside = containers, True
            holds[doubt] = holds[doubt] or doubt in forms  # a form around an article is the page's own
            teaser = tag == "article" and any(_TEASERS.search(n) for n in names_of(given))
            if units[unit] in ("", "main"):
                units.append("teaser" if teaser else tag)
                unit = len(units) - 1
            elif teaser:
                bad = True  # a card inside an article
        bad = bad or is_furniture(tag, given, inside)
        if top.headers and tag in BLOCKS - HEADINGS - {"hgroup", "div", "section"}:
            bad = True  # of a header inside an article only the headline is text
        if tag == "form" or inside and tag not in ("article", "main") and any(_DOUBTFUL_NAMES.search(n) for n in names_of(given)):
            around.append(doubt)
            needs.append(form_words if tag == "form" else min_words)
            holds.append(False)
            doubt = len(around) - 1
            if tag == "form":
                forms.add(doubt)
        stack.push(tag, bad, box, inside, unit, doubt)
    flush()
    for k in range(len(around) - 1, 0, -1):  # what a box holds, those around it hold as well
        holds[k] = holds[k] or prose.get(k, 0) >= needs[k]
        up = around[k]
        prose[up] = max(prose.get(up, 0), prose.get(k, 0))
        if holds[k] and k in forms and up in forms:
            holds[up] = True
    verdicts = [(around[k], k > 0 and not holds[k] and not (k in forms and k not in ended)) for k in range(len(around))]
    return Page(out, units, verdicts)


def main_text(page: str | None, min_words=10, max_link_density=0.5, min_stop_density=0.08, form_words=25, least_share=0.3, least_outside=50) -> str:
    """The page's main text, blocks joined by newlines."""
    blocks, units, doubts = scanned(page or "", min_words, max_link_density, form_words)
    furniture = [False] * len(doubts)
    for k in range(1, len(doubts)):
        furniture[k] = doubts[k][1] or furniture[doubts[k][0]]
    bad = [b.bad or furniture[b.doubt] for b in blocks]
    dense = [b.linked > max_link_density * len(b.text) for b in blocks]
    prose = lambda words: len(words) >= min_words and sum(w.lower().strip(".,;:!?") in STOP_WORDS for w in words) >= min_stop_density * len(words)
    words = [b.text.split() for b in blocks]

    weight, some = [0] * len(units), [False] * len(units)
    for b, w, gone, links in zip(blocks, words, bad, dense, strict=True):
        if not gone:
            some[b.unit] = True
            if not links and (b.unit or prose(w)):
                weight[b.unit] += len(w)
    real = [u for u in range(1, len(units)) if units[u] != "teaser" and some[u]]
    if not real and not weight[0]:
        real = [u for u in range(1, len(units)) if some[u]]  # nothing but teasers
    longest = max((weight[u] for u in real), default=0)
    if weight[0] >= least_outside and longest < least_share * weight[0]:
        real = []
    chosen = {u for u in real if units[u] == "main" or weight[u] >= least_share * longest}

    labels: list[bool | None] = []
    for b, w, gone, links in zip(blocks, words, bad, dense, strict=True):
        if gone or (b.unit not in chosen if chosen or b.unit else links):
            labels.append(False)
        elif len(w) >= min_words and not links:
            labels.append(True if b.unit else prose(w))
        else:
            labels.append(None)
    before: list[tuple[int, bool] | None] = [None] * len(blocks)
    after = list(before)
    for seen, order in ((before, range(len(blocks))), (after, range(len(blocks) - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for k in order:
            box = blocks[k].box
            seen[k] = last.get(box)
            if labels[k] is not None and not bad[k]:
                last[box] = (k, labels[k])
    kept = []
    for k, b in enumerate(blocks):
        label = labels[k]
        if label is None:
            near = [x for x in (before[k], after[k]) if x]
            closest = min((abs(x[0] - k) for x in near), default=0)
            votes = {x[1] for x in near if abs(x[0] - k) == closest}
            label = votes.pop() if len(votes) == 1 else b.unit > 0
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", **rules) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), **rules) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).withColumns({"page_id": F.col("page_id").cast("long"), "url": F.col("url").cast("string")})
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
