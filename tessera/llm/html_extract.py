"""Main-text extraction from HTML by line-block distribution.

Markup is stripped to lines (one per block element): scripts, styles, forms and containers that their
tag, role or class names as boilerplate give no line. The text lengths of the other
lines are summed over a sliding window of lines, with no weight for lines of links and, where an
explicit article holds most of the text, for lines outside it. Where the sum rises
over a threshold (a share of its peak on short pages) the text surges; where it falls to nothing it
dives. The lines from a surge to the next dive are kept, but for those without weight that are
links alone or outside the article; a heading shortly before a surge belongs to it,
and in an article so do all lines since the last dive.

Defined results: null or empty html gives an empty text; truncated pages and
unclosed tags are read as far as they go; repeated rows give repeated rows;
other columns are not read. Work is linear in the page's length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Sliding window in lines, the window sum (characters) at which text surges, and the share of the peak that will do.
WINDOW = 3
SURGE = 80
PEAK_SHARE = 0.25
MAX_LINK_SHARE = 0.5

# Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video select button head title".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class names and ids: those that name boilerplate in any compound, those that do alone or with a place or shape
# ("share-buttons", not "share-price"), those places and shapes, and the parts of an article that may have a header.
ALWAYS_BOILER = frozenset("nav navbar navigation menubar masthead footer sidebar advert adverts advertisement advertising adslot comments disqus newsletter breadcrumb breadcrumbs pagination".split())
OFTEN_BOILER = frozenset(
    "menu header aside ad ads sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert comment respond replies reply share sharing social related recommended recommendations subscribe signup login search popup modal overlay toolbar pager widget copyright disclaimer".split()
)
NEUTRAL = frozenset(
    "a an and article articles bar blog body block bottom box btn button buttons center col column container content entry field fixed floating form full global group icon icons info inner input item items large left level link links list main message mobile my news off one outer page panel policy post posts primary privacy reader region right row secondary section site slot small space static sticky stories story text the title top two unit us user users warning wide wrap wrapper".split()
)
ARTICLE_PARTS = frozenset("article blog content entry news post section story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: A tag with a quote that nothing closes.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


def _names_boiler(value: str) -> bool:
    """Whether a class attribute or id names boilerplate."""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name) if len(w) > 1}
        if words & ALWAYS_BOILER:
            return True
        if words & OFTEN_BOILER and words <= OFTEN_BOILER | NEUTRAL and not ("header" in words and words & ARTICLE_PARTS):
            return True
    return False


def _boiler(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role" and value.lower() in BOILER_ROLES:
            return True
        if name in ("class", "id") and _names_boiler(value):
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
    return False


class Line:
    """Text of one block; ``links``: characters of link text; ``bare``: all its words are links; ``article``: it stands in one."""

    __slots__ = ("text", "links", "bare", "article", "heading")

    def __init__(self, text: str, links: str, article: bool, heading: bool) -> None:
        self.text, self.links, self.article, self.heading = text, len(links), article, heading
        self.bare = bool(links) and sum(map(str.isalnum, links)) >= sum(map(str.isalnum, text))


ARTICLE, BOILER = "article", "boiler"


def to_lines(page: str) -> list[Line]:
    """The blocks outside boilerplate in order, character references decoded, white space folded."""
    lines: list[Line] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, str]] = []  # open block elements with the zone inside
    opened: Counter[str] = Counter()  # how often each tag is in the stack
    unended: set[str] = set()  # raw elements that nothing further ends
    zone, in_link, at, n = "", 0, 0, len(page)
    last_end = page.rfind(">")

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split()) if zone != BOILER else ""
            if text:
                lines.append(Line(text, " ".join(html_lib.unescape("".join(links)).split()), zone == ARTICLE, bool(stack) and stack[-1][0] in HEADINGS))
            parts.clear()
            links.clear()

    def pop() -> str:
        opened[stack.pop()[0]] -= 1
        return stack[-1][1] if stack else ""

    while at < n:
        lt = page.find("<", at)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        if lt >= 0 and not m and lt < last_end:
            m = _BROKEN.match(page, lt)
        if lt < 0 or (not m and lt > last_end and page[lt + 1 : lt + 2].isalpha()):
            end = n  # no tag ends from here on
        else:
            end = lt if m else lt + 1  # a lone < is text
        if end > at:
            parts.append(page[at:end])
            if in_link:
                links.append(page[at:end])
        if not m:
            at = end
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                if tag == "head":
                    continue  # its own raw children are skipped one by one
                stop = None if tag in unended else _RAW_END[tag].search(page, at)
                if not stop:
                    unended.add(tag)
                at = stop.end() if stop else n if tag in ("script", "style") else at
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        boiler = not closing and tag not in VOID and _boiler(tag, attrs, zone == ARTICLE)
        # inline elements count where they are boilerplate, and where they end such a one
        if tag not in BLOCK and not boiler and not (closing and opened[tag]):
            continue
        flush()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                zone = pop()
            in_link = 0
        elif tag not in VOID:
            # p and li close an open one of their own kind
            if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
                zone = pop()
                boiler = _boiler(tag, attrs, zone == ARTICLE)
            if tag in ("article", "main"):
                # the first one stands even in boilerplate that is not closed
                inside = ARTICLE if zone != BOILER or not (opened["article"] or opened["main"]) else zone
            else:
                inside = BOILER if zone == BOILER or boiler else zone
            stack.append((tag, inside))
            opened[tag] += 1
            zone = inside
    flush()
    return lines


def window_sums(weights: list[int], window: int) -> list[int]:
    """At each line the sum of the weights of the ``window`` lines that start there."""
    out, total = [], sum(weights[:window])
    for i in range(len(weights)):
        out.append(total)
        total += (weights[i + window] if i + window < len(weights) else 0) - weights[i]
    return out


def stretches(lines: list[Line], weights: list[int], sums: list[int], surge: float) -> list[tuple[int, int]]:
    """Line ranges from a surge of the window sums to the next dive, with what belongs before the surge."""
    found, start, dive = [], -1, 0  # dive: the first line since the last dive
    for i, total in enumerate(sums):
        if total == 0:
            if start >= 0:
                found.append((start, i))
            start, dive = -1, i + 1
        elif start < 0 and weights[i] and total >= surge:
            start = i
            for k in range(dive, i):
                if weights[k] and (lines[k].heading or lines[k].article):
                    start = k
                    break
    if start >= 0:
        found.append((start, len(sums)))
    return found


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page."""
    lines = to_lines(page or "")
    plain = [x.links <= MAX_LINK_SHARE * len(x.text) for x in lines]
    # a teaser in an article element does not stand for the page
    inside = sum(len(x.text) for x in lines if x.article)
    explicit = inside > sum(len(x.text) for x, ok in zip(lines, plain) if ok and not x.article)
    if explicit:
        weights = [len(x.text) * x.article for x in lines]
        kept = [x.article for x in lines]
    else:
        weights = [len(x.text) * ok for x, ok in zip(lines, plain)]
        kept = [not x.bare for x in lines]
    sums = window_sums(weights, window)
    found = stretches(lines, weights, sums, max(1, min(surge, PEAK_SHARE * max(sums, default=0))))
    return " ".join(lines[i].text for a, b in found for i in range(a, b) if kept[i])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
