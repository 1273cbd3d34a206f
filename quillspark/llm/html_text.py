"""Main-text extraction: parser events to lines, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard library's streaming parser gives events; a *line* is the text between two block boundaries, with the tags
seen since the line before. Its ratio is text length by tags. Ratios are smoothed by a Gaussian over neighbouring lines and
split in two clusters by the threshold at which the clusters' means are equally far (1-D two-means). Lines of the upper
cluster are seeds, and those with much text to a tag in any case. The content region is the outermost article-like elements that
hold seed text, with the headings that lead to them; all its lines are the text, apart from parts that are marked as menus, notices, forms and the like.
Where there is no such element, the region goes from the first seed to the last and on to what shares their elements.
A form that holds most of the page's text is a wrapper, not a form.

Null html is an empty page; a page with no such text gives an empty text. Unclosed and crossed tags are taken as they
come. A page that is cut off ends there: an unfinished tag or comment is no text. No input raises. Work and memory are
linear in the page, whatever its depth. Each row is taken for itself, so repeated rows give repeated results; the result has the
id, the url, text and n_chars alone, other columns don't matter. No rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record_batch

# Elements and names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Mathematics is read as part of its line.
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle merror mpadded mphantom mfenced munder mover munderover mtable mtr mtd semantics".split())
HEAD = frozenset("html head title base link meta script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not shown as text, and no boundary of the line they stand in; what is inside of them is passed over.
SILENT = frozenset("script style template noscript svg annotation annotation-xml iframe object canvas audio video button select textarea".split())
SKIPPED = frozenset("nav footer aside dialog menu head title".split())
ARTICLES = frozenset("article main".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Names of parts that are never the article, nor hold it.
APART = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond|discussion|related|recommended)(?:$|[\s_-])", re.IGNORECASE)
#: Names of parts that aren't the article; a wrapper may be named after one of them, as in "with-sidebar".
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget|"
    r"footer|header|masthead|share|sharing|social|newsletter|subscribe|signup|login|pagination|pager|tags|toc|skip|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
SIGMA = 1.0
#: Characters to a tag from which on a line is text whatever the threshold says.
TEXT = 30.0
#: Links of a list that stand together and make a menu.
MENU = 3
#: Elements whose text belongs to what stands around them.
BLOCKS = frozenset("p li ul ol dl dt dd pre blockquote h1 h2 h3 h4 h5 h6 table tbody thead tr td th figure figcaption".split())
_NAME = re.compile("[a-zA-Z][^\\t\\n\\r\\f />\\x00]*")


#: Character references that stand for no character, and leading zeros of others.
_NO_CHARACTER = re.compile("&#0*(?:[0-9]{9,}|[xX]0*[0-9a-fA-F]{9,});?")
_ZEROS = re.compile("&#(0{9,})(?=[0-9])")


@dataclass(frozen=True, slots=True)
class _Open:
    """An open element, and what holds for all inside of it."""

    tag: str
    number: int
    skip: int  #: 1 for its name, 2 in any case
    header: bool
    heading: bool
    article: bool
    form: int  #: number of the outermost form around, or -1


_ROOT = _Open("", -1, 0, False, False, False, -1)


class _Lines(HTMLParser):
    """Takes the whole page in one ``feed``: what doesn't end ends with the page."""

    def __init__(self, lenient: bool = False):
        super().__init__(convert_charrefs=True)
        self.lenient = lenient
        self.stack: list[_Open] = [_ROOT]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.tags, self.linked, self.in_link = 1, 0, False
        self.silent: tuple[str, Counter] | None = None  # element, and what is open inside of it
        self.in_tag, self.odd = False, False
        self.lines: list[tuple[str, int, int, int, int]] = []  # text, tags, linked characters, innermost element, form
        self.elements: list[tuple[str, bool, int]] = []  # tag, article-like, parent

    # malformed markup: the parser's own ways raise, or give it out as text

    def parse_comment(self, i, report=1):
        raw = self.rawdata
        for empty in ("<!-->", "<!--->"):
            if raw.startswith(empty, i):
                return i + len(empty)
        end = raw.find("-->", i + 4)
        return end + 3 if end >= 0 else len(raw)

    def parse_html_declaration(self, i):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    parse_pi = parse_html_declaration

    def parse_starttag(self, i):
        raw, end = self.rawdata, self.check_for_whole_start_tag(i)
        if end < 0:
            return len(raw)
        if raw[end - 1] == ">":
            self.odd = False
            self.in_tag = True
            super().parse_starttag(i)
            self.in_tag = False
            if not self.odd:
                return end
        else:
            close = raw.find(">", end)
            end = close + 1 if close >= 0 else len(raw)
        # a stray quote or the like: it is a tag, but what else it says isn't known
        self.handle_starttag(_NAME.match(raw, i + 1)[0].lower(), [])
        return end

    def parse_endtag(self, i):
        end = super().parse_endtag(i)
        return end if end > 0 else len(self.rawdata)

    def flush(self) -> None:
        if self.parts:
            text, top = " ".join("".join(self.parts).split()), self.stack[-1]
            if text and not (top.header and not top.heading):
                self.lines.append((text, self.tags, self.linked, top.number, top.form))
            self.parts = []
        self.tags, self.linked = 1, 0

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def handle_starttag(self, tag, attrs):
        self.in_tag = False
        self.tags += 1
        if self.silent:
            self.silent[1][tag] += 1
            return
        if self.open["head"] and tag not in HEAD:
            self._close("head")
        if tag == "body" and not self.open["body"]:
            del self.stack[1:]
            self.open.clear()
        if tag == "br":
            self.handle_data(" ")
        elif tag in INLINE or tag in MATH:
            if tag == "a":
                self.in_link = True
        elif tag in SILENT:
            self.silent = (tag, Counter())
        elif tag not in VOID:
            self._opened(tag, dict(attrs))
        elif tag == "hr":
            self.flush()

    def _opened(self, tag, attrs):
        self.flush()
        closing = SELF_CLOSING.get(tag)
        if closing and self.stack[-1].tag in closing or self.stack[-1].tag == "p":
            self._pop()
        top = self.stack[-1]
        article = tag in ARTICLES or attrs.get("role") in ARTICLES or attrs.get("itemprop") == "articleBody"
        # an article inside of a part with a doubtful name is an article
        skip = max(0 if article and top.skip == 1 else top.skip, self._unwanted(tag, attrs, article))
        number = len(self.elements)
        self.elements.append((tag, article, top.number))
        form = number if tag == "form" and top.form < 0 else top.form
        self.stack.append(_Open(tag, number, skip, top.header or tag == "header", top.heading or tag in HEADINGS, top.article or article, form))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        """The slash ends what is silent, but for scripts and styles; of other elements it says nothing."""
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        elif self.silent and (self.silent[0] == tag or self.silent[1][tag]):
            self.handle_endtag(tag)

    def _unwanted(self, tag, attrs, article) -> int:
        if tag in SKIPPED:
            return 2
        if tag == "header":
            return 0 if self.stack[-1].article else 2
        if tag in ("body", "html"):
            return 0
        if (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", ""):
            return 2
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if APART.search(names):
            return 2
        return int(not (article or self.lenient or tag in HEADINGS) and bool(MARKED.search(names)))

    def handle_endtag(self, tag):
        self.tags += 1
        if self.silent:
            name, inner = self.silent
            if inner[tag]:
                inner[tag] -= 1
                return
            if tag != name and not self.open[tag]:
                return
            self.silent = None  # its own end, or that of an element around it
            if tag == name:
                return
        if tag in INLINE or tag in MATH:
            if tag == "a":
                self.in_link = False
        elif tag not in SILENT:
            self.flush()
            self._close(tag)

    def _close(self, tag) -> None:
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self.in_tag:
            self.odd = True
        elif not self.silent and not self.stack[-1].skip:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(2 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Two-means in one dimension; the point between the means. At or below all values if they are alike."""
    lo, hi = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (lo + hi) / 2
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            return lo - 1
        if (low.mean(), high.mean()) == (lo, hi):
            break
        lo, hi = float(low.mean()), float(high.mean())
    return (lo + hi) / 2


def _read(html: str, lenient: bool) -> _Lines:
    parser = _Lines(lenient)
    parser.feed(_NO_CHARACTER.sub("\ufffd", _ZEROS.sub("&#", html)))
    parser.close()
    parser.flush()
    return parser


def _without_forms(lines: list) -> list:
    """Lines outside of forms, and of those that hold most of the page's text."""
    held = Counter()
    for text, _, _, _, form in lines:
        held[form] += len(text)
    total = sum(held.values())
    return [line for line in lines if line[4] < 0 or 2 * held[line[4]] > total]


def _within(elements: list, regions: set[int]) -> list[bool]:
    """Whether each element is one of the regions or inside one. Parents come before their children."""
    inside: list[bool] = []
    for n, (_, _, parent) in enumerate(elements):
        inside.append(n in regions or parent >= 0 and inside[parent])
    return inside


def _regions(elements: list, held: list[int]) -> dict[int, int]:
    """The outermost article-like elements with seed text, each with the innermost such element in it that has all of that text."""
    around: list[int] = []  # the outermost article-like element of each one
    best: dict[int, int] = {}
    for n, (_, article, parent) in enumerate(elements):
        up = around[parent] if parent >= 0 else -1
        around.append(up if up >= 0 else n if article else -1)
        if article and held[n]:
            best.setdefault(around[n], n)
            if held[n] == held[around[n]]:
                best[around[n]] = n
    return best


def main_text(html: str) -> str:
    parser = _read(html, False)
    lines = _without_forms(parser.lines)
    if not lines:  # everything stood in a part with a doubtful name
        parser = _read(html, True)
        lines = _without_forms(parser.lines)
    if not lines:
        return ""
    elements = parser.elements
    raw = np.array([len(t) / tags for t, tags, *_ in lines], float)
    ratios = smoothed(raw)
    cut = threshold(ratios)
    # a line with so much text to a tag is text, however long others are
    seeds = (ratios > cut) | (raw > TEXT)
    held = [0] * len(elements)
    for (text, _, linked, number, _), seed in zip(lines, seeds, strict=True):
        if seed and 2 * linked <= len(text) and number >= 0:
            held[number] += len(text)
    for n in range(len(elements) - 1, -1, -1):
        parent = elements[n][2]
        if parent >= 0:
            held[parent] += held[n]
    narrowed = _regions(elements, held)
    if narrowed:
        inside = [number >= 0 and within for number, within in zip((line[3] for line in lines), _of_lines(lines, _within(elements, set(narrowed.values()))), strict=True)]
        around = _of_lines(lines, _within(elements, set(narrowed)))
        # the headings that lead to it, outside of the inner element but in the outer one
        for k in range(len(lines) - 2, -1, -1):
            if not inside[k] and inside[k + 1] and around[k] and elements[lines[k][3]][0] in HEADINGS and 2 * lines[k][2] <= len(lines[k][0]):
                inside[k] = True
        return "\n\n".join(line[0] for line, kept in zip(lines, inside, strict=True) if kept)
    # short lines beside long ones are seeds too; where the content ends, only the long ones tell
    first, last = _span(lines, elements, seeds & (raw > min(cut, TEXT)))
    own = lines[first:last]
    # a list of nothing but links is a menu; links that stand among other lines are text
    link = [2 * line[2] > len(line[0]) for line in own]
    menu = [False] * len(own)
    for k in range(len(own)):
        listed = link[k] and own[k][3] >= 0 and elements[own[k][3]][0] == "li"
        menu[k] = listed and (k > 0 and menu[k - 1] or all(j < len(own) and link[j] for j in range(k, k + MENU)))
    return "\n\n".join(line[0] for line, m in zip(own, menu, strict=True) if not m)


def _of_lines(lines: list, inside: list[bool]) -> list[bool]:
    return [number >= 0 and inside[number] for *_, number, _ in lines]


def _span(lines: list, elements: list, seeds: np.ndarray) -> tuple[int, int]:
    """First line and end of the content, on a page without article-like elements.

    It goes from the first to the last line that is a seed or stands in the same element as one, links aside, and takes in the
    headings before that.
    """

    def container(k: int) -> int:
        n = lines[k][3]
        while n >= 0 and elements[n][0] in BLOCKS:
            n = elements[n][2]
        return n

    link = [2 * line[2] > len(line[0]) for line in lines]
    seed = [bool(s) and not a for s, a in zip(seeds, link, strict=True)]
    if True not in seed:
        seed = [not a for a in link]
    if True not in seed:
        return 0, len(lines)
    homes = {container(k) for k, s in enumerate(seed) if s}
    whole = [s or not a and container(k) in homes for k, (s, a) in enumerate(zip(seed, link, strict=True))]
    first, last = whole.index(True), len(whole) - whole[::-1].index(True)
    while first and not link[first - 1] and lines[first - 1][3] >= 0 and elements[lines[first - 1][3]][0] in HEADINGS:
        first -= 1
    return first, last


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row."""
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        return record_batch(**{id_col: batch.column(0), url_col: batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return map_batches(df.select(id_col, url_col, html_col), run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
