"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block. Lines in menus, adverts and the like are left out, and text that is mostly
links counts as empty. Text lengths are summed over sliding windows of lines; a surge is where a sum rises above the threshold, a dive
where it falls to nothing, and the text between them is kept. Where the longest article or main element outweighs the longest
surge outside of them, only text in such elements has length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "canvas", "audio", "video", "title")
ASIDE = frozenset("nav footer aside form button dialog menu header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BODY = frozenset(("article", "main"))
#: Blocks that end an open paragraph, as far as a cell or button around them.
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
_P_SCOPE = frozenset("button caption html table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class and id attributes that mark what isn't part of the article. As the last part of a name ("site-footer"), or any part outside
#: of article and main ("ad-slot"), they count on elements that hold neither the longest article or main element nor half of the page's text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe teaser teasers toolbar widget".split()
)
#: Parts of names that speak of the page's layout ("has-sidebar").
NEGATIONS = frozenset("has no not with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

#: Of these, the ones whose content is plain text for a browser: without an end tag they reach to the end of the page.
_TO_END = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
#: The name of such an element ends at white space, / or >; one closed in itself is empty.
_OPEN = r"""(?=[\s/>])(?>(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)"""
_GONE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:{raw}){open}(?<=/>)|<({to_end}){open}.*?(?:</\1\s*>|\Z)|<({raw}){open}.*?</\2\s*>".format(raw="|".join(RAW), to_end="|".join(_TO_END), open=_OPEN),
    re.S | re.I,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


#: A short line of this form outside of article and main is a notice.
_COPYRIGHT = re.compile(r"(?:copyright\s*)?(?:©|\(c\))|copyright\s+\d{4}|.*\ball rights reserved\.?$", re.I)
_NOTICE_CHARS = 120
#: Characters outside of links that make a paragraph more than a link.
_OWN_CHARS = 10


@dataclass(frozen=True)
class Settings:
    """Lines in a window, the least window sum of a surge, and how much more a character in an article or main element weighs."""

    window: int = 3
    surge: int = 86
    weight: int = 2


@dataclass
class Line:
    text: str
    linked: int  # characters within links
    aside: bool
    body: int  # number of the outermost article or main element around it, or 0
    article: int  # number of the innermost article element around it, or 0
    doubtful: tuple[int, ...] = ()  # numbers of the elements around it that only a part of a name marks
    header: int = 0  # number of the element around the header that alone sets it aside, or 0
    tag: str = ""
    around: int = 0  # number of the element around its paragraph or heading


def _is_aside(name: str, attributes: str, inside: bool) -> bool | None:
    """Whether an element isn't part of the article; None where only a part of a class or id says so."""
    if name in ASIDE and not (name == "header" and inside):
        return True
    own, doubtful = name == "header", False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and not ROLES.isdisjoint(value.split()) or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            names = [x for x in value.split() if not (own and x == "header")]
            if not MARKS.isdisjoint(names):
                return True
            for x in names:
                parts = [part for part in re.split(r"[^a-z0-9]+", x) if part and not (own and part == "header")]
                doubtful = doubtful or bool(parts) and NEGATIONS.isdisjoint(parts) and not MARKS.isdisjoint(parts[-1:] if inside else parts)
    return None if doubtful else False


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in order, without markup."""
    html = _GONE.sub(" ", html)
    lines: list[Line] = []
    stack: list[tuple[str, bool, int, int, tuple[int, ...], int, int]] = []  # name, aside, body, article, doubtful, header, number
    opened: Counter[str] = Counter()  # how many of a name the stack holds, so that ends of others cost nothing
    parts: list[str] = []
    linked, links, count, serial = 0, 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            top = stack[-1] if stack else ("", False, 0, 0, (), 0, 0)
            own = top[0] == "p" or top[0] in HEADINGS
            notice = not top[2] and len(text) <= _NOTICE_CHARS and _COPYRIGHT.match(text) is not None
            lines.append(Line(text, linked, top[1] or notice, *top[2:6], top[0], stack[-2][6] if own and len(stack) > 1 else 0))
        linked = 0

    def close(k: int) -> None:
        """Pop the stack down to k elements."""
        for entry in stack[k:]:
            opened[entry[0]] -= 1
        del stack[k:]

    def begin(name: str, attributes: str) -> bool:
        """Push an element; whether it may be one that isn't part of the article, and none around it is."""
        nonlocal count, serial
        parent, around, body, article, doubtful, header, number = stack[-1] if stack else ("", False, 0, 0, (), 0, 0)
        serial += 1
        aside = around or bool(attributes or name in ASIDE) and _is_aside(name, attributes, body > 0)
        if aside is None:
            count += 1
            doubtful += (count,)
        if name in BODY and not aside:
            count += 1
            body, article = body or count, count if name == "article" else article
        if name == "header" and aside and not around and parent not in ("", "html", "body"):
            header = number
        elif aside and not around or name in ASIDE:
            header = 0
        stack.append((name, bool(aside), body, article, doubtful, header, serial))
        opened[name] += 1
        return aside is None or aside and not around

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if links:
                linked += len(parts[-1])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            end_block()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if name == "a":
                links = 0
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if name == "span":
                    end_block()
                close(k)
        elif name == "a":
            links = 1
        elif name in BLOCK:
            if name in ENDS_P and opened["p"]:
                k = len(stack) - 1
                while stack[k][0] != "p" and stack[k][0] not in _P_SCOPE:
                    k -= 1
                if stack[k][0] == "p":
                    close(k)
            if name == "p" or name not in VOID and not m[3].endswith("/"):
                begin(name, m[3])
        elif name == "span" and m[3] and not m[3].endswith("/"):
            marked = begin(name, m[3])
            top = stack.pop()
            if marked:
                end_block()
                stack.append(top)
            else:
                opened[name] -= 1
    if at < len(html):
        parts.append(html[at:])
    end_block()
    held, total = Counter(), 0
    bodies: Counter[int] = Counter()
    for x in lines:
        if not x.aside:
            total += len(x.text)
            bodies[x.body] += 0 if not x.body else len(x.text)
            for k in x.doubtful:
                held[k] += len(x.text)
    if held:
        longest = max(bodies, key=bodies.__getitem__)
        around = {k for x in lines if x.body == longest > 0 for k in x.doubtful if k < longest}
        marks = {k for k, n in held.items() if 2 * n < total and k not in around}
        for x in lines:
            x.aside = x.aside or not marks.isdisjoint(x.doubtful)
    return lines


def surges(sizes: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of lines from a surge to the dive after it.

    The sum at a line covers it and the next window - 1 lines. A surge is a line with text whose sum reaches the threshold;
    the dive is the first line from which a whole window is empty. Short lines right before a surge belong to it.
    """
    sums = [sum(sizes[k : k + window]) for k in range(len(sizes))]
    out, k = [], 0
    while k < len(sizes):
        if sizes[k] and sums[k] >= threshold:
            start, end = k, k
            while start > (out[-1][1] if out else 0) and sizes[start - 1]:
                start -= 1
            while end < len(sizes) and sums[end]:
                end += 1
            out.append((start, end))
            k = end
        else:
            k += 1
    return out


def _teasers(lines: list[Line]) -> set[int]:
    """Articles that begin with a link, as the announcements of other pages do, beside a longer text that isn't one."""
    first, chars = {}, Counter()
    for x in lines:
        first.setdefault(x.article, x)
        chars[x.article] += len(x.text) - x.linked
    linked = {k for k, x in first.items() if k and 2 * x.linked > len(x.text)}
    rest = max((n for k, n in chars.items() if k not in linked), default=0)
    return {k for k in linked if chars[k] < rest}


def main_text(html: str | None, settings: Settings = Settings()) -> str:
    """Blocks of the article, joined by one line feed; empty for null and for pages without text."""
    if not html:
        return ""
    every = lines_of(html)
    teasers = _teasers([x for x in every if not x.aside])
    places = [k for k, x in enumerate(every) if not x.aside and x.article not in teasers]
    lines = [every[k] for k in places]
    sizes = [0 if 2 * x.linked > len(x.text) and not x.body else len(x.text) for x in lines]

    def found(sizes: list[int]) -> list[tuple[int, int]]:
        return surges(sizes, settings.window, settings.surge) or surges(sizes, settings.window, 1)

    # The longest article or main element against the longest surge outside of such elements.
    inside, held = [n if x.body else 0 for n, x in zip(sizes, lines)], Counter()
    for n, x in zip(inside, lines):
        held[x.body] += n
    outside = [n - k for n, k in zip(sizes, inside)]
    if settings.weight * max(held.values(), default=0) >= max((sum(outside[a:b]) for a, b in surges(outside, settings.window, settings.surge)), default=0) and any(inside):
        sizes = inside
    spans = found(sizes)
    kept = {k for start, end in spans for k in range(start, end) if sizes[k]}
    seeds = {lines[k].body for k in kept} - {0} if sizes is inside else set()  # an element that surges is kept whole
    kept |= {k for k, x in enumerate(lines) if sizes[k] and x.body in seeds}
    if sizes is inside:
        return "\n".join(lines[k].text for k in sorted(kept))
    return "\n".join(every[k].text for k in _with_siblings(every, places, lines, kept, settings))


def _with_siblings(every: list[Line], places: list[int], lines: list[Line], kept: set[int], settings: Settings) -> list[int]:
    """Places among every line of the kept ones, and of two kinds of lines that belong to them.

    Where paragraphs of one element hold a surge's worth of kept text, so do its other paragraphs, short or with much of their text linked, and the
    headings of a header within it. Paragraphs that are nothing but links don't.
    """
    chars: Counter[int] = Counter()
    for k in kept:
        chars[lines[k].around] += len(lines[k].text) if lines[k].tag == "p" else 0
    homes = {e for e, n in chars.items() if e and n >= settings.surge}
    more = {k for k, x in enumerate(lines) if x.tag == "p" and x.around in homes and len(x.text) - x.linked >= _OWN_CHARS}
    titles = {k for k, x in enumerate(every) if x.aside and x.header in homes and x.tag in HEADINGS}
    return sorted({places[k] for k in kept | more} | titles)


def extractor(settings: Settings):
    """Batches of (page_id, url, html) to texts."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), settings) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points); one pass without a shuffle.

    Null html gives the empty text; ids and urls may be null or repeated, and each row, the equal ones too, has its own result. A page is read in time
    linear in its length, however long or deeply nested, and held by one task. Other columns, whatever their names, aren't looked at; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(extractor(settings), "page_id long, url string, text string, n_chars long")


def op3_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
