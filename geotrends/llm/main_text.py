"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines: each block element gives a line, and what never
belongs to an article (scripts, styles, menus, forms, adverts, comments ...)
gives an empty one. A line counts as many characters as it has outside of
links. Over a sliding window of lines the sums are taken: where they surge, the
main text begins, and where they dive to nothing it ends. In a page that marks
its article as such, only its lines count, and each of them counts enough for
a surge, however short it is. Pages are judged one by one in tasks without a
shuffle.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.llm.shared_store import bound_batches

# Comments, elements whose content is no markup, declarations, and tags with their attributes.
_ATTRIBUTES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(script|style|textarea|title|iframe|noembed|noframes|noscript|xmp)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_HINTS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_LINES = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot"
    " thead tr ul".split()
)
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_CELLS = frozenset(["td", "th"])
_NEVER = frozenset(
    "nav footer aside form menu dialog fieldset search button select datalist object template svg math canvas audio video applet".split()
)
_NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
# Words in class names and ids of what surrounds an article.
_AROUND = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense banner sponsor sponsored promo promotion promoted"
    " menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer"
    " sidebar aside widget widgets rail related recommended recommendations trending"
    " notice notices cookie cookies consent gdpr privacy disclaimer copyright legal alert popup modal overlay paywall"
    " newsletter subscribe subscription signup login share sharing social follow"
    " comment comments commentlist discussion disqus reply replies respond responses".split()
)
_COMMENTS = frozenset(
    "comment comments commentlist discussion disqus reply replies respond responses related recommended teaser promo sponsored".split()
)
# Opening one of the first closes an open one of the second.
_CLOSES = {
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "tr": ["tr", "td", "th"], "td": ["td", "th"],
    "th": ["td", "th"], "tbody": ["tr", "tbody", "thead"], "tfoot": ["tr", "tbody", "thead"], "body": ["head"],
}
_DEEPEST = 5000  # open elements; further ones are read as if they were not nested
_KEEP_OPEN = frozenset(["table", "ul", "ol", "dl", "menu", "select", "div", "section", "article", "main", "body"])


@dataclass(frozen=True)
class Settings:
    window: int = 3  # lines of a block
    surge: int = 60  # characters of a block where main text begins
    misled: int = 300  # characters of main text within an element whose name says that it is none
    short: int = 20  # characters of a line that is cut off at either end of unmarked main text


@dataclass
class Line:
    text: str
    size: int  # characters outside of links
    marked: int  # 2 within an article element, 1 within main, else 0
    heading: bool


def _hints(name: str, attributes: str) -> tuple[frozenset[str], set[str], bool]:
    """Words of class and id, roles, and whether the element is hidden."""
    words, roles, hidden = set(), set(), False
    for key, *values in _HINTS.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if key in ("class", "id"):
            for part in value.split():
                if not re.match(r"(no|with|without|has)[-_]", part):
                    words.update(w.lower() for w in _NAME_PARTS.findall(part))
        elif key == "role":
            roles.update(value.lower().split())
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "itemprop" and value.lower() == "articlebody":
            roles.add("article")
    return frozenset(words), roles, hidden


def lines_of(html: str, by_names: bool = True) -> list[Line]:
    """The page as lines; ``by_names``: class names and ids tell what surrounds the article."""
    lines: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, left out, largest mark so far
    out = marked = links = heading = linked = articles = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not out:
            buffer.append(raw)
            if links:
                linked += len("".join(unescape(raw).split()))

    def end_line(gap: bool = False) -> None:
        nonlocal linked
        whole = " ".join(unescape("".join(buffer)).split())
        if whole:
            lines.append(Line(whole, max(0, len(whole.replace(" ", "")) - linked), marked, heading > 0))
        if gap:
            lines.append(Line("", 0, 0, False))
        buffer.clear()
        linked = 0

    def pop(at: int) -> None:
        nonlocal out, marked, links, heading, articles
        while len(stack) > at:
            name, left_out, _ = stack.pop()
            out -= left_out
            links -= name == "a"
            heading -= name in _HEADINGS
            articles -= name == "article"
        marked = stack[-1][2] if stack else 0

    def opened(name: str, attributes: str) -> None:
        nonlocal out, marked, links, heading, articles
        words, roles, hidden = _hints(name, attributes) if attributes else (frozenset(), set(), False)
        article = name == "article" or "article" in roles
        left_out = name in _NEVER or hidden or bool(roles & _NEVER_ROLES)
        if name == "header" or ("header" in words and name not in _HEADINGS):
            left_out |= not marked
        if article:
            # An article within another one is a comment or a teaser.
            left_out |= articles > 0 and name == "article" or by_names and bool(words & _COMMENTS)
        elif by_names and name not in ("html", "body", "main") and name not in _HEADINGS:
            left_out |= bool(words & _AROUND)
        mark = 2 if article else 1 if name == "main" or "main" in roles else 0
        if left_out and not out and name in _LINES:
            end_line(gap=True)
        before = stack[-1][2] if stack else 0
        stack.append((name, left_out, before if left_out or out else max(before, mark)))
        out += left_out
        links += name == "a"
        heading += name in _HEADINGS
        articles += name == "article"
        marked = stack[-1][2]

    position = 0
    for m in _MARKUP.finditer(html):
        text(html[position : m.start()])
        position = m.end()
        name = m[3].lower() if m[3] else ""
        if not name:
            continue
        block = name in _LINES
        if block and not out:
            end_line()
        elif name in _CELLS and not out:
            buffer.append(" ")
        if m[2]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    pop(at)
                    break
                if not block and stack[at][0] in _LINES and name not in _CELLS:
                    break  # an end tag within a line closes nothing around it
            continue
        closes = ["p", *_CLOSES.get(name, [])] if block else _CLOSES.get(name, [])
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in closes:
                pop(at)
                break
            if stack[at][0] in _KEEP_OPEN:
                break
        if name not in _EMPTY and len(stack) < _DEEPEST and (block or name in _CELLS or name in _NEVER or name == "a" or m[4]):
            opened(name, m[4])
    text(html[position:])
    end_line()
    return lines


def main_lines(lines: list[Line], s: Settings = Settings()) -> list[str]:
    """Texts of the lines between each surge and the next dive."""
    mark = max((x.marked for x in lines if x.text), default=0)
    sizes = [0 if not x.text or x.marked < mark else max(x.size, s.surge) if mark else x.size for x in lines]
    blocks = [sum(sizes[i : i + s.window]) for i in range(len(lines))]
    surge = min(s.surge, max(blocks, default=0) / 2)
    kept, i = [], 0
    while i < len(lines):
        if not blocks[i] or blocks[i] < surge:
            i += 1
            continue
        end = i
        while end < len(lines) and blocks[end]:
            end += 1
        part = [x for x, size in zip(lines[i:end], sizes[i:end]) if x.text and (size or not mark)]
        if not mark:
            part = _trimmed(part, s)
        kept += [x.text for x in part]
        i = end
    return kept


def _trimmed(part: list[Line], s: Settings) -> list[Line]:
    """Without the short lines at either end, but for headings before it and sentences after it."""
    full = [k for k, x in enumerate(part) if x.size >= s.short]
    if not full:
        return part
    first, last = full[0], full[-1]
    while first > 0 and part[first - 1].heading:
        first -= 1
    while last + 1 < len(part) and part[last + 1].size and part[last + 1].text.endswith((".", "!", "?", "…")):
        last += 1
    return part[first : last + 1]


def main_text(html: str | None, s: Settings = Settings()) -> str:
    """The main text of a page, a block per line; empty if there is none."""
    found = main_lines(lines_of(html or ""), s)
    if html and not found and not re.search(r"<(article|main)[\s>]", html, re.I):
        found = main_lines(lines_of(html, by_names=False), s)  # perhaps a name misleads
        if sum(map(len, found)) < s.misled:
            found = []
    return "\n".join(found)


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()
) -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars): the main text of every row.

    Character references are decoded, white space (of any kind) within a block
    becomes one blank, blocks are joined by a line end. Null and empty pages, and
    pages without main text, give an empty text; rows that repeat are extracted
    each. Ids and urls pass as they are, also null ones. Other columns are left out.
    """
    bound_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data = batch.cast(pa.binary()).to_pylist()
            yield pa.array([main_text(d.decode("utf-8", "replace") if d else "", settings) for d in data], pa.string())

    texts = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), extracted(F.col(f"`{html_col}`")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
