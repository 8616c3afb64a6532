"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; what a page says is no article (navigation, forms, scripts,
adverts and the like, by element, role, class or id) leaves an empty line; what is cut by class or id only and
holds most of the text or the declared article is a wrapper, and stays. The length of a line is that of its text
outside links, and that of a block is the sum over ``WINDOW`` lines. Where the block length surges above a
threshold a region begins, and it ends where the blocks dive to nothing; the lines between are the text.
Where a page declares its article, lines outside it have length nothing and any text inside is a surge, so
short articles are whole; where it does not, the threshold is ``SURGE`` characters, or the largest block if
that is less.

A page is one row: Python goes through its tags once, Spark through the pages.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 80

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CUT_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!-?|/)?\Z")
#: Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "noscript", "template",
}
#: Elements that are never part of an article.
_OUT = {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "template", "svg",
    "object", "canvas", "audio", "video", "map", "math", *_RAW,
}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
#: Words of class and id that mark what is no article.
_OUT_WORDS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "footer",
    "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond",
    "widget", "toolbar", "pagination", "pager", "paywall",
}
#: These count outside a declared article only; there they may hold its heading.
_OUTER_WORDS = {"header", "banner", "topbar", "side", "left", "right"}
#: A class or id with one of these says how something is laid out, not what it is: has-sidebar, menu-open.
_STATE_WORDS = {"has", "no", "with", "without", "not", "open", "closed", "enabled", "disabled", "layout"}
#: Marks of what is no article however much of the page it is.
_NEVER_WORDS = {
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "related", "recommended",
    "recommendations", "cookie", "cookies", "consent", "gdpr",
}
_SCOPE = {"table", "td", "th", "caption", "button", "object", "html"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}


#: Cut for good, and cut by a class or id that a wrapper of the article may have too; see :func:`_wrappers`.
_SURE, _NAMED = 1, 2


def _marks(name: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """Whether an element is no article (see ``_NAMED``), and whether it declares one."""
    values = {}
    if attributes.strip(" /"):
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = values.get("role", "").lower()
    declares = name in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower()
    if name in _OUT or role in _OUT_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return _SURE, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return _SURE, False
    if name == "header" and not inside:
        return _SURE, False
    words = set()
    for value in (values.get("class", ""), values.get("id", "")):
        for token in value.split():
            parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
            if len(parts) == 1 or not _STATE_WORDS.intersection(parts):
                words.update(parts)
    out = bool(words & _OUT_WORDS) or (not inside and bool(words & _OUTER_WORDS))
    if name in ("html", "body", "main") or (declares and name == "article" and not words & {"comment", "comments", "ad", "advert", "related", "reply", "sponsored", "promo"}):
        out = False
    if not out:
        return 0, declares
    return (_SURE if words & _NEVER_WORDS else _NAMED), False


def _wrappers(named: list[list[int]], rest: int, declared_rest: int) -> set[int]:
    """Elements cut by name that hold most of the page's text outside links, or its declared article.

    ``named`` has, in the order of the page, an element's number, the index of the one around it (or -1), and its
    lengths of text outside links, all and in declared articles; ``rest`` and ``declared_rest`` are those of the text
    outside all of them. An article counts if none is declared outside and it is longer than what is there.
    """
    for _, around, own, declared in reversed(named):
        if around >= 0:
            named[around][2] += own
            named[around][3] += declared
    total = rest + sum(own for _, around, own, _ in named if around < 0)
    kept: set[int] = set()
    for number, around, own, declared in named:
        if (around < 0 or named[around][0] in kept) and (2 * own > total or (not declared_rest and declared > rest)):
            kept.add(number)
    return kept


def lines_of(html: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """Lines (text, length outside links, inside a declared article) and whether the page declares one."""
    lines, declared, wrappers = _lines(html, set())
    return _lines(html, wrappers)[:2] if wrappers else (lines, declared)


def _lines(html: str, wrappers: set[int]) -> tuple[list[tuple[str, int, bool]], bool, set[int]]:
    """Lines and declaration, with elements of the numbers ``wrappers`` not cut, and the wrappers that were cut."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool, bool]] = []
    out = sure = inside = claimed = links = number = rest = declared_rest = 0
    declared = False
    named: list[list[int]] = []
    around: list[int] = []

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(markup.unescape("".join(parts)).split())
        lines.append((text, max(0, len(text) - linked), inside > 0))
        parts, linked = [], 0

    def pop(to: int) -> None:
        nonlocal out, sure, inside, claimed, links
        while len(stack) > to:
            name, was_out, was_inside, was_claimed = stack.pop()
            out -= was_out > 0
            sure -= was_out == _SURE
            inside -= was_inside
            claimed -= was_claimed
            links -= name == "a"
            if was_out == _NAMED:
                around.pop()

    def add(text: str) -> None:
        nonlocal linked, rest, declared_rest
        if text and not sure and not links:
            length = len(text.strip())
            if around:
                named[around[-1]][2] += length
                named[around[-1]][3] += length if claimed else 0
            else:
                rest += length
                declared_rest += length if claimed else 0
        if text and not out:
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                pop(i)
                return
            if stack[i][0] in scope:
                return

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if not m:
            add(_CUT_TAG.sub("", html[at:]))
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(markup.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("table", "html") or (stack[i][0] in ("td", "th", "div", "article") and name in ("p", "span", "b", "i", "a")):
                    break
            continue
        if name in _BLOCK:
            flush()
            close({"p"}, _SCOPE | {"div", "article", "section", "main", "aside", "nav", "footer", "header", "form", "li"})
        elif name in ("br", "td", "th"):
            add(" ")
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if m[3].endswith("/") and name in ("svg", "path", "use"):
            continue
        is_out, claims = _marks(name, m[3], claimed > 0)
        number += 1
        if is_out == _NAMED and number in wrappers:
            is_out = 0
        if is_out == _NAMED:
            named.append([number, around[-1] if around else -1, 0, 0])
            around.append(len(named) - 1)
        claims = claims and not sure
        declares = claims and not out
        declared |= declares
        stack.append((name, is_out, declares, claims))
        out += is_out > 0
        sure += is_out == _SURE
        inside += declares
        claimed += claims
        links += name == "a"
    flush()
    return lines, declared, _wrappers(named, rest, declared_rest) if named else set()


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surges and dives, joined by newlines."""
    if not html:
        return ""
    lines, declared = lines_of(html)
    if declared and not any(text for text, _, inside in lines if inside):
        declared = False
    if declared:
        sizes = [len(text) if inside else 0 for text, _, inside in lines]
        surge = 0
    else:
        sizes = [size if 2 * size >= len(text) else 0 for text, size, _ in lines]
    filled = [i for i, (text, _, _) in enumerate(lines) if text]
    sizes = [sizes[i] for i in filled] if not declared else sizes
    texts = [lines[i][0] for i in filled] if not declared else [text for text, _, _ in lines]
    n = len(sizes)
    blocks = [sum(sizes[i : i + window]) for i in range(n)]
    surge = min(surge, max(blocks, default=1) - 1)
    kept, linked, inside_region = [], [], False
    for i in range(n):
        if not inside_region and sizes[i] and blocks[i] > surge:
            inside_region = True
        if inside_region and sum(sizes[max(0, i - window + 1) : i + 1]) == 0 and blocks[i] == 0:
            inside_region, linked = False, []
        if inside_region and sizes[i]:
            kept += [*linked, texts[i]]
            linked = []
        elif inside_region and not declared:
            linked.append(texts[i])  # of the text if the region goes on after it
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars"]
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of ``pages``.

    A null or empty html, and a page without text, give an empty text. Rows that repeat give equal rows; ids and
    urls may be null and are passed on. Columns beyond page_id, url and html are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
