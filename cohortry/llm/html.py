"""Main text of HTML pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

from cohortry.llm.common import DataFrame, F, T, per_slice, plain

BLOCK = 3    # lines of a window
SURGE = 60   # characters of a window where the text begins

# Elements of HTML, by what they mean for the text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "title"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
MARKED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer",
          "disqus", "footer", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "related", "replies",
          "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}

# Which open elements a start tag ends, and what keeps it from looking further out.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
         "option": (("option",), ("select", "datalist")), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
_SCOPE = ("table", "td", "th", "button", "object", "caption")

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"=\s*([\"'])|>")
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = {"list", "box", "area", "section", "block", "wrap", "wrapper", "container", "inner", "bar", "main", "site", "page", "top", "bottom", "left", "right", "form", "links", "link", "text", "content", "unit",
          "slot", "message", "policy", "buttons", "button", "item", "items", "panel", "thread", "body", "header", "global", "primary", "secondary", "post", "article", "story", "google", "js"}


def _names_region(word: str) -> bool:
    """Whether a class or id says that its region is not content: the word itself is one of the marks, or it is made of
    a mark and parts that only say where it stands (comment-list, site_footer, not notice-of-intent)."""
    parts = [x for x in re.split(r"[-_]+", word) if x and not x.isdigit()]
    marks = [x for x in parts if x in MARKED]
    return bool(marks) and all(x in MARKED or x in _PARTS for x in parts)


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and any(map(_names_region, value.split())):
            return True
    return False


def tokens(html: str):
    """(kind, text, attributes): "text", "open" or "close", in page order. A quote counts only as the beginning of a value.
    One pass: what is looked for and not there is not looked for again, so unclosed markup costs no more than its length."""
    at, size = 0, len(html)
    gone = {}  # marks that do not occur any more from here on

    def find(mark: str, start: int) -> int:
        if mark in gone:
            return -1
        k = html.find(mark, start)
        if k < 0:
            gone[mark] = True
        return k
    text = 0  # where the text not yet given begins
    while at < size:
        k = find("<", at)
        if k < 0:
            break
        if html.startswith("<!--", k):
            end = find("-->", k + 4)
            end = size if end < 0 else end + 3
        elif html.startswith("<![CDATA[", k):
            yield "text", html[text:k], ""
            end = find("]]>", k + 9)
            yield "text", html[k + 9:size if end < 0 else end], ""
            text = at = size if end < 0 else end + 3
            continue
        elif html.startswith(("<!", "<?"), k):
            end = find(">", k + 2)
            if end < 0:
                at = k + 1
                continue
            end += 1
        else:
            m = _NAME.match(html, k + 1)
            if not m:
                at = k + 1
                continue
            end = m.end()
            while True:
                stop = _STOP.search(html, end) if ">" not in gone else None
                if stop is None:
                    gone[">"] = True
                    end = -1
                    break
                end = stop.end()
                if not stop[1]:
                    break
                close = find(stop[1], end)
                if close >= 0:
                    end = close + 1
            if end < 0:  # no tag is closed from here on: it is text
                break
            yield "text", html[text:k], ""
            tag = m[2].lower()
            yield ("close" if m[1] else "open"), tag, html[m.end():end - 1]
            text = at = end
            if not m[1] and tag in RAW:
                raw = None if ("</", tag) in gone else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, end)
                if raw is None:
                    gone["</", tag] = True
                text = at = raw.end() if raw else size
            continue
        yield "text", html[text:k], ""
        text = at = end
    if text < size:
        yield "text", html[text:], ""


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """(text, linked, marked): the lines of a page without its markup. A block element begins and ends a line, and ends
    an open paragraph or list item as HTML has it; a region that is not content leaves as many empty lines as a window has, so the
    text falls to nothing there (inside a line it leaves nothing). ``linked`` says that most of a line is link text, ``marked`` that it
    stands in the main element or, on a page without one, in an article; an article inside an article is another's text."""
    lines: list[tuple[str, bool, int, bool]] = []
    held: list[str] = []
    linked = 0
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where in the stack each element is open
    dropped = 0  # depth at which dropping began
    inline = False

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def end_line():
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            lines.append((text, linked * 2 > len(text), len(places.get("article", ())), bool(places.get("main"))))
        held, linked = [], 0

    def close_to(depth: int):
        """Ends the elements above this depth."""
        nonlocal dropped
        while len(stack) > depth:
            if stack[-1] not in INLINE and not dropped:
                end_line()
            top = stack.pop()
            places[top].pop()
            if dropped and len(stack) < dropped:
                dropped = 0
                if not inline:
                    lines.extend([("", False, 0, False)] * BLOCK)
    for kind, what, attributes in tokens(html):
        if kind == "text":
            if not dropped and what:
                text = unescape(what)
                held.append(text)
                if places.get("a"):
                    linked += len(text.strip())
        elif kind == "close":
            if places.get(what):
                close_to(places[what][-1])
            elif what not in INLINE and not dropped:
                end_line()
        elif what in RAW or what == "head":  # a head holds what is raw or void; anything else ends it, with or without </head>
            continue
        elif what in VOID:
            if what == "br" and not dropped:
                held.append(" ")
            if what not in INLINE and not dropped:
                end_line()
        else:
            if what in _ENDS:
                mine = last(_ENDS[what][0])
                if mine > last(_ENDS[what][1]):
                    close_to(mine)
            elif what not in INLINE and places.get("p") and places["p"][-1] > last(_SCOPE):
                close_to(places["p"][-1])
            if what not in INLINE and not dropped:
                end_line()
            inside = bool(places.get("article") or places.get("main"))
            places.setdefault(what, []).append(len(stack))
            stack.append(what)
            if not dropped and (_unwanted(what, attributes, inside) or what == "article" and len(places["article"]) > 1):
                inline = what in INLINE
                if held and not inline:
                    end_line()
                dropped = len(stack)
    end_line()
    in_main = any(main for text, _, _, main in lines if text)
    return [(text, link, main if in_main else article > 0) for text, link, article, main in lines]


def main_text(html: str) -> str:
    """Blocks of the main text, with a blank line between them.

    The lengths of the lines are summed over windows of three lines. The text begins with the first stretch
    whose windows surge over a threshold and ends where the windows dive to nothing for the last time; every
    line between is kept, however short. A page whose windows never surge begins with its first stretch. Lines
    that are mostly links have no length: they neither begin nor end the text, but stay inside it. On a page
    that marks its article, the article element decides alone: lines outside it do not count, and any text
    inside it is a surge.
    """
    rows = lines_of(html)
    article = any(marked and text for text, _, marked in rows)
    size = np.array([len(text) if article and marked or not article and not linked else 0 for text, linked, marked in rows], np.int64)
    if not size.any():
        return ""
    total = np.convolve(size, np.ones(BLOCK, np.int64))[BLOCK - 1:]
    edge = np.diff(np.concatenate([[0], (size > 0).astype(int), [0]]))
    stretches = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
    surge = 1 if article else SURGE
    begin = next((s for s, e in stretches if total[s:e].max() >= surge), stretches[0][0])
    return "\n\n".join(text for text, _, marked in rows[begin:stretches[-1][1]] if text and (marked or not article))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``. Null or empty html has the empty text."""
    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def work(part, texts):
            made = [main_text(t) for t in texts]
            return [part.column(0), part.column(1), made, [len(t) for t in made]]
        return work
    return per_slice(plain(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")), "html", out, make)
