"""Main text of a page by the distribution of text over its lines.

Markup is stripped to lines: a block element begins a line, text elements inside it do not. A line weighs its characters
outside links; text in what a page never counts as its own (menu, header, footer, sidebar, notice, advert,
form, comments, told by element, role, id or class) goes with the markup. Lines of an element that the page itself names as its
article weigh ``SURGE`` more, so that short ones count; lines beside it weigh nothing. ``spans`` sums the weights over windows of ``WINDOW`` lines: the text
begins where a sum surges to ``SURGE`` and ends where it dives to nothing. The lines between that weigh anything are the text.

Cases: null, empty and blank html give empty text; markup that never closes ends with the page; a page is one value and is
read in one pass without backtracking, however long; repeated rows are read each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed together, and the characters that begin a text.
WINDOW = 3
SURGE = 60

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul""".split())
#: Elements that separate words but not lines.
GAPS = frozenset(["br", "td", "th", "img", "wbr", "option"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "noframes", "iframe", "xmp", "template"])
LEFT_OUT = frozenset("nav footer aside form head button select menu dialog svg math object audio video canvas label fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Parts of an id or class name that mark what is left out; a name is cut at everything but letters, and before capitals.
LEFT_OUT_NAMES = frozenset("""ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promoted promotion
nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer foot copyright sidebar aside widget rail related recommended
comment comments disqus reply replies respond cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe
signup login form search share sharing social pagination pager toolbar""".split())
COMMENTS = frozenset(["comment", "comments", "disqus", "reply", "replies", "respond"])
#: A name with one of these parts says what is around or absent.
UNSURE = frozenset(["has", "with", "no", "without", "wrapper", "container"])
ARTICLE_NAMES = frozenset(["article", "articlebody", "maincontent", "postcontent", "entrycontent"])
#: An element that ends an open one of the same kind, up to the element around them.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "option": ("select",)}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
RIGHTS = re.compile(r"\s*(©|copyright\b|\(c\)|all rights reserved)", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Element:
    """An open element: is its text left out, how sure is it an article (2, 1 or 0), is it a link."""
    __slots__ = ("name", "out", "article", "link", "header", "doubt")

    def __init__(self, name: str, around: Element | None, attributes: str):
        self.name = name
        self.out, self.article, self.header, self.doubt = (around.out, around.article, around.header, around.doubt) if around else (False, 0, False, False)
        self.link = name == "a" or around is not None and around.link
        named, role, hidden, body = _marks(attributes) if attributes and not attributes.isspace() else (frozenset(), "", False, False)
        comments = bool(named & COMMENTS)
        article = 2 if name == "article" and not comments else 1 if name == "main" or role == "main" or body else 0
        by_name = bool(named & LEFT_OUT_NAMES) and (comments or not article and name not in ("html", "body"))
        if self.doubt and article and not by_name:
            self.out = self.doubt = False          # an element around it was only named like a sidebar or a header
        if name == "header" or by_name and named & LEFT_OUT_NAMES == {"header"}:
            self.header = bool(self.article) and not self.out
            self.doubt |= not self.out and name != "header"
            self.out = True
        elif name in LEFT_OUT or name in RAW or role in ROLES or hidden:
            self.out, self.header, self.doubt = True, False, False
        elif by_name:
            self.doubt = not comments and (self.doubt or not self.out)
            self.out, self.header = True, False
        elif self.header and name in HEADINGS:
            self.out = False                       # the heading of an article, in the article's own header
        if not self.out:
            self.article = max(self.article, article)


def _marks(attributes: str) -> tuple[set[str], str, bool, bool]:
    """Parts of names, role, is it hidden, is it named as the text of the page."""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    named: set[str] = set()
    body = False
    for value in (a.get("id", ""), *a.get("class", "").split()):
        parts = [x.lower() for x in NAME_PART.findall(value)]
        if not UNSURE & set(parts):
            named.update(parts)
            body |= "".join(parts) in ARTICLE_NAMES
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return named, a.get("role", "").lower(), hidden, body


class Line:
    __slots__ = ("parts", "chars", "article")

    def __init__(self) -> None:
        self.parts, self.chars, self.article = [], 0, 0


def lines_of(html: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, how sure in an article) of the lines that hold text, in page order."""
    lines, line = [], Line()
    open_: list[Element] = []
    count: Counter[str] = Counter()                # of open elements, so that no tag searches for what is not there

    def end_line() -> None:
        nonlocal line
        text = " ".join(unescape("".join(line.parts)).split())
        if text:
            lines.append((text, line.chars, line.article))
        line = Line()

    def add(text: str) -> None:
        top = open_[-1] if open_ else None
        if top is None:
            line.parts.append(text)
            line.chars += len(text)
        elif not top.out:
            line.parts.append(text)
            line.article = max(line.article, top.article)
            line.chars += 0 if top.link else len(text)

    def close(name: str, borders: tuple[str, ...] = ()) -> None:
        if not count[name]:
            return
        for k in range(len(open_) - 1, -1, -1):
            if open_[k].name == name:
                count.subtract(x.name for x in open_[k:])
                del open_[k:]
                return
            if open_[k].name in borders:
                return

    at, end = 0, len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        if begin > at:
            add(html[at:begin])
        m = TOKEN.match(html, begin)
        if m is None:
            add("<")
            at = begin + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCKS
        if block:
            end_line()
        elif name in GAPS and line.parts:
            line.parts.append(" ")
        if m[1]:
            if name == "p" or name not in VOID:
                close(name)
            continue
        if block:
            close("p", ("table", "td", "th", "button"))
        if name in SIBLINGS:
            close(name, SIBLINGS[name])
        if name in VOID:
            continue
        element = Element(name, open_[-1] if open_ else None, m[3])
        if name in RAW:
            stop = RAW_END[name].search(html, at)
            at = end if stop is None else stop.start()
            stop = stop and html.find(">", at)
            at = end if stop is None or stop < 0 else stop + 1
        elif not m[3].endswith("/") or name not in ("svg", "math"):
            open_.append(element)
            count[name] += 1
    end_line()
    return lines


def spans(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[begin, end) from each surge to its dive."""
    sums, total = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        sums[i] = total
    found, begin = [], None
    for i, s in enumerate(sums):
        if begin is None and s >= surge:
            begin = i
        elif begin is not None and s == 0:
            found.append((begin, i))
            begin = None
    if begin is not None:
        found.append((begin, len(weights)))
    return found


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines of the text, an empty line between them."""
    lines = lines_of(html or "")
    best = max((article for _, _, article in lines), default=0)
    weights = [0 if article < best or not best and len(text) < 200 and RIGHTS.match(text) else chars + surge * (article > 0)
               for text, chars, article in lines]
    return "\n\n".join(lines[k][0] for begin, end in spans(weights, window, surge) for k in range(begin, end) if weights[k] > 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row a page; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
