"""6. HTML extraction with site template removal.

templates() hashes the element subtrees of every page, counts in Spark on how many pages of a host each one stands, and keeps
those that recur on a large share of them. main_text() deletes such subtrees, and elements that by tag, role or class are
menus, headers, footers, side bars, notices, adverts, forms, scripts, styles or comments; what is left of the page's article
(or main element, or body) is its text.

Blocks inside the article are candidates too, but count by distinct article texts, not by pages: copies of one article on a
host are no template. Headings, cells, list items and inline elements inside the article are none, as they recur in main text.

Rows: null html is empty and gives the empty text; a null url counts as a host of its own. Repeated pages each have their row.
Broken markup never fails: an end tag without a start is ignored, an element that is left open ends with its parent. Only the
named columns are read. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A subtree is a template if it stands on so many pages of its host, and on this share of them.
MIN_PAGES, SHARE = 5, 0.5
#: Templates in one broadcast (some 50 bytes each); more are joined by host.
BROADCAST = 500_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Any attribute; values are consumed whole, so names inside them are none.
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Their content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
NOT_MAIN = {"nav", "aside", "footer", "form", "script", "style", "head", "noscript", "template", "iframe", "svg", "canvas", "object", "button", "select", "textarea", "dialog", "menu", "audio", "video", "title"}
NOT_MAIN_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "respond", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer",
    "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary",
}
#: Elements inside the article that can be templates.
INNER = {"address", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer", "header", "ol", "p", "pre", "section", "table", "ul"}
#: These are site furniture only outside the article.
OUTER_WORDS = {"header", "masthead", "topbar", "banner"}
#: Inside the article their ids and classes never say that they are no main text.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
#: Start tags that end an open element of the same kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"article", "main", "body", "html", "table", "section", "ul", "ol", "dl", "div", "nav", "aside", "footer", "header", "form"}


class Element:
    """An element: other says that it is no main text, off that it or one around it is; in_main that it stands inside an article or main, the outermost of which is around."""

    __slots__ = ("tag", "parent", "other", "off", "main", "in_main", "around", "holds_main", "parts", "hash")

    def __init__(self, tag: str, parent: "Element | None", other: bool, main: bool, said: str):
        self.tag, self.parent, self.other, self.main, self.holds_main = tag, parent, other, main, False
        self.off = other or parent is not None and parent.off
        self.in_main = parent is not None and (parent.main or parent.in_main)
        self.around: Element | None = None if parent is None else parent.around or (parent if parent.main else None)
        self.parts, self.hash = [said], 0

    def close(self) -> None:
        """The hash of the subtree: of its start tag, its texts (white space aside) and its elements' hashes, in order."""
        self.hash = xxhash.xxh64_intdigest("\0".join(self.parts)) - (1 << 63)
        self.parts = []
        if self.parent is not None:
            self.parent.parts.append(str(self.hash))


def _other(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether tag, role, class or id say that an element is no main text.

    Outside the article any part of a name counts (site-footer). Inside it only whole names do, ids of sections (made from
    titles) and names of headings and paragraphs do not; what else recurs there is left to the counts.
    """
    if tag in NOT_MAIN or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name not in ("class", "id", "role") or in_main and name != "role" and (tag in TEXT or name == "id" and tag == "section"):
            continue
        words = set(value.split() if in_main else re.split(r"[^a-z0-9]+", value))
        if words & NOT_MAIN_WORDS or not in_main and words & OUTER_WORDS:
            return True
    return False


def parsed(page: str) -> tuple[list[Element], list[tuple[int, int, Element, bool]]]:
    """The elements, and the pieces of text as (start, end, element, whether a new block begins before it)."""
    root = Element("", None, False, False, "")
    elements, pieces, stack, at, block = [], [], [root], 0, True
    n, low = len(page), None

    def close(to: int) -> None:
        while len(stack) > to:
            stack.pop().close()

    def say(a: int, b: int) -> None:
        nonlocal block
        if b > a:
            pieces.append((a, b, stack[-1], block))
            block = False
            if said := " ".join(page[a:b].split()):
                stack[-1].parts.append(said)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(at, n)
            break
        say(at, m.start())
        here, at = m.start(), m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK:
            block = True
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        said = " ".join(m.group().split())
        if tag == "br":
            pieces.append((here, here, stack[-1], False))
        if tag in VOID:
            stack[-1].parts.append(said)
            continue
        if tag in BLOCK or tag in ENDS:
            ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        other = _other(tag, attrs, stack[-1].main or stack[-1].in_main)
        e = Element(tag, stack[-1], other, tag in ("article", "main") and not other, said)
        elements.append(e)
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            at, was = n if end < 0 else (page.find(">", end) + 1 or n), at
            e.parts.append(" ".join(page[was:at].split()))
            e.close()
        elif not attrs.endswith("/") or tag in BLOCK:
            stack.append(e)
        else:
            e.close()
    close(1)
    for e in elements:
        if e.main and not e.off:
            p = e.parent
            while p is not None and not p.holds_main:
                p.holds_main = True
                p = p.parent
    return elements, pieces


def host_of(col: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(col, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _outer(elements: list[Element]) -> list[Element]:
    """Subtrees that can be templates: those neither around nor inside the article."""
    return [e for e in elements if not e.holds_main and not e.main and not e.in_main]


def _inner(elements: list[Element]) -> list[Element]:
    """Subtrees inside the article that can be templates."""
    return [e for e in elements if e.around is not None and e.tag in INNER and not e.main and not e.holds_main]


def templates(pages: DataFrame, *, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash, inner, n_pages): subtrees on min_pages pages of the host at least, and on this share of its pages.

    inner: the subtree stands inside the article; then pages with one article text count once.
    """
    out = T.StructType([T.StructField("host", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("article", T.LongType()), T.StructField("n", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int | None, int | None], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                elements = parsed(page)[0] if page else []
                found: set[tuple[int | None, int | None]] = {(e.hash, None) for e in _outer(elements)}
                found |= {(e.hash, e.around.hash) for e in _inner(elements)} | {(None, e.hash) for e in elements if e.main}
                for h, x in ((None, None), *found):
                    counts[host, h, x] = counts.get((host, h, x), 0) + 1
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))), pa.array(list(counts.values()), pa.int64())], names=out.names)

    seen = pages.select(host_of().alias("host"), "html").mapInArrow(step, out).groupBy("host", "hash", "article").agg(F.sum("n").alias("n"))
    inner = F.col("article").isNotNull().alias("inner")
    sums = seen.groupBy("host", "hash", inner).agg(F.sum(F.when(F.col("article").isNull(), F.col("n")).otherwise(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    sums = sums.persist()
    of_host = sums.where(F.col("hash").isNull()).select("host", "inner", F.col("n_pages").alias("all"))
    return sums.where(F.col("hash").isNotNull()).join(of_host, ["host", "inner"]).where(F.col("n_pages") >= F.col("all") * share).select("host", "hash", "inner", "n_pages")


def extracted(page: str | None, drop: set[tuple[int, bool]]) -> str:
    """The main text of one page; subtrees whose (hash, whether inside the article) is in drop are left out."""
    if not page:
        return ""
    elements, pieces = parsed(page)
    out = {id(e) for e in elements if e.other}
    if drop:
        out |= {id(e) for e in _outer(elements) if (e.hash, False) in drop}
        out |= {id(e) for e in _inner(elements) if (e.hash, True) in drop}
    gone: set[int] = set()  # elements stand after those around them
    for e in elements:
        if id(e) in out or id(e.parent) in gone:
            gone.add(id(e))
    live = [e for e in elements if e.main and id(e) not in gone]
    tags = {"article"} if any(e.tag == "article" for e in live) else {"main"} if live else set()
    inside: set[int] = set()
    for e in elements:
        if e.main and e.tag in tags or id(e.parent) in inside:
            inside.add(id(e))

    def counts(e: Element) -> bool:
        return id(e) not in gone and (not tags or id(e) in inside)

    blocks: list[list[str]] = [[]]
    for a, b, e, fresh in pieces:
        if fresh:
            blocks.append([])
        if counts(e):
            blocks[-1].append(html.unescape(page[a:b]) if b > a else " ")
    said = (" ".join("".join(x).split()) for x in blocks)
    return "\n\n".join(x for x in said if x)


def main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, share: float = SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    found = templates(pages, min_pages=min_pages, share=share).persist()
    out = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    some = pages.select("page_id", "url", host_of().alias("host"), "html")
    if found.count() <= broadcast:
        by_host: dict[str, set[tuple[int, bool]]] = {}
        for r in found.collect():
            by_host.setdefault(r.host, set()).add((r.hash, r.inner))
        shared = spark.sparkContext.broadcast(by_host)
        rows, drops = some, lambda batch: [shared.value.get(h, set()) for h in batch.column(2).to_pylist()]
    else:  # the hashes of one host are few: each stands on a large share of its pages
        rows = some.join(found.groupBy("host").agg(F.collect_list(F.struct("hash", "inner")).alias("hashes")), "host", "left").select("page_id", "url", "host", "html", "hashes")
        drops = lambda batch: [{(h["hash"], h["inner"]) for h in x or ()} for x in batch.column(4).to_pylist()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extracted(page, drop) for page, drop in zip(batch.column(3).to_pylist(), drops(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    return rows.mapInArrow(step, out)
