"""Main text of web pages, without what a site repeats on its pages.

Every page is read as a tree of elements. Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and
reader comments go by what their elements are or are called; if the page has an article, only that stays. Of what is
left, every block element's subtree (names and text, not attributes) is hashed, and Spark counts for each host on how
many different pages a subtree stands. A subtree on `share` of a host's pages, `pages` at least, is the site's template,
and its text goes from all of them. Pages of equal text count as one, so that copies of a page aren't its template.

Counts are by (host, subtree) with partial sums, so a host with a third of all pages is no hot key; the few templates of
each host come back to its pages, of frequent hosts by broadcast. Pages are parsed twice instead of being kept.

Defined cases: a null or empty page has an empty text, a null url no host and so no template. Broken markup: elements
end where the page or an element around them ends, `<p>` and list items where the next begins; a tag, comment or script
that never ends takes the rest of the page. Pages whose blocks are all the site's have an empty text. Repeated rows
give repeated rows. Long pages are parsed in time proportional to their length. Empty tables give empty results. Only
the four columns read are returned; others have no effect, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import skew, storage

#: Tags (with quoted values, which may hold `>`), comments, declarations. What never ends takes the rest.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I | re.A) for x in RAW}
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text. Others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead tr ul".split()
)
#: Elements that go with all their content; the header of an article keeps its headings.
GONE = frozenset("script style textarea title xmp iframe noembed noframes noscript head nav aside footer header form menu dialog template svg canvas object audio video map button select datalist search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What ends an open element of the same kind without an end tag: the elements, and those that they may not end across.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
#: Before these an open paragraph ends.
_ENDS_P = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr template".split())

#: Words in an element's id, class or role that tell what it is: these also inside articles, and what they hold stays out.
ASIDE = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adunit banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus gdpr menu modal "
    "navbar navigation nav newsletter notice notices pager pagination paywall popup promo promotion promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Names that stand for a page's header, footer or search as a whole.
PARTS = frozenset("header footer masthead topbar search searchform site-header site-footer page-header page-footer site-search login login-form search-form".split())
#: What an article inside cannot free.
_CLOSED = frozenset("comment comments commentlist disqus related recommended replies reply respond sidebar ad ads advert advertisement".split())
_WORD = re.compile(r"[^a-z0-9]+")


def called(attributes: str, name: str) -> tuple[bool, bool]:
    """Whether an element's id, class or role says that it is no part of the text, and if so, whether for good."""
    if "=" not in attributes or name in ("html", "body"):
        return False, False
    out = closed = False
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for token in (a or b or c).lower().split():
            if token.startswith(("has-", "with-", "no-", "without-", "js-")):
                continue
            parts = {token, *_WORD.split(token)}
            if token in PARTS or parts & ASIDE:
                out, closed = True, closed or bool(parts & _CLOSED)
    return out, closed


@dataclass(slots=True)
class Element:
    name: str
    first: int  # of its blocks
    gone: bool = False  # with all its content
    closed: bool = False  # gone for good, even if an article begins inside
    article: bool = False  # it is one, or in one
    header: bool = False  # in an article's header, of which only headings stay
    hashes: list = field(default_factory=list)


@dataclass(slots=True)
class Page:
    """Blocks of text in page order, whether each is in an article, and subtrees: (hash, first block, end)."""

    texts: list[str]
    inside: list[bool]
    subtrees: list[tuple[int, int, int]]


def parsed(source: str) -> Page:
    """What is left of a page when all that its elements show to be no part of the text is gone."""
    page = Page([], [], [])
    stack = [Element("", 0)]
    text: list[str] = []
    open_: Counter[str] = Counter()
    met_article = False
    at = 0

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                top = stack[-1]
                page.texts.append(words)
                page.inside.append(top.article)
                top.hashes.append(words)

    def close() -> None:
        flush()
        e = stack.pop()
        open_[e.name] -= 1
        if e.hashes:
            value = xxhash.xxh3_64_intdigest("\x00".join([e.name, *e.hashes])) - (1 << 63)
            page.subtrees.append((value, e.first, len(page.texts)))
            stack[-1].hashes.append(f"\x01{value}")

    def end(names: frozenset | set, bounds: frozenset) -> None:
        """Ends the innermost element of `names`, and all in it, unless one of `bounds` is met first."""
        if not any(open_[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    close()
                return
            if stack[k].name in bounds:
                return

    while m := _MARKUP.search(source, at):
        if m.start() > at and not stack[-1].gone and not (stack[-1].header and not any(e.name in HEADINGS for e in stack[-3:])):
            text.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in RAW and (name in BLOCKS or name in GONE):
                flush()
                end({name}, frozenset())
            continue
        if name in RAW:
            found = _RAW_END[name].search(source, at)
            at = found.start() if found else len(source)
            continue
        if name == "br":
            text.append(" ")
        if name in VOID and name != "hr":
            continue
        if name not in BLOCKS and name not in GONE:
            continue
        flush()
        if name in _ENDS_P:
            end({"p"}, frozenset({"table", "td", "th", "caption", "button"}))
        if name in _CLOSES:
            end(*_CLOSES[name])
        if name == "hr":
            continue
        above = stack[-1]
        e = Element(name, len(page.texts), above.gone, above.closed, above.article, above.header)
        out, closed = called(m[3], name)
        if name in ("article", "main"):
            # A form or a frame with a telling name may hold the whole page.
            if above.gone and not above.closed and not met_article:
                e.gone = False
            e.gone, e.closed = e.gone or closed, e.closed or closed
            e.article = not e.gone
            met_article |= e.article
        elif name == "header" and above.article:
            e.header = True
        elif name in GONE:
            e.gone, e.closed = True, e.closed or name != "form"
        elif out:
            e.gone, e.closed = True, e.closed or closed
        stack.append(e)
        open_[name] += 1
    if at < len(source) and not stack[-1].gone and not stack[-1].header:
        text.append(source[at:])
    while len(stack) > 1:
        close()
    flush()
    if any(page.inside):
        kept_to = [0]
        for x in page.inside:
            kept_to.append(kept_to[-1] + x)
        subtrees = [(h, kept_to[a], kept_to[b]) for h, a, b in page.subtrees if kept_to[b] > kept_to[a]]
        page = Page([t for t, x in zip(page.texts, page.inside, strict=True) if x], [True] * kept_to[-1], subtrees)
    return page


def without(page: Page, templates: frozenset | set) -> str:
    """The page's text without the blocks of subtrees in `templates`."""
    gone = set()
    for h, a, b in page.subtrees:
        if h in templates:
            gone.update(range(a, b))
    return "\n\n".join(t for i, t in enumerate(page.texts) if i not in gone)


def host(url):
    """What stands in a url between the first `://` and the next `/`, `?` or `#`, lower-cased; null if nothing does."""
    found = F.translate(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found != "", found)


def subtree_rows(pages: DataFrame) -> DataFrame:
    """(host, page, subtree): each subtree of a page once; a page is known by its text, subtree null stands for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for where, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = parsed(source or "")
                if not page.texts:
                    continue
                digest = xxhash.xxh3_64_intdigest("\n\n".join(page.texts)) - (1 << 63)
                own = {h for h, *_ in page.subtrees}
                out[0].extend([where] * (len(own) + 1))
                out[1].extend([digest] * (len(own) + 1))
                out[2].extend([None, *own])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["host", "page", "subtree"])

    return storage.mapped(pages.where("host is not null and html <> ''").select("host", "html"), run, "host string, page long, subtree long").distinct()


def templates(pages: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """(host, pages, subtrees): of every host how many different pages it has and which subtrees are its template.

    Each of those is on `share` of the pages, so there are no more than 1 / share times the subtrees of a page.
    """
    counts = storage.written(subtree_rows(pages).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("subtree").isNull() | (F.col("n") >= least)), "subtrees")
    hosts = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = skew.met(counts.where("subtree is not null"), hosts, ["host"], "pages").where(F.col("n") >= F.col("pages") * share)
    found = often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))
    return storage.written(hosts.join(found, "host", "left"), "templates")


def extracted(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least: int = 5, share: float = 0.5) -> DataFrame:
    """(`key`, `url`, text, n_chars) of every row of `df`."""
    pages = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), host(F.col(url)).alias("host"))
    known = templates(pages, least, share).where("subtrees is not null")
    some = known.select("host", "pages", "subtrees")
    # Only pages of hosts with templates need them; the frequent ones of those hosts get them by broadcast.
    total = some.agg(F.sum("pages")).first()[0] or 0
    often = F.col("pages") * skew.HEAD > F.lit(total)
    frequent, rare = some.where(often).select("host", "subtrees"), some.where(~often).select("host", "subtrees")
    ready = pages.join(F.broadcast(frequent), "host", "left")
    if not rare.isEmpty():
        ready = ready.withColumnRenamed("subtrees", "_own").join(rare, "host", "left").withColumn("subtrees", F.coalesce("_own", "subtrees"))
    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without(parsed(s or ""), set(t or ())) for s, t in zip(b.column("html").to_pylist(), b.column("subtrees").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return storage.mapped(ready.select("key", "url", "html", "subtrees"), run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
