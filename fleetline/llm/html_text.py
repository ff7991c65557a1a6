"""Main text of web pages, with a suffix array per host for boilerplate.

A page is cut into blocks, each with a region: inside the page's main container
(``article`` or ``main``), named boilerplate (by element, class, id or role), or
unnamed.  A class or id names an element by a whole word or its closing part
(``site-footer``, also ``related-posts``; not ``related-work`` or
``has-sidebar``).  What is or wraps the only container of a page is not named
by class or id, nor are headers and headings inside a container.  The token streams of everything outside main containers are joined
per host into a suffix array (suffixes dealt by host and first tokens, sorted,
compared with their neighbours); runs of ``MIN_RUN`` tokens or more that stand
in two distinct streams are repeated.  A page without a main container keeps
its unnamed blocks unless repeated runs cover them; a page with one keeps the
container's blocks.

Why the container is exempt: articles quote, copy and syndicate one another, so
their repeated runs are text, and the contract drops nothing of an article.

Equal streams of a host are merged before anything is dealt out, so a template
on a third of all pages is one row per input partition; a stream counts once
however many pages share it, so exact copies of a page do not erase each other.

Defined results: null or empty html gives empty text; a null url is a host of
its own; repeated rows are each reported; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 8
SUFFIX_TOKENS = 24
COVERED = 0.8

# Elements by role.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title", "head", "select", "math"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "header"}
CONTAINERS = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
          "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "title", "tr", "ul", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
         "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
         "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "related", "replies", "search", "share", "sharing",
         "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
# names of lists that hold articles of their own, parts that only say how an element is laid out, and first parts that tell a state
LISTS = {"comment", "comments", "disqus", "promo", "related", "replies", "sponsor", "sponsored"}
LAYOUT = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "group", "icons", "inner", "item", "items",
          "left", "link", "links", "list", "outer", "panel", "posts", "right", "section", "slot", "stories", "top", "unit", "wrap", "wrapper"}
STATES = {"has", "hide", "is", "no", "not", "show", "with", "without"}
HEADERS = {"banner", "header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINER = re.compile(r"<(?:article|main)\b", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

MAIN, NAMED, UNNAMED = 0, 1, 2


class Block(NamedTuple):
    region: int
    text: str


def _named_by_element(name: str, attributes: str, in_container: bool) -> bool:
    """Whether the element or its role is boilerplate."""
    if name in BOILERPLATE and not (name == "header" and in_container):
        return True
    return bool(attributes) and name not in ("html", "body") and any(
        kind.lower() == "role" and w in ROLES for kind, *values in _NAMED.findall(attributes) for w in _PARTS.split("".join(values).lower()))


def _names(name: str, attributes: str, in_container: bool) -> set[str]:
    """Boilerplate names in the class and id of an element."""
    out: set[str] = set()
    if not attributes or name in ("html", "body"):
        return out
    for kind, *values in _NAMED.findall(attributes):
        if kind.lower() == "role" or in_container and name in HEADINGS and kind.lower() == "id":
            continue
        for token in "".join(values).lower().split():
            parts = [w for w in _PARTS.split(token) if w]
            while len(parts) > 1 and (parts[-1] in LAYOUT or parts[-1][0].isdigit()):
                parts.pop()
            if parts and parts[-1] in NAMES and parts[0] not in STATES:
                out.add(parts[-1])
    if in_container:
        out -= HEADERS if name == "header" or name in HEADINGS else HEADERS - {"banner"}
    return out


class Wrappers(NamedTuple):
    holders: set[int]  # where elements begin that are or hold a container
    free: bool  # a container stands outside all named elements
    listed: bool  # a container stands outside all lists of other articles


def _wrappers(page: str) -> Wrappers:
    """Of the articles of a page, or of its main elements if it has none."""
    stack: list[tuple[str, int, bool, bool, bool]] = []  # open elements: name, start, and within them: free, listed, container
    opened: Counter[str] = Counter()
    holders: set[int] = set()
    found: dict[str, list[tuple[bool, bool]]] = {"article": [], "main": []}
    for m in _tags(page):
        end, name = m[1], m[2].lower()
        if end:
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if stack and stack[-1][0] in ("p", "li") and stack[-1][0] == name:
            opened[stack.pop()[0]] -= 1
        free, listed, inside = stack[-1][2:] if stack else (True, True, False)
        if free or listed:
            names = _names(name, m[3], inside)
            hard = name != "form" and _named_by_element(name, m[3], inside)
            free, listed = free and not hard and not names and name != "form", listed and not hard and not names & LISTS
        stack.append((name, m.start(), free, listed, inside or name in CONTAINERS))
        opened[name] += 1
        if name in CONTAINERS:
            for x in reversed(stack):
                if x[1] in holders:
                    break  # so are those around it
                holders.add(x[1])
            found[name].append((free, listed))
    of = found["article"] or found["main"]
    return Wrappers(holders, any(x for x, _ in of), any(x for _, x in of))


def _tags(page: str) -> Iterator[re.Match]:
    """Tags outside skipped and raw content."""
    at, skip = 0, None
    for m in _TAG.finditer(page):
        name = (m[2] or "").lower()
        if m.start() < at or not name:
            continue
        if skip is not None:
            if m[1] and name == skip or skip == "head" and name == "body":
                skip = None
                if name != "body":
                    continue
            else:
                if name in RAW and not m[1]:
                    at = _raw_end(page, name, m.end())
                continue
        if not m[1] and name in SKIPPED and not m[3].endswith("/"):
            if name in RAW:
                at = _raw_end(page, name, m.end())
            else:
                skip = name
            continue
        yield m


def page_blocks(page: str | None) -> list[Block]:
    """Non-empty blocks in page order, white space collapsed, references decoded."""
    page = page or ""
    blocks: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that change the region, with the region outside them
    region, depth, articles, at = UNNAMED, 0, 0, 0  # depth: open containers, articles: those that are no main
    wrap = _wrappers(page) if _CONTAINER.search(page) else Wrappers(set(), False, False)

    def is_boilerplate(name: str, attributes: str, start: int) -> bool:
        wraps = start in wrap.holders and not articles
        if _named_by_element(name, attributes, depth > 0) and not (name == "form" and wraps and not wrap.free):
            return True
        names = _names(name, attributes, depth > 0)
        if not names or not wraps:
            return bool(names)
        if names & LISTS:
            return wrap.listed or depth > 0 and name not in CONTAINERS
        return wrap.free and name not in CONTAINERS

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(Block(region, text))

    skip = None  # element whose content is not text
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw content
        if skip is None:
            held.append(page[at:m.start()])
        at = m.end()
        end, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        if skip is not None:
            if end and name == skip or skip == "head" and name == "body":
                skip = None
            elif name in RAW and not end:
                at = _raw_end(page, name, at)
            continue
        if not end and name in SKIPPED and not m[3].endswith("/"):
            if name in BLOCKS:
                close()
            if name in RAW:
                at = _raw_end(page, name, at)
            else:
                skip = name
            continue
        if name in BLOCKS:
            close()
        elif name == "br":
            held.append(" ")
        if end:
            if any(n == name for n, _ in stack):
                close()
                while stack:
                    n, region = stack.pop()
                    depth -= n in CONTAINERS
                    articles -= n == "article"
                    if n == name:
                        break
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if stack and stack[-1][0] in ("p", "li") and name in BLOCKS and stack[-1][0] == name:
            region = stack.pop()[1]  # an open paragraph or list item ends here
        inner = region
        if region != NAMED and is_boilerplate(name, m[3], m.start()):
            inner = NAMED
        elif name in CONTAINERS and region != NAMED:
            inner = MAIN
        if inner != region or name in CONTAINERS or any(n == name for n, _ in stack):
            close()
            stack.append((name, region))
            depth += name in CONTAINERS
            articles += name == "article"
            region = inner
    if skip is None:
        held.append(page[at:])
    close()
    return blocks


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the raw content of an element ends (behind its end tag)."""
    m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


def outside_tokens(blocks: list[Block]) -> list[str]:
    return [w for b in blocks if b.region != MAIN for w in b.text.split()]


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"), "html")


def host_streams(pages: DataFrame) -> DataFrame:
    """Distinct token streams ``(host, stream)`` of what stands outside main containers."""
    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(h, " ".join(outside_tokens(page_blocks(x)))) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
            rows = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["host", "stream"])

    return _pages(pages).select("host", "html").mapInArrow(streams, "host string, stream string").distinct()


def repeated_runs(streams: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Token positions of each stream that runs of ``min_run`` tokens shared with
    another stream of its host cover: rows ``(stream_key, covered array<int>)``."""
    s = streams.select("host", F.xxhash64("host", "stream").alias("stream_key"), F.split("stream", " ").alias("t"))
    s = s.where(F.size("t") >= min_run)
    suffixes = s.select("host", "stream_key", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("t") - min_run),
        lambda i: F.struct(i.alias("at"), F.array_join(F.slice(F.col("t"), i + 1, F.lit(SUFFIX_TOKENS)), " ").alias("suffix")))).alias("x"))
    suffixes = suffixes.select("host", "stream_key", "x.at", "x.suffix",
                               F.xxhash64("host", F.substring_index("x.suffix", " ", min_run)).alias("deal"))
    # equal suffixes are one row of the array, with the least and greatest stream they are in
    array = suffixes.groupBy("deal", "host", "suffix").agg(F.min("stream_key").alias("lo"), F.max("stream_key").alias("hi"))
    array = array.repartition("deal").sortWithinPartitions("host", "suffix")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours with ``min_run`` common tokens are one interval."""
        def shared(a: list[str], b: list[str]) -> int:
            n = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                n += 1
            return n

        open_: tuple | None = None  # host, deal, tokens of the last suffix, least and greatest stream
        for b in batches:
            out: list[int] = []
            for deal, host, suffix, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = suffix.split(" ")
                if open_ and open_[0] == host and shared(open_[2], tokens) >= min_run:
                    open_ = (host, open_[1], tokens, min(open_[3], lo), max(open_[4], hi))
                    continue
                if open_ and open_[3] != open_[4]:
                    out.append(open_[1])
                open_ = (host, deal, tokens, lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["deal"])
        if open_ and open_[3] != open_[4]:
            yield pa.RecordBatch.from_arrays([pa.array([open_[1]], pa.int64())], ["deal"])

    runs = array.select("deal", "host", "suffix", "lo", "hi").mapInArrow(scan, "deal long").distinct()
    hits = suffixes.select("stream_key", "at", "deal").join(runs, "deal", "left_semi")
    return hits.groupBy("stream_key").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def extract_main_text(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Rows ``(page_id, url, text, boilerplate_words, repeated_words)``."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("n", pa.int32())]))
        for b in batches:
            main, loose, stream, words = [], [], [], []
            for x in b.column(3).to_pylist():
                blocks = page_blocks(x)
                inside = [k.text for k in blocks if k.region == MAIN]
                main.append("\n".join(inside))
                rest, at = [], 0
                for k in blocks:
                    if k.region != MAIN:
                        n = len(k.text.split())
                        if k.region == UNNAMED and not inside:
                            rest.append({"text": k.text, "at": at, "n": n})
                        at += n
                loose.append(rest)
                words.append(at)
                stream.append(" ".join(outside_tokens(blocks)))
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array(main, pa.string()), pa.array(loose, kind),
                pa.array(stream, pa.string()), pa.array(words, pa.int32())],
                ["page_id", "url", "host", "main", "loose", "stream", "words"])

    p = _pages(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "html")
    p = p.mapInArrow(texts, "page_id long, url string, host string, main string, "
                            "loose array<struct<text:string,at:int,n:int>>, stream string, words int")
    p = p.select("page_id", "url", "main", "loose", "words", F.xxhash64("host", "stream").alias("stream_key"))
    j = p.join(repeated_runs(host_streams(pages), min_run), "stream_key", "left")
    covered = F.array_distinct(F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<int>")),
                                                     lambda i: F.sequence(i, i + F.lit(min_run - 1)))))
    j = j.select("page_id", "url", "main", "loose", "words", covered.alias("covered"))
    unique = F.filter("loose", lambda k: F.size(F.filter("covered", lambda c: (c >= k["at"]) & (c < k["at"] + k["n"]))) < COVERED * k["n"])
    text = F.when(F.size("loose") == 0, F.col("main")).otherwise(F.array_join(F.transform(unique, lambda k: k["text"]), "\n"))
    return j.select("page_id", "url", text.alias("text"), F.col("words").cast("long").alias("boilerplate_words"),
                    F.size("covered").cast("long").alias("repeated_words"))
