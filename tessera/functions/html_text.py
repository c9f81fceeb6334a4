"""Titles and main text of HTML pages, in Arrow batches over the standard parser."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import clean_text
from tessera.functions.urls import decode_redirect, looks_blocked, should_fetch

# Elements that are dropped, that make blocks, and that never close.
DROPPED = frozenset("script style noscript svg canvas form button nav footer aside".split())
BLOCKS = frozenset("h1 h2 h3 p li".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEAST_BLOCK, LEAST_BODY = 40, 300
MOST_BODY = 800_000


class _Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "dropped")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None", dropped: bool = False) -> None:
        self.tag, self.attrs, self.parts, self.parent, self.dropped = tag, attrs, [], parent, dropped

    def walk(self):
        """All elements below, in the order of the page, but for dropped ones and what they hold."""
        stack = [iter(self.parts)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, _Node) and not x.dropped:
                yield x
                stack.append(iter(x.parts))

    def text(self) -> str:
        found = []
        stack = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                found.append(x)
            elif not x.dropped:
                stack.extend(reversed(x.parts))
        return " ".join(found)


class _Tree(HTMLParser):
    """Nests by tags as they come: a start tag opens an element, an end tag closes the nearest of its name.

    Open elements are counted by name, so that an end tag without a start is passed over at once.
    """

    def __init__(self, drop: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.drop, self.open = drop, Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs), self.at, tag in self.drop)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.parts.append(_Node(tag, dict(attrs), self.at, tag in self.drop))

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag]:
            self.open[self.at.tag] -= 1
            self.at, closed = self.at.parent, self.at.tag
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def page_text(html: str, fallback_title: str = "") -> tuple[str, str]:
    """Title and text: headings, paragraphs and list items of the article, main part or body that are long enough, else all its text."""
    tree = _Tree(DROPPED)
    tree.feed(html)
    tree.close()
    every = list(tree.root.walk())
    first = lambda tag: next((n for n in every if n.tag == tag), None)
    title = first("title")
    title = _clean(title.text()) if title else fallback_title
    meta = next((n for n in every if n.tag == "meta" and n.attrs.get("name") == "description"), None)
    described = _clean(meta.attrs.get("content") or "") if meta else ""
    root = first("article") or first("main") or first("body") or tree.root
    blocks = [t for t in (_clean(n.text()) for n in root.walk() if n.tag in BLOCKS) if len(t) >= LEAST_BLOCK]
    body = _clean(" ".join(blocks))
    if len(body) < LEAST_BODY:
        body = _clean(root.text())
    if described and described not in body:
        body = f"{described} {body}".strip()
    return title or fallback_title, body


@F.arrow_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def _extract(html: pa.Array, fallback: pa.Array) -> pa.Array:
    rows = [page_text(h or "", f or "") for h, f in zip(html.to_pylist(), fallback.to_pylist())]
    return pa.array([{"title": t, "text": b} for t, b in rows], pa.struct([("title", pa.string()), ("text", pa.string())]))


def extract_html(html: Column, fallback_title: Column | None = None) -> Column:
    """A struct of title and text."""
    return _extract(html, F.lit("") if fallback_title is None else fallback_title)


def _has(node: _Node, name: str) -> bool:
    return name in (node.attrs.get("class") or "").split()


def _first(node: _Node, test: Callable[[_Node], bool]) -> _Node | None:
    return next((n for n in node.walk() if test(n)), None)


def _inside(node: _Node, test: Callable[[_Node], bool]) -> bool:
    """Whether an element above is such a one."""
    while (node := node.parent) is not None:
        if test(node):
            return True
    return False


def _duckduckgo(block: _Node) -> tuple[_Node | None, _Node | None]:
    return _first(block, lambda n: _has(n, "result__a")), _first(block, lambda n: _has(n, "result__snippet"))


def _bing(block: _Node) -> tuple[_Node | None, _Node | None]:
    link = _first(block, lambda n: n.tag == "a" and _inside(n, lambda p: p.tag == "h2"))
    return link, _first(block, lambda n: n.tag == "p" and _inside(n, lambda p: _has(p, "b_caption"))) or _first(block, lambda n: n.tag == "p")


def _yahoo(block: _Node) -> tuple[_Node | None, _Node | None]:
    around = block.parent
    above = block
    while (above := above.parent) is not None:
        if above.attrs.get("data-yga") is not None:
            around = above
            break
    return _first(block, lambda n: n.tag == "a" and "href" in n.attrs), around


# What a result of each engine is, and the most characters of a snippet.
ENGINES: dict[str, tuple[Callable[[_Node], bool], Callable, int | None]] = {
    "duckduckgo": (lambda n: _has(n, "result"), _duckduckgo, None),
    "bing": (lambda n: n.tag == "li" and _has(n, "b_algo"), _bing, None),
    "yahoo": (lambda n: "compTitle" in (n.attrs.get("class") or ""), _yahoo, 500),
}

_RESULT = StructType([StructField("rank", IntegerType()), StructField("title", StringType()), StructField("href", StringType()), StructField("snippet", StringType())])


def result_blocks(html: str, engine: str = "duckduckgo") -> list[tuple[int, str, str, str]]:
    """(rank, title, href, snippet) of a result page: blocks with a link; ranks count blocks without one too."""
    is_block, parts, most = ENGINES[engine]
    tree = _Tree()
    tree.feed(html)
    tree.close()
    out = []
    for rank, block in enumerate((n for n in tree.root.walk() if is_block(n)), 1):
        link, snippet = parts(block)
        if link is not None:
            out.append((rank, _clean(link.text()), link.attrs.get("href") or "", _clean(snippet.text())[:most] if snippet else ""))
    return out


@F.arrow_udf(ArrayType(_RESULT))
def _blocks(html: pa.Array, engine: pa.Array) -> pa.Array:
    names = _RESULT.names
    rows = [[dict(zip(names, r)) for r in result_blocks(h, e)] if h and e in ENGINES else [] for h, e in zip(html.to_pylist(), engine.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("rank", pa.int32()), *((n, pa.string()) for n in names[1:])])))


def search_results(pages: DataFrame, limit: int = 10) -> DataFrame:
    """A row per result of result pages (html, engine and other columns): these other columns, title, url, snippet, provider and rank.

    The first ``limit`` results of a page whose link, behind the engine's redirect, is a web
    address.  A null page, and one of another engine, has none.
    """
    others = [c for c in pages.columns if c not in ("html", "engine")]
    found = F.transform(_blocks(F.col("html"), F.col("engine")), lambda r: F.struct(r["rank"].alias("rank"), r["title"].alias("title"), r["snippet"].alias("snippet"), decode_redirect(r["href"]).alias("url")))
    kept = F.slice(F.filter(found, lambda r: r["url"].rlike("^https?://")), 1, limit)
    return pages.select(*others, F.col("engine").alias("provider"), F.inline(kept)).select(*others, "title", "url", "snippet", "provider", "rank")


def fetched_documents(results: DataFrame, pages: DataFrame) -> DataFrame:
    """``results`` (title, url, snippet, provider and others) with what was fetched for each: title, text, status and whether there was a page.

    ``pages`` (url, status, content_type, body): one row a URL.  A page of a kind that isn't
    fetched, or that isn't there, leaves the snippet; so does a page that looks blocked.
    Bodies are cut at ``MOST_BODY`` characters; only HTML is parsed.
    """
    body = F.substring("body", 1, MOST_BODY)
    # A body is parsed where it is read, before the join: a page that many results share is parsed once.
    is_html = F.contains(F.lower("content_type"), F.lit("html"))
    parsed = pages.select("url", "status", F.lit(True).alias("fetched"), _extract(F.when(is_html, body), F.lit("")).alias("x"), is_html.alias("html"), F.when(~F.coalesce(is_html, F.lit(False)), clean_text(body)).alias("plain"))
    both = results.withColumn("wanted", should_fetch(F.col("url"))).join(parsed.withColumnRenamed("url", "page_url"), F.col("wanted") & (F.col("url") == F.col("page_url")), "left")
    own_title = F.when(F.col("html"), F.coalesce(F.nullif(F.col("x.title"), F.lit("")), F.col("title"))).otherwise(F.col("title"))
    own_text = F.when(F.col("html"), F.col("x.text")).otherwise(F.col("plain"))
    blocked = looks_blocked(F.col("status"), own_title, F.coalesce(own_text, F.lit("")))
    title = F.when(F.col("fetched") & ~blocked, own_title).otherwise(F.col("title"))
    text = F.when(F.col("fetched"), F.coalesce(F.nullif(F.when(blocked, clean_text(F.col("snippet"))).otherwise(own_text), F.lit("")), F.col("snippet"))).otherwise(F.col("snippet"))
    others = [c for c in results.columns if c not in ("title",)]
    return both.select(*others, F.coalesce(F.nullif(title, F.lit("")), F.col("title")).alias("title"), text.alias("text"), "status", F.coalesce("fetched", F.lit(False)).alias("fetched"))
