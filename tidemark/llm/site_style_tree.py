"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of elements, known by their path of
tags and classes.  For each element the entropy over pages of its contents and
of its presentation (the elements within it) says how much it tells pages apart.
Branches of low importance are the site's furniture and are cut from every page,
beside what a page itself marks as furniture by tag, role or class.  A class is
evidence only: the block that holds most of a page's text stays, whatever its name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, free_name, small_batches, stored, text_column

# An element is judged if it stands on so many different pages of a host, and goes below this importance.
MIN_PAGES, LEAST_IMPORTANCE = 8, 0.1
# Share of the contents' entropy in the importance; the rest is the presentation's.
CONTENT_WEIGHT = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
# A start tag of the key ends an open element of the values, up to the nearest of the limits.
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
        "tfoot": {"tr", "td", "th", "tbody"}, **{h: {"p"} for h in ENDS_P if h not in ("li", "dt", "dd")}}
LIMITS = frozenset("ul ol dl table article section main div body html td th".split())
# What a page marks as no part of its article.
FURNITURE = frozenset(
    "head title script style noscript template nav aside footer form button select option input textarea iframe "
    "noembed noframes object embed svg canvas audio video dialog menu xmp".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation navi breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist replies respond disqus share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets "
    "toolbar pagination pager skip teaser".split())
# Words that stand beside those in a class, and say nothing against them.
NEUTRAL_WORDS = frozenset(
    "site main top bottom left right bar box block wrapper wrap container inner outer list item items section area slot "
    "unit link links buttons button global page header primary secondary form thread body text message panel strip "
    "post posts articles stories by google module content".split())
COMMENT_WORDS = frozenset("comment comments commentlist replies respond disqus".split())
# A marked block with more than this share of the page's text is its article, unless so much of it is links.
MOST_TEXT, MOST_LINKS = 0.5, 0.5
# These hold or are the article itself, and are never cut for low importance.
CONTENT = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre td th tr tbody".split())

_TAG = re.compile(
    r"<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?|[!?/][^>]*+>?)", re.S)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|$)", re.I)
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An element: its tag, its path's hash, whether the page marks it as furniture, children and texts in order."""

    __slots__ = ("tag", "path", "furniture", "named", "parts", "article")

    def __init__(self, tag: str, path: int, furniture: bool, article: bool, named: bool = False):
        self.tag, self.path, self.furniture, self.article, self.named = tag, path, furniture, article, named
        self.parts: list = []


def names_furniture(token: str) -> set[str]:
    """The furniture words of one class or id, if its other words are neutral; else none."""
    words = {w for w in _SPLIT.split(token) if w}
    return words & FURNITURE_WORDS if words <= FURNITURE_WORDS | NEUTRAL_WORDS else set()


def marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(class, furniture, article, named) of a start tag.

    Tag, role and hiding decide by themselves, as do classes of reader comments.
    Other classes only name a block as furniture, which :func:`settle` weighs;
    on inline elements they mean nothing.
    """
    if not attributes or attributes.isspace():
        return "", tag in FURNITURE, tag in ("article", "main"), False
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next((v for v in values if v), "").lower())
    role = found.get("role", "")
    words: set[str] = set()
    if tag in BLOCK and tag not in ("html", "body"):
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            words |= names_furniture(token)
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    furniture = tag in FURNITURE or hidden or role in FURNITURE_ROLES or not words.isdisjoint(COMMENT_WORDS)
    article = tag in ("article", "main") or role in ("main", "article")
    return found.get("class", ""), furniture, article, bool(words)


def settle(root: Node) -> Node:
    """Make named blocks furniture, except one that holds most of the page's text and is not mostly links."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        todo += [(x, linked) for x in node.parts if isinstance(x, Node) and not x.furniture]
    if not any(node.named for node, _ in order):
        return root
    size: dict[int, tuple[int, int]] = {}
    for node, linked in reversed(order):
        own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        inner = [size[id(x)] for x in node.parts if isinstance(x, Node) and not x.furniture]
        size[id(node)] = own + sum(x for x, _ in inner), own * linked + sum(x for _, x in inner)
    whole = size[id(root)][0]
    for node, _ in order:
        text, links = size[id(node)]
        if node.named and (text <= MOST_TEXT * whole or links > MOST_LINKS * text):
            node.furniture = True
    return root


def parsed(text: str) -> Node:
    """The page's tree; forgiving as browsers are about missing and stray end tags."""
    root = Node("", 0, False, False)
    stack, opened, at = [root], {}, 0
    hashed, search = xxhash.xxh3_64_intdigest, _TAG.search

    def close(n: int) -> None:
        for node in stack[n:]:
            opened[node.tag] -= 1
        del stack[n:]

    while True:
        m = search(text, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].parts.append(text[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                close(n)
            elif tag == "p":
                stack[-1].parts.append(Node("p", 0, False, False))
            continue
        if tag in ENDS and any(opened.get(x) for x in ENDS[tag]):
            n = len(stack) - 1
            while n and stack[n].tag not in LIMITS and stack[n].tag not in ENDS[tag]:
                n -= 1
            if n and stack[n].tag in ENDS[tag]:
                low = n
                while low > 1 and stack[low - 1].tag in ENDS[tag]:
                    low -= 1
                close(low)
        name, furniture, article, named = marks(tag, m[3])
        node = Node(tag, hashed(f"{stack[-1].path} {tag} {name}"), furniture, article, named)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            at = end.start() if end else len(text)
            if tag not in FURNITURE:
                node.parts.append(text[m.end():at])
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        elif tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(text):
        stack[-1].parts.append(text[at:])
    return settle(root)


class Element(NamedTuple):
    path: int
    content: int
    style: int


def elements(root: Node) -> tuple[int, list[Element]]:
    """A hash of the page's contents without furniture, and one element per path of a block that may be cut.

    Nodes of one path count as one element, with all their contents in order.
    """
    texts: dict[int, list[bytes]] = {}
    styles: dict[int, list[str]] = {}
    digest = xxhash.xxh3_64_digest
    own: list[bytes] = []
    # A node's content is the hash of its parts' hashes, so that deep trees cost no more than flat ones.
    stack: list = [(root, iter(root.parts), [], False)]
    while stack:
        node, parts, hashes, marked = stack[-1]
        for part in parts:
            if isinstance(part, Node):
                if part.parts:
                    stack.append((part, iter(part.parts), [], marked or part.furniture))
                    break
            elif not part.isspace():
                hashes.append(digest(part))
                if not marked:
                    own.append(hashes[-1])
        else:
            stack.pop()
            done = digest(b"".join(hashes)) if len(hashes) > 1 else hashes[0] if hashes else b""
            if node.tag in BLOCK and node.tag not in CONTENT:
                texts.setdefault(node.path, []).append(done)
                styles.setdefault(node.path, []).append(
                    "(" + " ".join([x.tag for x in node.parts if isinstance(x, Node)]) + ")")
            if stack and done:
                stack[-1][2].append(done)
    number = xxhash.xxh3_64_intdigest
    return number(b"".join(own)), [
        Element(p, number(b"".join(x)), number(" ".join(styles[p]))) for p, x in texts.items()]


def blocks(root: Node, cut: frozenset[int] = frozenset()) -> list[str]:
    """Blocks of the main text, in order.

    If the page has articles or a main element outside of furniture, only what is
    in them counts; else the whole body does, without the page's header.
    """
    def goes(node: Node) -> bool:
        return node.furniture or node.path in cut

    tops, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.article and node.tag != "main" and not node.furniture:
            tops.append(node)
        else:
            todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not goes(x)]
    if not tops:
        todo = [root]
        while todo:
            node = todo.pop()
            if node.article and not node.furniture:
                tops.append(node)
            else:
                todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not goes(x)]
    whole = not tops
    out: list[str] = []
    open_block: list[str] = []

    def end() -> None:
        words = " ".join(entities.unescape("".join(open_block)).split())
        open_block.clear()
        if words:
            out.append(words)

    for top in tops or [root]:
        stack = [iter([top])]
        ends: list[bool] = [False]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
                if ends.pop():
                    end()
            elif isinstance(part, str):
                open_block.append(part)
            elif part is not top and (goes(part) or whole and part.tag == "header"):
                if part.tag in BLOCK:
                    end()
            elif part.tag in ("br", "wbr"):
                open_block.append(" " if part.tag == "br" else "")
            else:
                block = part.tag in BLOCK
                if block:
                    end()
                stack.append(iter(part.parts))
                ends.append(block)
        end()
    return out


def host_of(url: Column) -> Column:
    """The lower-case host of a url; null stays null."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, copy, text in zip(*(c.to_pylist() for c in batch.columns)):
            page, found = elements(parsed(text))
            rows += [(host, copy, *(x - (1 << 63) for x in (page, *e))) for e in found]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), *[pa.int64()] * 5])],
                ["host", "copy", "page", "path", "content", "style"])


def entropy(rows: DataFrame, of: str) -> DataFrame:
    """Rows (host, path, n, entropy): pages and the entropy of ``of`` over them, from 0 to 1."""
    n = F.sum("c")
    return rows.groupBy("host", "path", of).agg(F.count(F.lit(1)).alias("c")).groupBy("host", "path").agg(
        n.alias("n"), F.when(n > 1, (F.log(n) - F.sum(F.col("c") * F.log("c")) / n) / F.log(n)).otherwise(1.0).alias(of))


def low_branches(pages: DataFrame, html: Column, url: Column, min_pages: int = MIN_PAGES,
                 least: float = LEAST_IMPORTANCE) -> DataFrame:
    """Rows (host, copy, cut): the paths of low importance among a page's elements; ``copy`` is the hash of its html.

    Pages with the same contents count once, so copies of an article do not make
    it furniture.  Every path on ``min_pages`` or more pages of a host is judged;
    a list holds a page's own elements only, however many the host has.
    """
    rows = stored(
        pages.select(host_of(url).alias("host"), F.xxhash64(html).alias("copy"), html.alias("html"))
        .filter("host is not null")
        .mapInArrow(_elements, "host string, copy bigint, page bigint, path bigint, content bigint, style bigint")
        .dropDuplicates(["host", "copy", "path"]))
    once = rows.dropDuplicates(["host", "page", "path"])
    content, style = entropy(once, "content"), entropy(once, "style").drop("n")
    importance = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("style")
    low = stored(
        content.join(style, ["host", "path"]).filter(F.col("n") >= min_pages).filter(importance < least)
        .select("host", "path"))
    return stored(rows.select("host", "copy", "path").join(low, ["host", "path"])
                  .groupBy("host", "copy").agg(F.sort_array(F.collect_list("path")).alias("cut")))


@F.arrow_udf(T.StringType())
def _extracted(pages: pa.Array, cuts: pa.Array) -> pa.Array:
    known: dict = {}
    out = []
    for text, cut in zip(pages.to_pylist(), cuts.to_pylist()):
        cut = tuple(cut or ())
        if cut not in known:
            known[cut] = frozenset(x + (1 << 63) for x in cut)
        out.append("\n\n".join(blocks(parsed(text or ""), known[cut])))
    return pa.array(out, pa.string())


def extracted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with two more columns (last): the main text and its number of code points.

    A null page is empty and has an empty text.  Pages without a host have no
    tree and are cut by their own marks alone.  Pages are read twice; of the
    hosts' trees only the low branches that stand on a page come back to it.
    """
    small_batches(pages)
    body = text_column(pages, html)
    h, k, c, t = (free_name(pages, x) for x in ("_host", "_copy", "_cut", "_text"))
    cuts = low_branches(pages, body, column(pages, url)).select(
        F.col("host").alias(h), F.col("copy").alias(k), F.col("cut").alias(c))
    same = (host_of(column(pages, url)) == F.col(h)) & (F.xxhash64(body) == F.col(k))
    out = pages.join(cuts, same, "left").withColumn(t, _extracted(body, F.col(c)))
    n = free_name(pages, "_n_chars")
    return out.withColumn(n, F.length(t).cast("long")).drop(h, k, c).select(
        *[column(pages, x) for x in pages.columns], t, n)
