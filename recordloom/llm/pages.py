"""Main text of web pages, with template removal by host.

A page is read into a tree of elements, and its block elements are hashed with
all that lies below them. Spark counts the hashes per host, once for each
different main text (so that copies of one page don't make a template of it).
Subtrees that recur in many of the host's pages are deleted wherever they stand:
menus, headers, footers, sidebars, notices. Inside a marked article only
containers are candidates, not its paragraphs: a passage that many articles
quote is part of them.

In what is left, the article element with the most text is the root, else the
body. Parts that recur too little to be counted out, but say by their tag, role,
class or id that they are menus, headers, footers, sidebars, notices, adverts,
forms or comments are left out too. A class or id says so by a whole name or a
fixed compound ("comment-list", "site-header"), not by any name that has the
word in it ("has-sidebar", "comments-open"), and one that speaks of layout
leaves out no article or main element and nothing that holds one.

A template occurs in MIN_PAGES pages of its host and in SHARE of them, which is
small, so that rotating notices and those of a section count. The hosts' lists
are broadcast if none is longer than LONGEST and all are under BROADCAST_BYTES;
else the pages' subtrees are joined to the templates by host and hash, and a page
gets those of its own.

Defined cases: null html counts as empty; a page without tags is its text; a
null url is a host of its own; equal pages get the same text; of articles of
equal length the first in the page is taken; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise, strings

MIN_PAGES, SHARE = 5, 0.01
BROADCAST_BYTES, LONGEST = 16 << 20, 500

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s\x1c-\x1f]+")

RAW = set("script style noscript template iframe svg math object textarea title select canvas video audio".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("div section ul ol dl table aside figure nav header footer details form center fieldset".split())
_BLOCKS = BLOCK - {"html", "body", "main", "article", "br", "hr"}
DROPPED = set("nav footer aside form button dialog menu head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that an opening tag of the kind ends (fixed values, after the HTML standard).
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Names in class or id that mark a part as no main text, as a whole name or in a compound below (fixed values).
_ASIDE = set("ad ads advert adverts advertisement advertising promo promotion sponsor sponsored comment comments disqus reply replies related recommended".split())
_MARKS = _ASIDE | set(
    "banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "share sharing social newsletter subscribe subscription signup login widget toolbar pagination pager skip copyright disclaimer".split())  # fmt: skip
#: What may stand before or after a mark, joined by a hyphen or an underscore.
_BEFORE = set("site main top bottom left right primary secondary global page web blog cookie cookies gdpr privacy social share post article user mobile sub side".split())
_AFTER = set("list bar box block section area wrapper wrap container inner links link items item buttons button icons icon form content body text posts post articles stories news notice banner popup modal overlay message menu nav navigation widget widgets slot unit top bottom left right main primary secondary".split())
#: Headers that belong to the text.
_TITLES = {f"{x}{sep}header" for x in ("page", "post", "article", "entry", "main") for sep in "-_"}


def _marked(value: str) -> set[str]:
    """The marks among the names of a class or an id."""
    found = set()
    for name in value.lower().split():
        parts = re.split(r"[-_]+", name)
        at = next((i for i, x in enumerate(parts) if x in _MARKS), None)
        if at is not None and name not in _TITLES and all(x in _BEFORE for x in parts[:at]) and all(x in _AFTER or x in _MARKS for x in parts[at + 1 :]):
            found.add(parts[at])
    return found


class Node:
    """An element. size: characters of text below it, without what is left out; own: what it and all below it say, as it goes into hashes; hash: a candidate's hash of that."""

    __slots__ = ("tag", "parent", "items", "drop", "main", "layout", "size", "own", "hash")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, main: bool = False, layout: bool = False):
        self.tag, self.parent, self.items, self.drop, self.main, self.layout, self.size, self.own, self.hash = tag, parent, [], drop, main, layout, 0, "", 0


def _flags(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether the element is left out, whether it is marked as main text, and whether it is left out only unless it holds main text."""
    drop, main, names = tag in DROPPED, tag in ("article", "main"), set()
    if attributes.strip(" /"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names |= _marked(value) if tag not in ("html", "body", "main", *HEADINGS) else set()
            elif name == "role":
                drop |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif name == "itemprop":
                main |= value == "articleBody"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                drop |= tag not in ("html", "body")
            elif name == "style":
                drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
    layout = not drop and bool(names) and not names & _ASIDE
    if main and layout:
        return False, True, False
    drop |= bool(names)
    return drop, main and not drop, layout


_AROUND_P = {"p", *CONTAINERS, "article", "main", "body", "td", "li", "blockquote"}
_AROUND_ITEMS = set("ul ol table dl select article body".split())


def parse(html: str) -> Node:
    """The tree of a page. Text is kept as strings among a node's items."""
    root = Node("", None)
    stack, count = [root], Counter()  # the open elements, and how many there are of each tag

    def close(i: int) -> None:
        for node in stack[i:]:
            count[node.tag] -= 1
        del stack[i:]

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if count[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            elif tag == "p":
                stack[-1].items.append(Node("p", stack[-1]))
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if not attributes.endswith("/"):
                at = end.end() if end else len(html)
            continue
        if tag in BLOCK and count["p"]:  # an open paragraph ends before a block
            i = len(stack) - 1
            while i and stack[i].tag not in _AROUND_P:
                i -= 1
            if stack[i].tag == "p":
                close(i)
        if tag in ENDS and any(count[x] for x in ENDS[tag]):
            i = len(stack) - 1
            while i and stack[i].tag not in ENDS[tag] and stack[i].tag not in _AROUND_ITEMS:
                i -= 1
            while i and stack[i].tag in ENDS[tag]:
                close(i)
                i -= 1
        here = stack[-1]
        node = Node(tag, here, *_flags(tag, attributes))
        here.items.append(node)
        if node.main:  # what holds main text isn't left out for its name
            over = here
            while over is not None and over.tag != "article" and not over.main:
                over.drop &= not over.layout
                over = over.parent
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            count[tag] += 1
    if at < len(html):
        stack[-1].items.append(html[at:])
    return root


def _bottom_up(root: Node) -> list[Node]:
    """All elements below a node, those further in first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if not isinstance(x, str)]
    return order[::-1]


def main_node(root: Node) -> tuple[Node, bool]:
    """The element that holds the main text, and whether it is marked as such. Sets the sizes of all elements."""
    for node in _bottom_up(root):
        node.size = sum(len(x.strip()) if isinstance(x, str) else 0 if x.drop else x.size for x in node.items)
    best, found = root, False
    while True:
        marked, todo = [], [best]
        while todo:
            for x in todo.pop().items:
                if not isinstance(x, str) and not x.drop:
                    (marked if x.main else todo).append(x)
        top = max(marked, key=lambda x: x.size, default=None)
        # a main element may hold the article
        if top is None or not top.size or found and 2 * top.size < best.size:
            return best, found
        best, found = top, True
        if best.tag == "article":
            return best, True


def _digest(data: str) -> int:
    return xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


def candidates(root: Node, main: Node, marked: bool) -> list[Node]:
    """Elements that may be templates, with their hashes set: containers, and on a page without a marked article any block.

    An element without text has no part in a hash. Only candidates are hashed; others stand in it as they are.
    """
    tags, out = CONTAINERS if marked else _BLOCKS, []
    for node in _bottom_up(root):
        parts = [" ".join(x.split()) if type(x) is str else x.own for x in node.items]
        inner = "\x00".join([x for x in parts if x])
        if not inner:
            node.own = ""
        elif node.tag in tags and node is not main:
            node.hash = _digest(f"{node.tag}\x01{inner}")
            node.own = f"\x02{node.hash}"
            out.append(node)
        else:  # long ones are hashed as well, so that deep nesting costs no more than its length
            node.own = f"{node.tag}\x01{inner}" if len(inner) < 4096 else f"\x02{_digest(inner)}"
    return out


def walk(top: Node, marked: bool) -> list[str]:
    """Blocks of text below a node."""
    blocks: list[list[str]] = [[]]
    todo: list = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            blocks[-1].append(x)
        elif x is None:
            blocks.append([])
        else:
            if x is not top and x.drop:
                blocks += [[]] if x.tag in BLOCK else []
                continue
            if x.tag == "header":
                items = [y for y in x.items if not isinstance(y, str) and y.tag in HEADINGS] if marked else []
            else:
                items = x.items
            if x.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo += reversed(items)
    texts = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return [t for t in texts if t]


def page_hashes(html: str) -> tuple[str, list[int]]:
    """The text of a page as it is without its host, and the hashes of its candidates for templates."""
    root = parse(html)
    node, marked = main_node(root)
    return "\n".join(walk(node, marked)), sorted({x.hash for x in candidates(root, node, marked)})


def page_text(html: str, known: frozenset) -> str:
    """The text of a page without the templates of its host."""
    root = parse(html)
    node, marked = main_node(root)
    if known:
        gone = [x for x in candidates(root, node, marked) if x.hash in known]
        for x in gone:
            x.drop = True
        if gone:
            node, marked = main_node(root)
    return "\n".join(walk(node, marked))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("\x00"))


def _node(html):
    return F.unhex(F.md5(F.coalesce(html, F.lit(""))))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, node (digest of the html), sig (digest of the main text) and candidate hashes of every page."""

    def hash_page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, at, html in zip(pdf["host"], pdf["node"], strings(pdf["html"])):
                text, found = page_hashes(html)
                out.append((host, at, _digest(text), found))
            yield pd.DataFrame(out, columns=["host", "node", "sig", "hashes"])

    return pages.select(_host(F.col("url")).alias("host"), _node(F.col("html")).alias("node"), "html").mapInPandas(hash_page, "host string, node binary, sig long, hashes array<long>")


def templates(seen: DataFrame) -> DataFrame:
    """host and hash of the template subtrees."""
    once = seen.select("host", "sig", "hashes").dropDuplicates(["host", "sig"])
    totals = seen.groupBy("host", "sig").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = once.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    return counted.join(totals, "host").where(F.col("n") >= SHARE * F.col("pages")).select("host", "hash")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    seen = materialise(subtrees(pages))
    found = materialise(templates(seen))
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    size, longest = sizes.agg(F.sum(F.length("host") + 8 * F.col("n")), F.max("n")).first()
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"), _node(F.col("html")).alias("node"))
    if (size or 0) <= BROADCAST_BYTES and (longest or 0) <= LONGEST:
        lists = found.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:
        own = seen.select("host", "node", "hashes").dropDuplicates(["host", "node"]).select("host", "node", F.explode("hashes").alias("hash"))
        own = own.join(found, ["host", "hash"]).groupBy("host", "node").agg(F.sort_array(F.collect_list("hash")).alias("templates"))
        joined = rows.join(own, ["host", "node"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [page_text(html, frozenset(known.tolist()) if known is not None else frozenset()) for html, known in zip(strings(pdf["html"]), pdf["templates"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out, "n_chars": [len(x) for x in out]})

    return joined.select("page_id", "url", "html", "templates").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
