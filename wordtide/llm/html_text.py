"""Main text of web pages by site template removal.

1. A tolerant parser builds each page's element tree (implied end tags, void and raw-text elements,
   unclosed and stray tags).  Every container's subtree gets two 64-bit hashes: one of its tags and
   texts, and a *shape* of its tags and classes with texts masked, inline markup left out and equal
   children taken once, so menus of other entries and notices of other words are alike.
2. Spark counts, for each host, on how many distinct texts a subtree occurs: the copies of one
   article are one page.  Subtrees on at least `least_pages` such pages and on `share` of the host's
   (or `enough_pages`) are the site's template.  Shapes are counted only beside the page's densest
   branch (the chain of containers that hold half of its text), and are template only if they hold at
   most `most_text` of their pages' text on average, so the article's own parts are never candidates.
3. Each page is read again: template subtrees go.  Names break the tie where counting says nothing
   (a lone page, a comment in the article): elements whose tag, role or class as a whole names them
   menu, header, footer, sidebar, notice, advert, form or comments go too.  Of the rest the article
   (or main element, or else the body without link lists) gives the text, block by block.

Whatever stands in an article or main element is its text even if it recurs; elsewhere only
containers are template.  A page that holds nothing but template keeps that as its text.

A hot host is no hot task: counting is pre-aggregated by (host, hash), and what a page needs of its
host's template comes by joins on (host, hash) and on the page, never as a host's whole template.

Defined results: null or empty html gives an empty text; a null url is the host ''; repeated rows
are one page of the host; rows that repeat a page_id are each extracted; very long pages are parsed
whole (a tree of one page in memory); no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm.common import Scratch, table


@dataclass(frozen=True)
class Site:
    least_pages: int = 3
    share: float = 0.2
    enough_pages: int = 50
    most_text: float = 0.3  # a shape that holds more of its pages' text is no template
    link_density: float = 0.5  # without an article, blocks with a larger share of link text go
    names: bool = True  # whether tags, roles and classes break ties
    articles: bool = True  # whether article and main elements are the text


_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr caption ul search".split()
)
_CLOSES_P = _BLOCK - frozenset("body html legend li dd dt option optgroup tr tbody thead tfoot caption".split())
_CONTAINER = frozenset("div section ul ol dl table aside nav footer header form figure details blockquote center fieldset menu dialog".split())
_DENSE = _CONTAINER | frozenset("html body article main center tbody tr td".split())
_INLINE_END = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
_SCOPE = frozenset("html table td th caption button object template marquee applet".split())
#: An opening tag of the key ends an open element of these, if none of the second stands between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ()),
}
_DROP = frozenset("head title script style noscript template iframe object embed applet svg math canvas audio video map nav footer aside form button select datalist input textarea menu dialog search noembed noframes frameset".split())
_UNSEEN = frozenset("head title script style noscript template iframe object embed noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
_NAMES = frozenset(
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars widget widgets footer bottombar topbar masthead siteheader "
    "sitefooter cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts popup popover modal overlay lightbox interstitial paywall newsletter subscribe "
    "subscription signup signin login register ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored "
    "sponsorship promo promos promotion promotions outbrain taboola social share sharing sharebar shares addthis related relateds recommended recommendation recommendations "
    "readmore morefrom comment comments commentlist disqus respond replies discussion pagination pager paging skiplink toolbar copyright colophon searchform searchbox tagcloud hidden".split()
)
#: These name boilerplate only outside of an article: inside they may be what it is about.
_OUTSIDE = frozenset("header head top side rail foot legal search form trending popular reply skip hamburger".split())
#: What may stand beside a name in a class: with any other word the class is not taken for boilerplate.
_GENERIC = frozenset(
    "site page web main global local primary secondary reader readers user users visitor left right top bottom upper lower inner outer box boxes block blocks section sections wrap wrapper container "
    "list lists item items area areas slot slots unit units bar bars panel panels group holder region zone module component content body row col column header head title links link post posts story "
    "article articles js ui id my the is sticky fixed float mobile desktop small large big mini full new more bottombar first last form icons icon buttons button text message messages policy law info "
    "floating side thread threads entry entries feed center middle x".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names_boilerplate(name: str, in_article: bool) -> bool:
    """Whether a class or id as a whole names boilerplate: all of its parts are names or generic, one is a name."""
    known = _NAMES if in_article else _NAMES | _OUTSIDE
    if re.sub(r"[-_\d]+", "", name).lower() in known:
        return True
    parts = [p.lower() for p in _PARTS.findall(name)]
    return any(p in known for p in parts) and all(p in known or p in _GENERIC for p in parts)


class Node:
    __slots__ = ("tag", "attrs", "items", "parent", "hash", "shape", "size", "links", "main", "beside")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.hash = self.shape = self.size = self.links = 0
        self.main = False  # holds an article or main element
        self.beside = False  # stands beside the densest branch


def parse(source: str) -> Node:
    root = Node("html", "", None)
    here, at = root, 0

    def close(node: Node) -> None:
        nonlocal here
        here = node.parent or root

    match = _TOKEN.search
    while m := match(source, at):
        if m.start() > at:
            here.items.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["cdata"]:
                here.items.append(m["cdata"])
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            n = here
            while n is not root and n.tag != tag:
                if tag in _INLINE_END and n.tag in _BLOCK or n.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "html", "body", "article", "main", "section", "div"):
                    n = root
                    break
                n = n.parent
            if n is not root:
                close(n)
            elif tag == "br":
                here.items.append(Node("br", "", here))
            continue
        if tag in ("html", "body") and (tag == "html" or any(True for x in _up(here) if x.tag == "body")):
            continue
        if tag in _CLOSES_P:
            for n in _up(here):
                if n.tag == "p":
                    close(n)
                    break
                if n.tag in _SCOPE:
                    break
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            last = None
            for n in _up(here):
                if n.tag in ends:
                    last = n
                elif n.tag in stop:
                    break
            if last is not None:
                close(last)
        elif here.tag == "head" and tag not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            close(here)
        node = Node(tag, m["attrs"] or "", here)
        here.items.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            at = end.end()
        elif tag not in _VOID and not (m["attrs"] or "").endswith("/") or tag in _BLOCK and tag != "hr":
            here = node
    if at < len(source):
        here.items.append(html.unescape(source[at:]))
    return root


def _up(n: Node | None) -> Iterator[Node]:
    while n is not None:
        yield n
        n = n.parent


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)} if node.attrs.strip() else {}


def _is_main(n: Node) -> bool:
    return n.tag in ("article", "main") or (bool(n.attrs) and "main" in n.attrs and _attributes(n).get("role") == "main")


def measure(root: Node) -> None:
    """hash, shape, size (characters of text), links (those in links) and main of every element, bottom up; then beside."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [x for x in n.items if not isinstance(x, str)]
    for n in reversed(order):
        h = xxhash.xxh64(n.tag)
        n.main = _is_main(n)
        parts: dict = {}  # distinct parts of the shape, in order
        for x in n.items:
            if isinstance(x, str):
                words = x.split()
                if words:
                    h.update("\x01" + " ".join(words))
                    n.size += sum(map(len, words))
                    parts["text"] = None
            else:
                h.update(b"\x02" + x.hash.to_bytes(8, "little"))
                n.size += x.size
                n.links += x.links
                n.main |= x.main
                if x.tag == "a" or x.tag not in _INLINE_END and x.tag not in _VOID and x.size:
                    parts[x.shape] = None
                elif x.size:
                    parts["text"] = None
        h.update(b"\x03")
        n.hash = h.intdigest()
        n.shape = _shape(n, parts)
        if n.tag == "a":
            n.links = n.size
    _mark_beside(root)


def _mark_beside(root: Node) -> None:
    """Marks the containers beside the densest branch: the chain of containers that hold half of the page's text."""
    n = root
    while True:
        kids = [x for x in n.items if not isinstance(x, str) and x.size]
        dense = [x for x in kids if 2 * x.size >= root.size and x.tag in _DENSE]
        if not dense and n.tag not in ("html", "body"):
            return  # the main container: its own parts are the text
        for x in kids:
            x.beside = x not in dense and x.tag in _CONTAINER
        if not dense:
            return
        n = dense[0]


def _remeasure(root: Node) -> None:
    """size, links and beside again, of a tree that has lost some of its elements."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        n.beside = False
        order.append(n)
        stack += [x for x in n.items if not isinstance(x, str)]
    for n in reversed(order):
        n.size = sum(sum(map(len, x.split())) if isinstance(x, str) else x.size for x in n.items)
        n.links = n.size if n.tag == "a" else sum(x.links for x in n.items if not isinstance(x, str))
    _mark_beside(root)


def _shape(n: Node, parts: dict) -> int:
    a = _attributes(n) if n.attrs and n.tag in _CONTAINER else {}
    own = " ".join(sorted({re.sub(r"\d+", "", w).lower() for k in ("class", "id", "role") for w in a.get(k, "").split()}))
    return xxhash.xxh64_intdigest(f"shape\x01{n.tag}\x01{own}\x01" + "\x02".join(map(str, parts)))


def named_boilerplate(n: Node, in_article: bool) -> bool:
    if n.tag in _DROP:
        return not (n.main and n.tag in ("form", "aside"))
    if n.tag == "header":
        return not in_article and not n.main
    if not n.attrs or n.tag in ("html", "body", "article", "main") and n.tag != "article":
        return False
    a = _attributes(n)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return not n.main
    if n.main and not (n.tag == "article" and in_article):
        return False
    if a.get("role", "").lower() in _ROLES:
        return True
    if n.tag not in _BLOCK and n.tag not in ("span", "ins", "a"):
        return False
    return any(_names_boilerplate(w, in_article or n.tag == "p" or re.fullmatch("h[1-6]", n.tag) is not None) for w in (a.get("class", "") + " " + a.get("id", "")).split())


def prune(root: Node, template: frozenset[int] | set[int], site: Site = Site()) -> None:
    """Takes out the template's subtrees and what names itself boilerplate."""
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        keep = []
        for x in n.items:
            if isinstance(x, str):
                keep.append(x)
                continue
            if x.tag in _UNSEEN or site.names and named_boilerplate(x, inside):
                continue
            if template and not inside and x.tag in _CONTAINER and not (x.main and site.articles) and x.hash in template:
                continue
            keep.append(x)
            stack.append((x, inside or site.articles and _is_main(x)))
        n.items = keep
    if template:  # shapes only once repeated texts are gone, which may have been the densest branch
        _remeasure(root)
        stack = [root]
        while stack:
            n = stack.pop()
            n.items = [x for x in n.items if isinstance(x, str) or not (x.beside and x.shape in template) or x.main and site.articles]
            if not (site.articles and _is_main(n)):
                stack += [x for x in n.items if not isinstance(x, str)]


def roots(root: Node) -> list[Node]:
    """The outermost articles, or main elements, or nothing."""
    for tags in (("article",), ("main",)):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.tag in tags or "main" in tags and n.attrs and "main" in n.attrs and _attributes(n).get("role") == "main":
                if n.size:
                    found.append(n)
                continue
            stack += [x for x in reversed(n.items) if not isinstance(x, str)]
        if found:
            return found
    return []


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [(node, 0)]
    if node.tag in _BLOCK:
        end()
    while stack:
        n, i = stack.pop()
        if i >= len(n.items):
            if n.tag in _BLOCK:
                end()
            elif n.tag in ("td", "th"):
                run.append(" ")
            continue
        stack.append((n, i + 1))
        x = n.items[i]
        if isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in _BLOCK:
                end()
            stack.append((x, 0))
    end()
    return out


def _without_link_lists(n: Node, most: float) -> None:
    stack = [n]
    while stack:
        x = stack.pop()
        x.items = [y for y in x.items if isinstance(y, str) or not (y.tag in _CONTAINER and y.size and y.links > most * y.size and 2 * y.size < root_size(n))]
        stack += [y for y in x.items if not isinstance(y, str)]


def root_size(n: Node) -> int:
    return max(n.size, 1)


def extract(source: str | None, template: frozenset[int] | set[int] = frozenset(), site: Site = Site()) -> str:
    if not source:
        return ""
    root = parse(source)
    measure(root)
    text = _text(root, template, site)
    return text if text or not template else extract(source, frozenset(), site)


def _text(root: Node, template: frozenset[int] | set[int], site: Site) -> str:
    """The text of a measured tree, which is cut down to it."""
    prune(root, template, site)
    found = roots(root) if site.articles else []
    if not found:
        _without_link_lists(root, site.link_density)
        found = [root]
    return "\n".join(b for n in found for b in blocks(n))


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def candidates(root: Node) -> dict[int, float]:
    """By hash the distinct container subtrees of a measured tree (0.0), and the shapes beside its densest branch (their share of the text)."""
    seen: dict[int, float] = {}
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in _CONTAINER and n.size:
            seen[n.hash] = 0.0
            if n.beside:
                seen[n.shape] = seen.get(n.shape, 0.0) + n.size / root.size
        stack += [x for x in n.items if not isinstance(x, str)]
    return seen


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, body, hash, part) of the candidates of each page, and one row without a hash; body names its text."""
    for b in batches:
        host, page, body, out, part = [], [], [], [], []
        for h, p, source in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("html")):
            source = source.as_py()
            if not source:
                continue
            root = parse(source)
            measure(root)
            seen = candidates(root)
            host += [h] * (len(seen) + 1)
            page += [p] * (len(seen) + 1)
            body += [_signed(xxhash.xxh64_intdigest(_text(root, frozenset(), Site())))] * (len(seen) + 1)
            out += [*map(_signed, seen), None]
            part += [*seen.values(), 0.0]
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(body, pa.int64()), pa.array(out, pa.int64()), pa.array(part, pa.float64())], names=["host", "page", "body", "hash", "part"])


def templates(spark: SparkSession, pages: DataFrame, scratch: Scratch, site: Site = Site()) -> DataFrame:
    """(page, hashes) of the pages (page, host, html) that hold subtrees of their host's template."""
    found = scratch.keep(pages.select("host", "page", "html").mapInArrow(_containers, "host string, page long, body long, hash long, part double"), "subtrees")
    # copies of one text are one page of the host
    once = found.groupBy("host", "hash", "body").agg(F.max("part").alias("part"))
    counted = once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.avg("part").alias("part"))
    size = counted.filter("hash IS NULL").select("host", F.col("n").alias("host_pages"))
    often = counted.filter("hash IS NOT NULL").filter((F.col("n") >= site.least_pages) & (F.col("part") <= site.most_text))
    often = often.join(size, "host").filter(F.col("n") >= F.least(F.lit(site.enough_pages), F.ceil(F.col("host_pages") * site.share))).select("host", "hash")
    return found.join(often, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("hashes"))


def main_text(spark: SparkSession, pages: DataFrame, scratch: Scratch, site: Site = Site()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    keyed = pages.withColumn("host", host).withColumn("page", F.xxhash64("page_id", "url", "html"))
    joined = keyed.join(templates(spark, keyed, scratch, site), "page", "left").select("page_id", "url", "html", "hashes")

    @F.arrow_udf("string")
    def text(source: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([extract(s.as_py(), frozenset(x & 0xFFFFFFFFFFFFFFFF for x in h or ()), site) for s, h in zip(source, hashes.to_pylist())], pa.string())

    out = joined.select("page_id", "url", text.asNondeterministic()("html", "hashes").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, table(spark, sf_dir, "pages"), Scratch(spark, "pages"))
