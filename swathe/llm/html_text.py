"""Main text of web pages with site templates removed.

Pass 1 hashes the subtree of every block element in the content of every page and counts per host among how many different contents
each one stands. Its context on a page are the two longest blocks outside it, so copies of a page, near ones too, count once and what is copied with
its surroundings is no template. Pass 2 parses each page again and deletes
what the page itself marks as no content (by element, role, or the words of a class name or id) and the subtrees that recur across many pages of
its host. Which article or main element is the content is told by the amounts of text. Each recurring subtree is judged by itself: it goes only if it is 30 % of the content at most, half of it on pages without article or main,
and a page is never emptied. A template among whose surroundings the two longest blocks are templates too is not told from a copy. Blocks come in page order, one line each.

Defined cases: null or empty html gives empty text; a null url has no host and no template. Repeated rows each give a row (and count as one
page). Unclosed, misnested and truncated markup is read like browsers do: what stays open ends with the page. White space is what
``str.split`` splits at; a ``br`` is white space inside its block. Empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, small_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = set("script style noscript template head title nav footer aside form button select textarea input iframe svg canvas object menu dialog noframes header".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: elements that never hold text of the page
HARD = set("script style noscript template head title textarea select button input iframe svg canvas object noframes".split())
#: words in a class or id that mark what is not the article, wherever they stand in its name, and those that do so as its last word or its only one
MARKS = set(
    "ad ads adbox adsense adslot banner banners sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs crumbs masthead cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing shares social"
    " related widget widgets toolbar pagination pager comment comments commentlist reply replies disqus respond popup modal overlay notice notices alert skip skiplink".split()
)
STEMS = ("advert", "sponsor", "promo", "recommend")
LAST = set("header footer foot side aside hidden".split())
#: marking words that may as well be what an article is about, if its name has another word than those of boxes: they mark prose of an article only with support (``PROSE``)
TOPICS = set("ad ads menu menus share sharing shares social related alert notice notices subscription banner reply replies".split())
BOXES = set("box boxes list lists container wrapper wrap bar bars block blocks link links button buttons icon icons item items area section group row col column grid panel inner outer top bottom left right main page site post posts article articles story stories entry content text title header footer widget widgets area unit slot x".split())
#: characters from which an element is prose, and the share of them in links up to which it is
PROSE, LINKED = 800, 0.2
#: first words of names that tell a state, and of names of the article's own parts
STATES = set("has no not with without is are show shows hide hides js can uses supports enable disable".split())
PARTS = set("entry post article story content text section chapter page main body title".split())
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
FLOW = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
CONTENT = set("content main main-content page-content".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption"}
LIMITS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
WHOLE = {"html", "body", "main", "article"}
HOST_PARTS = 32
#: of the text beside a marked element without which the page would have nothing, of the largest article for one to belong to the text, and of a main for its articles to stand for it
REST, LEAST_ARTICLE, MOST_OF_MAIN = 0.2, 0.25, 0.6


def parse(page: str) -> tuple[list[tuple[str, str, int]], list[list]]:
    """Nodes (tag, attributes, parent) in page order, the first a root, and each one's items: node numbers and texts."""
    nodes: list[tuple[str, str, int]] = [("#root", "", -1)]
    items: list[list] = [[]]
    stack = [0]
    open_tags: dict[str, int] = {}
    at, size = 0, len(page)

    def pop_to(depth: int) -> None:
        for k in stack[depth:]:
            open_tags[nodes[k][0]] -= 1
        del stack[depth:]

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            items[stack[-1]].append(page[at:])
            break
        if m.start() > at:
            items[stack[-1]].append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                items[stack[-1]].append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while nodes[stack[depth]][0] != tag:
                    depth -= 1
                # an inline end tag does not close the block that it stands in
                if tag in BLOCK or not any(nodes[k][0] in BLOCK for k in stack[depth + 1 :]):
                    pop_to(depth)
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            depth = len(stack) - 1
            while nodes[stack[depth]][0] != "p":
                depth -= 1
            pop_to(depth)
        same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
        if tag in LIMITS and any(open_tags.get(t) for t in same):
            for depth in range(len(stack) - 1, 0, -1):
                name = nodes[stack[depth]][0]
                if name in same:
                    pop_to(depth)
                    break
                if name in LIMITS[tag]:
                    break
        k = len(nodes)
        nodes.append((tag, m["attrs"] or m["attrs2"] or "", stack[-1]))
        items.append([])
        items[stack[-1]].append(k)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
            items[k].append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(k)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return nodes, items


def is_mark(name: str) -> bool:
    """Whether a class or an id names something that is not the article: by its words, not by a state or as a part of the article."""
    words = [w.lower() for w in NAMES.findall(name)]
    if not words or words[0] in STATES:
        return False
    if any(w in MARKS or w.startswith(STEMS) for w in words):
        return True
    return words[-1] in LAST and not (len(words) > 1 and words[0] in PARTS and words[-1] == "header")


def is_topic(name: str) -> bool:
    """Whether a name that marks may tell what an article is about: its marks are ``TOPICS``, and it has a word besides."""
    words = [w.lower() for w in NAMES.findall(name)]
    marks = {w for w in words if w in MARKS or w.startswith(STEMS)}
    return bool(marks) and all(w in TOPICS or w.startswith("recommend") for w in marks) and any(w not in marks and w not in BOXES and len(w) > 2 for w in words) and words[-1] not in LAST


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}


def kept(nodes: list[tuple[str, str, int]], items: list[list]) -> list[bool]:
    """Per node whether neither it nor an ancestor is marked as no content.

    Names that may tell what an article is about (``is_topic``) mark no prose of an article or main: an element of many characters, few of them in links.

    A marked element stays if nothing else would be left: if it holds every article and main of the page, or, on a page without these, if
    less than a fifth of the text stands outside marked elements.
    """
    n = len(nodes)
    hard, marked, flow, inside, topic, link = ([False] * n for _ in range(6))
    linked = [0] * n
    holder = [0] * n  # how many unmarked articles and mains below, itself included
    size = [0] * n
    for k in range(1, n):
        tag, attrs, parent = nodes[k]
        inside[k] = inside[parent] or tag in ("article", "main")
        flow[k] = flow[parent] or tag in FLOW
        hard[k] = hard[parent] or tag in HARD
        link[k] = link[parent] or tag == "a"
        mark = tag in DROP and not (tag == "header" and inside[parent])
        if not mark and attrs and tag not in ("html", "body") and not (tag in INLINE and flow[parent]):
            a = _attributes(attrs)
            names = a.get("class", "").split() + [a.get("id", "")]
            by_name = [x for x in names if is_mark(x)]
            mark = a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
            topic[k] = not mark and bool(by_name) and inside[parent] and all(map(is_topic, by_name))
            mark = mark or bool(by_name)
        marked[k] = mark
    for k in range(n - 1, 0, -1):
        if not hard[k]:
            tag, _, parent = nodes[k]
            own = sum(len(x.strip()) for x in items[k] if isinstance(x, str))
            size[k] += own
            linked[k] += own * link[k]
            size[parent] += size[k]
            linked[parent] += linked[k]
            marked[k] = marked[k] and not (topic[k] and size[k] >= PROSE and linked[k] <= LINKED * size[k])
            holder[k] += tag in ("article", "main") and not marked[k]
            holder[parent] += holder[k]
    outside = size[0] + sum(len(x.strip()) for x in items[0] if isinstance(x, str))
    free = outside
    below = [False] * n  # in a marked element
    for k in range(1, n):
        below[k] = below[nodes[k][2]]
        if marked[k] and not below[k]:
            below[k] = True
            free -= size[k]
    ok = [True] * n
    for k in range(1, n):
        if not ok[nodes[k][2]] or hard[k]:
            ok[k] = False
        elif marked[k]:
            ok[k] = holder[k] == holder[0] if holder[0] else 0 < size[k] and free < REST * outside and size[k] > 0.5 * outside
    return ok


def hashes(nodes: list[tuple[str, str, int]], items: list[list], ok: list[bool]) -> list[int]:
    """A signed 64-bit hash of each kept node's tag, text and children; 0 without text."""
    import xxhash

    out = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if ok[k]:
            parts = [str(out[x]) if isinstance(x, int) else " ".join(html.unescape(x).split()) for x in items[k]]
            if any(p and p != "0" for p in parts):
                h = xxhash.xxh64_intdigest("\x00".join([nodes[k][0], *parts]).encode("utf-8", "surrogatepass"))
                out[k] = (h or 1) - (1 << 64 if h >> 63 else 0)
    return out


def roots(nodes: list[tuple[str, str, int]], items: list[list], ok: list[bool]) -> list[int]:
    """The nodes that hold the content, by their amount of text: articles if they make most of the main element, or there is none; else main, else what is named content; else the whole page.

    Of several articles those with a quarter of the largest one's text or more belong to the content: less is a teaser.
    """
    size = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        if ok[k]:
            size[k] += sum(len(x.strip()) for x in items[k] if isinstance(x, str))
            if k:
                size[nodes[k][2]] += size[k]

    def outermost(test) -> list[int]:
        below, out = [False] * len(nodes), []
        for k in range(1, len(nodes)):
            below[k] = below[nodes[k][2]]
            if ok[k] and not below[k] and size[k] and test(*nodes[k][:2]):
                below[k] = True
                out.append(k)
        return out

    role = lambda attrs: _attributes(attrs).get("role", "").lower() if "role" in attrs.lower() else ""
    articles = outermost(lambda tag, attrs: tag == "article" or role(attrs) == "article")
    mains = outermost(lambda tag, attrs: tag == "main" or role(attrs) == "main")
    large = [k for k in articles if size[k] >= LEAST_ARTICLE * max(size[x] for x in articles)]
    if mains and (not large or sum(size[k] for k in large) < MOST_OF_MAIN * sum(size[k] for k in mains)):
        return mains
    if large:
        return large
    named = outermost(lambda _, attrs: bool(attrs) and bool(CONTENT.intersection([*(a := _attributes(attrs)).get("class", "").lower().split(), a.get("id", "").lower()])))
    named = [k for k in named if size[k] > 0.5 * size[0]]
    return named or [0]


def blocks(nodes: list[tuple[str, str, int]], items: list[list], ok: list[bool], root: int) -> list[tuple[str, int]]:
    """(text, innermost block node) of each non-empty block below root, in page order."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    block = root

    def end(then: int) -> None:
        nonlocal block
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, block))
            text.clear()
        block = then

    todo: list[tuple[int, int, int]] = [(root, 0, root)]
    while todo:
        k, i, own = todo.pop()
        while i < len(items[k]):
            x = items[k][i]
            i += 1
            if isinstance(x, str):
                text.append(html.unescape(x))  # each text by itself: markup ends a reference
            elif ok[x]:
                if nodes[x][0] in BLOCK:
                    end(x)
                    todo.append((k, i, own))
                    todo.append((x, 0, x))
                    break
                if nodes[x][0] in VOID:
                    text.append(" ")
                    continue
                todo.append((k, i, own))
                todo.append((x, 0, own))
                break
            else:
                text.append(" ")
        else:
            if k == own and todo:
                end(todo[-1][2])
    end(root)
    return out


def spans(nodes: list[tuple[str, str, int]], items: list[list], ok: list[bool]) -> tuple[list[tuple[str, int]], dict[int, list[int]]]:
    """The content's blocks, and per block element that holds some of them (itself no article, main, body or html) their numbers."""
    tops = roots(nodes, items, ok)
    lines = [x for r in tops for x in blocks(nodes, items, ok, r)]
    inside: dict[int, list[int]] = {}
    top = set(tops)
    for n, (_, k) in enumerate(lines):
        depth = 0
        while k > 0 and k not in top and depth < 200:  # a wrapper further out is no template
            if nodes[k][0] in BLOCK and nodes[k][0] not in WHOLE:
                inside.setdefault(k, []).append(n)
            k, depth = nodes[k][2], depth + 1
    return lines, inside


def contexts(nodes: list[tuple[str, str, int]], items: list[list], ok: list[bool]) -> set[tuple[int, int]]:
    """(hash, context) of each block element in the content, and (0, context) of the page; an element that holds the whole content has none."""
    import xxhash

    lines, inside = spans(nodes, items, ok)
    by_size = sorted(range(len(lines)), key=lambda n: (-len(lines[n][0]), n))

    def context(own: list[int]) -> int:
        gone, longest = set(own), []
        for n in by_size:
            if n not in gone:
                longest.append(lines[n][0])
                if len(longest) == 2:
                    break
        return xxhash.xxh64_intdigest("\x00".join(longest).encode("utf-8", "surrogatepass")) - (1 << 63) if longest else 0

    h = hashes(nodes, items, ok)
    return {(0, context([]))} | {(h[k], x) for k, own in inside.items() if h[k] and (x := context(own))}


def extract(page: str, templates: set[int], most: float = 0.3, most_plain: float = 0.5) -> str:
    """The main text of a page, given the hashes of its host's templates."""
    nodes, items = parse(page)
    ok = kept(nodes, items)
    lines, gone = None, set()
    if templates:
        lines, inside = spans(nodes, items, ok)
        h = hashes(nodes, items, ok)
        total = sum(len(t) for t, _ in lines) * (most_plain if roots(nodes, items, ok) == [0] else most)
        for k, own in inside.items():
            if h[k] in templates and sum(len(lines[n][0]) for n in own) <= total:
                gone.update(own)
        if len(gone) == len(lines):
            gone = set()
    else:
        lines = [x for r in roots(nodes, items, ok) for x in blocks(nodes, items, ok, r)]
    return "\n".join(t for n, (t, _) in enumerate(lines) if n not in gone)


def host_of(url: str | None) -> str:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    if not isinstance(url, str) or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].translate({c: c + 32 for c in range(65, 91)})


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.1) -> DataFrame:
    """(host, templates): hashes of the subtrees in ``share`` of a host's different contents and ``least_pages`` at least.

    A host has at most (blocks of a page) / share of them.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hosts: list[str] = []
            found: list[tuple[int, int]] = []
            for url, page in zip(pdf.url, pdf.html, strict=True):
                host = host_of(url)
                if not host:
                    continue
                nodes, items = parse(page if isinstance(page, str) else "")
                own = contexts(nodes, items, kept(nodes, items))
                hosts += [host] * len(own)
                found += own  # hash 0 counts the different contents
            yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "hash": pd.Series([x for x, _ in found], dtype="int64"), "context": pd.Series([x for _, x in found], dtype="int64")})

    each = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(emit, "host string, hash long, context long").distinct()
    counts = materialize(each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages))
    totals = counts.filter("hash = 0").select("host", F.col("n").alias("total"))
    often = counts.filter("hash <> 0").join(small(totals, 100_000), "host").filter(F.col("n") >= share * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("templates"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    small_batches(pages.sparkSession)
    templates = materialize(site_templates(pages, url_col, html_col))
    host = F.translate(F.regexp_extract(F.col("url"), r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    known = small(templates, 50_000)
    if known is templates:
        # too many to send to all: hosts are dealt in parts, as one may hold a third of the pages
        base = base.withColumn("part", F.pmod(F.xxhash64("id", "url"), F.lit(HOST_PARTS)))
        known = templates.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOST_PARTS - 1).cast("long"))))
    joined = base.join(known, ["host", "part"] if "part" in base.columns else "host", "left").select("id", "url", "html", "templates")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, known in batches:
            yield pd.Series([extract(p, set() if t is None else set(t)) if isinstance(p, str) else "" for p, t in zip(page, known, strict=True)], dtype=object)

    return joined.select("id", "url", text("html", "templates").alias("text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    got = main_text(table(spark, sf_dir, "pages"))
    return got.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
