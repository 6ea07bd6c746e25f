"""Main text of web pages by removal of each site's own template.

A tolerant reader splits a page into text blocks and hashes every element subtree that
covers blocks: once with its words, and once blind to them (tags, labels, repeats folded),
so that a menu or box whose words change still recurs.  Spark counts each hash over the
pages of its host, one count for each distinct content, and the blocks of subtrees that
recur on many pages of the host go.  Blind hashes count only outside the marked article,
on pages without one only for lists of links, so they never touch running text.  Of what
is left, blocks go that the page itself declares to be something else (``nav``, ``footer``,
``class=ad``): all there is to go by where a host has a single page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.staging import stage
from .batches import append_columns, names_apart

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*>?", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # quotes that do not pair up
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Element names of the HTML standard and the words sites use for page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset(
    "audio button canvas datalist head iframe map noscript object script select style svg template textarea title video".split()
)
OTHER_PARTS = frozenset("aside dialog footer form menu nav".split())
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# An article inside one of these is still an article ...
LAYOUT_WORDS = frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notification overlay pager pagination popup search sidebar signup skip "
    "subscribe toolbar topbar widget".split()
)
# ... but not inside one of these.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts comment comments disqus promo promoted promotion recommended related "
    "respond share sharing social sponsor sponsored".split()
)
# A name counts by its last word, or by any word if it ends in one of these: "share-bar", not "search-result".
HOLDER_WORDS = frozenset("area bar block box buttons container holder item items links list panel section slot unit wrap wrapper".split())
NOT_A_PART = re.compile(r"^(?:has|with|no|without|is|not)[-_]", re.I)
SCOPE = frozenset("table td th caption button object".split())
REPLACES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
FRAMES = frozenset("html body article main".split())
RUNNING = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
# kinds of subtree hashes
EXACT, EXACT_IN_ARTICLE, BLIND, BLIND_LINKS = range(4)
SALTS = (0, 0x5BD1E995, 0x9E3779B9, 0xC2B2AE35)


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    label: str
    drop: str  # "" (kept), "layout", "header" or "other"
    article: bool
    main: bool
    silent: bool
    path: int
    first: int  # blocks and links of the page before it
    links: int
    parts: list = field(default_factory=list)
    shape: list = field(default_factory=list)
    digest: int = 0
    blind: int = 0


@dataclass(slots=True)
class Page:
    """Blocks in page order and the hashed subtrees over them; block ``i`` lies in a node if
    ``start <= i < stop``."""

    texts: list[str]
    taken: list[bool]  # in the marked article (if one holds most of the text) and not declared to be another part
    nodes: list[tuple[int, int, int, int]]  # hash, kind, start, stop
    content: int  # hash of most of the blocks taken (the longer ones; of two the longer one), links left out

    def without(self, gone) -> tuple[str, int]:
        return left_of(self.texts, self.taken, [(a, b) for key, _, a, b in self.nodes if key in gone])


def left_of(texts: list[str], taken: list[bool], gone: list[tuple[int, int]]) -> tuple[str, int]:
    """The text outside the ranges gone, and the number of blocks inside them."""
    change = [0] * (len(texts) + 1)
    for a, b in gone:
        change[a] += 1
        change[b] -= 1
    inside, out, removed = 0, [], 0
    for text, take, step in zip(texts, taken, change, strict=False):
        inside += step
        removed += inside > 0
        if take and not inside:
            out.append(text)
    return " ".join(out), removed


def _part(tag: str, attributes: dict[str, str], article: bool) -> str:
    """Why an element is no part of the article, if it is none."""
    if tag in OTHER_PARTS or attributes.get("role", "").lower() in OTHER_ROLES:
        return "other"
    if tag == "header":
        return "header" if article else "layout"
    if tag in ("html", "body", "main"):
        return ""
    names = [n for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split() if not NOT_A_PART.match(n)]
    words = set()
    for name in names:
        *first, last = re.split(r"[-_]+", name)
        words |= {*first, last} if last in HOLDER_WORDS else {last}
    if words & ASIDE_WORDS:
        return "other"
    return "layout" if tag != "article" and words & LAYOUT_WORDS else ""


def read_page(page: str) -> Page:
    root = Element("#root", None, "", "", False, False, False, 0, 0, 0)
    top, text, open_, tag_at = root, [], Counter(), TAG
    blocks: list[tuple[str, Element, int]] = []  # words, innermost element, characters in links
    closed: list[tuple[Element, int, int]] = []  # element, end of its blocks, its links
    links = linked = 0

    def flush():
        nonlocal linked
        if text:
            if joined := " ".join("".join(text).split()):
                blocks.append((joined, top, linked))
            text.clear()
        linked = 0

    def close(until: Element):
        """Close all elements above ``until`` and itself."""
        nonlocal top
        while True:
            e = top
            e.digest = xxhash.xxh64_intdigest("\0".join([e.tag, e.label, *map(str, e.parts)]))
            top = e.parent
            open_[e.tag] -= 1
            e.blind = xxhash.xxh64_intdigest("\0".join([e.tag, e.label, *map(str, e.shape)]))
            if e.parts or e.tag not in INLINE:
                top.parts.append(e.digest)
                if top.shape[-1:] != [e.blind]:
                    top.shape.append(e.blind)
            if e.tag not in INLINE and e.tag not in FRAMES and e.first < len(blocks):
                closed.append((e, len(blocks), links - e.links))
            if e is until:
                return

    def nearest(tags: frozenset, stop: frozenset) -> Element | None:
        if not any(map(open_.get, tags)):
            return None
        e = top
        while e is not root and e.tag not in stop:
            if e.tag in tags:
                return e
            e = e.parent
        return None

    def nearest_inline(tag: str) -> Element | None:
        e = top
        while e.tag in INLINE and e.tag != tag:
            e = e.parent
        return e if e.tag == tag else None

    def add(raw: str):
        nonlocal linked
        raw = html.unescape(raw) if "&" in raw else raw
        if not top.silent:
            text.append(raw)
            if words := " ".join(raw.split()):
                top.parts.append(words)
                if top.shape[-1:] != [0]:
                    top.shape.append(0)
                if open_["a"]:
                    linked += len(words)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        at = lt + 1
        if not (ahead := page[at : at + 2]).strip("<"):
            add("<")
            continue
        m = tag_at.match(page, lt) if ahead[0].isalpha() or ahead[0] == "/" else None
        if m is None and (ahead[0].isascii() and ahead[0].isalpha() or ahead[0] == "/" and ahead[1:].isalpha()):
            tag_at = LOOSE_TAG
            m = tag_at.match(page, lt)
            if m is None:  # a tag that the end of the page cuts off
                break
        if m is None:
            if ahead[0] in "!?/":
                at = COMMENT.match(page, lt).end()
            else:
                add("<")
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            e = nearest_inline(tag) if tag in INLINE else nearest(frozenset([tag]), frozenset())
            if e is not None:
                close(e)
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and (e := nearest(frozenset(["p"]), SCOPE)):
                close(e)
            if tag in REPLACES and (e := nearest(*REPLACES[tag])):
                close(e)
        if tag in VOID:
            continue
        if tag in RAW:  # its content is no markup
            found = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = end if found is None else found.start()
            if found is not None:
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(m[3])} if m[3] else {}
        drop = top.drop
        is_main = tag == "main" or attributes.get("role", "").lower() == "main"
        if drop == "layout" and (tag == "article" or is_main) or drop == "header" and tag in HEADINGS:
            drop = ""
        article = top.article or tag == "article"
        drop = drop or _part(tag, attributes, article)
        label = re.sub(r"\d+", "0", f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else ""
        silent = top.silent or tag in SILENT or tag in INLINE and bool(drop) and not top.drop
        path = xxhash.xxh64_intdigest(f"{top.path}\0{tag}\0{label}")
        links += tag == "a"
        top = Element(
            tag, top, label, drop, article and not drop or top.article, top.main or is_main, silent, path, len(blocks), links - (tag == "a")
        )
        open_[tag] += 1
        if m[3].endswith("/") and tag in ("svg", "path"):
            close(top)
    flush()
    while top is not root:
        close(top)
    return _measured(blocks, closed)


def _measured(blocks: list[tuple[str, Element, int]], closed: list[tuple[Element, int, int]]) -> Page:
    """Choose the blocks to take and the subtree hashes to count."""
    sizes = [len(t) for t, *_ in blocks]
    chars = list(accumulate(sizes, initial=0))
    in_links = list(accumulate((n for *_, n in blocks), initial=0))
    undeclared = [not e.drop for _, e, _ in blocks]
    free = sum(n for n, u in zip(sizes, undeclared, strict=True) if u)
    for e, stop, _ in closed:
        # a part named like page furniture that holds most of the page's running text is none
        size = chars[stop] - chars[e.first]
        if e.drop == "layout" and not e.parent.drop and e.tag != "header" and size > free and 2 * (in_links[stop] - in_links[e.first]) < size:
            for i in range(e.first, stop):
                undeclared[i] = undeclared[i] or blocks[i][1].drop == "layout"
    free = sum(n for n, u in zip(sizes, undeclared, strict=True) if u)
    taken, marked = undeclared, False
    for wanted in ("article", "main"):
        inside = [u and getattr(e, wanted) for (_, e, _), u in zip(blocks, undeclared, strict=True)]
        if any(inside) and 2 * sum(n for n, x in zip(sizes, inside, strict=True) if x) >= free:
            taken, marked = inside, True
            break
    held = list(accumulate(taken, initial=0))
    nodes, last = [], {}
    for e, stop, links in closed:
        start, size = e.first, chars[stop] - chars[e.first]
        # of subtrees over the same blocks the innermost recurs whenever an outer one does
        if start < stop and last.get(stop, stop) > start:
            kind = EXACT_IN_ARTICLE if e.article else EXACT
            nodes.append((_signed(e.digest ^ SALTS[kind]), kind, start, stop))
            last[stop] = start
        if start < stop and e.tag not in RUNNING:
            if marked and held[start] == held[stop] and not e.article:
                nodes.append((_signed(e.blind ^ SALTS[BLIND]), BLIND, start, stop))
            elif not marked and links >= 3 and 2 * (in_links[stop] - in_links[start]) > size:
                nodes.append((_signed(e.blind ^ e.path ^ SALTS[BLIND_LINKS]), BLIND_LINKS, start, stop))
    own = [t for (t, _, n), x in zip(blocks, taken, strict=True) if x and 2 * n <= len(t)]
    key = sorted(own, key=lambda t: (-len(t), t))[: len(own) // 2 + (len(own) != 2)]
    return Page([t for t, *_ in blocks], taken, nodes, _signed(xxhash.xxh64_intdigest("\0".join(key))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


NODES = T.ArrayType(
    T.StructType([T.StructField("key", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
)
BROADCAST_TEMPLATES = 200_000


def host_of(url: str = "url") -> Column:
    """Lower-case host without user and port; null if the address has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


def templates(parsed: DataFrame, min_contents: int, min_share: float, min_share_article: float, many: int) -> DataFrame:
    """``(host, key)`` of the subtrees that recur: on at least ``min_contents`` distinct
    contents of the host and a share of them, or outside articles on ``many``.  Pages with the
    same blocks but for some short ones count once, so near copies of an article do not make it a
    template, while a long notice on every page does not make their contents one."""
    seen = parsed.filter("host IS NOT NULL").select("host", "content", F.explode("nodes").alias("n"))
    pages = seen.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    found = (
        seen.select("host", "content", F.col("n.kind").alias("kind"), F.col("n.key").alias("key")).distinct()
        .groupBy("host", "key", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_contents)
    )
    strict = F.col("kind").isin(EXACT_IN_ARTICLE, BLIND_LINKS)
    enough = (F.col("n") >= F.when(strict, min_share_article).otherwise(min_share) * F.col("of")) | (~strict & (F.col("n") >= many))
    return found.join(pages, "host").filter(enough).select("host", "key").distinct()


def main_text(
    pages: DataFrame, min_contents: int = 4, min_share: float = 0.3, min_share_article: float = 0.6, many: int = 1000,
    keep: list[str] | None = None, broadcast_templates: int = BROADCAST_TEMPLATES,
) -> DataFrame:
    """Adds ``host``, ``text`` (the blocks joined by one space, empty if none) and ``n_removed``
    (blocks removed as site template).

    A null or empty page has an empty text.  Pages without a host are not compared with any
    other.  If marked articles (else a main part) hold at least half of the text, only their
    blocks are taken.  Pages of any length and depth are read whole.  Repeated rows repeat; an
    empty table gives an empty result; columns named like the new ones are replaced.
    Up to ``broadcast_templates`` templates are sent to the tasks; more are joined to the
    pages, with the same result.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "text", "n_removed")]

    def make():
        def run(sources):
            read = [read_page(s or "") for s in sources]
            return {
                "_texts": [p.texts for p in read], "_taken": [p.taken for p in read], "_content": [p.content for p in read],
                "_nodes": [[dict(zip(("key", "kind", "start", "stop"), n, strict=True)) for n in p.nodes] for p in read],
                "_page": [_signed(xxhash.xxh64_intdigest(s or "")) for s in sources],
            }

        return run

    apart = names_apart(kept)
    keyed = pages.select(*[pages[f"`{c}`"].alias(a) for c, a in apart.items()], host_of().alias("_host"), F.col("html").alias("_html"))
    fields = [
        ("_texts", T.ArrayType(T.StringType())), ("_taken", T.ArrayType(T.BooleanType())), ("_content", T.LongType()), ("_nodes", NODES),
        ("_page", T.LongType()),
    ]
    parsed = stage(append_columns(keyed, ["_html"], fields, make, [*apart.values(), "_host"]), "pages-blocks")
    light = parsed.select(F.col("_host").alias("host"), F.col("_content").alias("content"), F.col("_nodes").alias("nodes"), "_page")
    found = stage(templates(light, min_contents, min_share, min_share_article, many), "pages-templates")
    known = None
    if found.limit(broadcast_templates + 1).count() <= broadcast_templates:
        sets: dict[str, set[int]] = {}
        for host, key in found.collect():
            sets.setdefault(host, set()).add(key)
        known = pages.sparkSession.sparkContext.broadcast(sets)
        rows = parsed.withColumn("_gone", F.lit(None).cast("array<bigint>"))
    else:
        # the templates on each distinct page, found by (host, key) and never by host alone
        on_page = (
            light.filter("host IS NOT NULL").select("host", "_page", F.explode("nodes.key").alias("key")).distinct()
            .join(found, ["host", "key"]).groupBy("host", "_page").agg(F.collect_set("key").alias("_gone"))
            .withColumnRenamed("host", "_on").withColumnRenamed("_page", "_of")
        )
        rows = parsed.join(on_page, (parsed["_host"] == on_page["_on"]) & (parsed["_page"] == on_page["_of"]), "left")

    def remove():
        table = known.value if known else {}

        def run(texts, taken, nodes, hosts, gone):
            out = {"_text": [], "_removed": []}
            for t, x, n, h, g in zip(texts, taken, nodes, hosts, gone, strict=True):
                keys = table.get(h, ()) if known else frozenset(g or ())
                text, removed = left_of(t, x, [(i["start"], i["stop"]) for i in n if i["key"] in keys])
                out["_text"].append(text)
                out["_removed"].append(removed)
            return out

        return run

    done = append_columns(
        rows, ["_texts", "_taken", "_nodes", "_host", "_gone"], [("_text", T.StringType()), ("_removed", T.IntegerType())], remove,
        [*apart.values(), "_host"],
    )
    return done.select(
        *[done[f"`{a}`"].alias(c) for c, a in apart.items()], F.col("_host").alias("host"), F.col("_text").alias("text"),
        F.col("_removed").alias("n_removed"),
    )
