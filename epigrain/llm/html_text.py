"""Main text of web pages by site template removal.

A page is parsed once into text blocks, each with the hashes of the block-level subtrees around it. Spark counts, per host, on how
many different pages each subtree occurs, side matter included. Of those that recur, a subtree is template if it is on a share of
the host's pages, or of the pages that have an element at its place (tags, classes and ids down to it: a layout), or if it is
mostly links or side matter by structure on most of its pages. Blocks under template subtrees go.
Structure decides first where it can: parts that are never article text (menus, forms, scripts, notices, reader comments, ...)
are skipped, and if a page marks its article or main part, and most of its text is there, only that part is read. Names and forms
are judged once the page is parsed: an element around the main part is never skipped, and one that holds more than a small share
of the page's text is a wrapper, unless it is mostly links or its very name says so beside a marked article.

Null html is an empty page, null url an empty host; empty pages give an empty text. Pages whose longest blocks, of ``SAME_SHARE`` of
their text, are the same count once per host, so copies of an article that differ in a date do not make it a template. Rows that repeat a page_id stay separate rows. Other columns are
ignored. Nothing is cut, whatever the length of a page.
"""

from __future__ import annotations

import html
import re
from itertools import count

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, written

#: A subtree is template when it occurs on so many different pages of its host, and on this share of them or of those with its place.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.3
#: Without a marked article, a block with more of its characters in links than this is a menu.
LINK_SHARE = 0.6
#: Elements that one name or tag marks as side matter hold no more than this share of a page's text together.
SIDE_SHARE = 0.3
#: Pages are copies when their longest blocks, up to this share of the text to read, agree.
SAME_SHARE = 0.9
#: Templates (16 bytes each and their host's name) that may be broadcast.
BROADCAST_TEMPLATES = 500_000

PARSED = (
    "key long, page_id long, url string, host string, page_hash long, blocks array<string>, "
    "marks array<struct<subtree: long, place: long, side: boolean, read: boolean, first: int, past: int>>"
)

RAW = ("script", "style", "noscript", "iframe", "textarea", "title")
#: What is in these is no text of the page either, but one that is never closed is an empty element.
FILLED = ("template", "svg", "math", "select", "object", "canvas", "audio", "video")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("nav footer aside form menu dialog button fieldset datalist label".split())
#: Of these and of headers outside an article, no share of the text makes a wrapper.
SURE = set("nav footer menu dialog button datalist header".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption "
    "option".split()
)
CLOSES_P = BLOCK - {"body", "html", "head"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
SKIP_ROLES = set("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar tablist".split())
SKIP_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot sponsor sponsored promo promotion banner "
    "sidebar sidebars nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead topbar toolbar footer foot cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin "
    "login share sharing sharebar social related recommended recommendations comment comments commentlist disqus reply replies "
    "respond responses widget widgets pagination pager search searchform copyright skiplink form".split()
)
HEAD_NAMES = set("header site-header page-header topnav".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_FILLED_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in FILLED}
_HOST = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().removeprefix("www.") if found else ""


def _reasons(tag: str, attrs: str, in_article: bool) -> set[str]:
    """Why an element and all in it may be side matter: ``hidden``, ``sure``, or names; ``=`` stands before a name that is a whole
    class or id."""
    if tag in ("html", "body", "main"):
        return set()
    out = set()
    if tag in SKIP or (tag == "header" and not in_article):
        out.add("sure" if tag in SURE else tag)
    if not attrs or tag == "article" and "comment" not in attrs.lower():
        return out
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            out.add("hidden")
        if name == "role" and value in SKIP_ROLES:
            out.add(value)
        if name in ("class", "id"):
            out |= SKIP_NAMES.intersection(re.split(r"[^a-z0-9]+", value))
            whole = value.split()
            out.update("=" + w for w in SKIP_NAMES.intersection(whole))
            if not in_article:
                out |= HEAD_NAMES.intersection(whole)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _names(attrs: str) -> str:
    """Classes and ids, as far as they do not number the element."""
    found = [m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id")] if attrs else []
    return " ".join(w for v in found for w in v.split() if not any(c.isdigit() for c in w))


class _Node:
    __slots__ = ("tag", "parent", "place", "begin", "end", "reasons", "main", "chars", "linked", "skipped", "above", "under")

    def __init__(self, tag, parent, begin, reasons, main, names=""):
        self.tag, self.parent, self.begin, self.reasons, self.main = tag, parent, begin, reasons, main
        self.place = _hash(f"{parent.place if parent else ''} {tag} {names}")
        self.end, self.chars, self.linked, self.skipped = begin, 0, 0, False
        self.above: frozenset[str] = frozenset()  # reasons of small elements around
        self.under = False  # whether the part to read lies around

    def around(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Page:
    """One pass over a page: blocks of text with the block-level elements around them; then over its elements, to tell side matter."""

    def __init__(self):
        root = _Node("html", None, 0, set(), 0)
        self.stack = [root]
        self.open: dict[str, int] = {}
        self.nodes = [root]  # parents come first
        self.parts: list[tuple[str, _Node, bool]] = []  # text, innermost element, whether in a link
        self.links = 0
        self.blocks: list[tuple[list[tuple[str, _Node, bool]], _Node]] = []  # parts, innermost block-level element

    def flush(self) -> None:
        if self.parts:
            self.blocks.append((self.parts, self.holder()))
            self.parts = []

    def holder(self) -> _Node:
        return next(n for n in reversed(self.stack) if n.tag in BLOCK)

    def close(self, depth: int) -> None:
        """Close elements until ``depth`` are left open."""
        if any(n.tag in BLOCK for n in self.stack[depth:]):
            self.flush()
        while len(self.stack) > depth:
            node = self.stack.pop()
            if node is not self.nodes[0]:
                self.open[node.tag] -= 1
            if node.tag == "a":
                self.links -= 1
            node.end = len(self.blocks)

    def find(self, tags: set[str], stops: set[str]) -> int | None:
        if not any(self.open.get(t) for t in tags):
            return None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in stops:
                return None
        return None

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag == "hr":
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P and (i := self.find({"p"}, {"table", "td", "th", "button", "object"})) is not None:
            self.close(i)
        if tag in CLOSED_BY and (i := self.find(CLOSED_BY[tag], CLOSE_STOPS[tag])) is not None:
            self.close(i)
        if tag in BLOCK:
            self.flush()
        above = self.stack[-1]
        reasons = _reasons(tag, attrs, above.main > 0)
        marks = 2 if tag == "article" and not reasons else 1 if tag == "main" or 'role="main"' in attrs else 0
        if tag == "a":
            self.links += 1
        node = _Node(tag, above, len(self.blocks), reasons, max(above.main, marks), _names(attrs))
        self.stack.append(node)
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if (i := self.find({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div") else set())) is not None:
            self.close(i)

    def text(self, raw: str) -> None:
        if not raw:
            return
        node = self.stack[-1]
        self.parts.append((raw, node, self.links > 0))
        n = len(raw.strip())
        node.chars += n
        if self.links:
            node.linked += n

    def judge(self) -> int:
        """Mark the elements that are side matter; the result is the rank of the blocks to read."""
        for node in reversed(self.nodes[1:]):
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        total = self.nodes[0].chars
        marked = [n for n in self.nodes[1:] if n.main > n.parent.main]
        hidden = {id(self.nodes[0]): False}
        for n in self.nodes[1:]:
            hidden[id(n)] = hidden[id(n.parent)] or "hidden" in n.parent.reasons
        shown = [n for n in marked if not hidden[id(n)]]
        biggest = max(shown or marked, key=lambda n: n.chars, default=None)
        spared = {id(n) for n in (biggest, *biggest.around())} if biggest else set()
        named = [n for n in self.nodes if n.reasons and id(n) not in spared]
        held: dict[str, int] = {}
        for n in self.nodes[1:]:
            a = n.parent
            adds = bool(a.reasons) and id(a) not in spared and a.chars <= SIDE_SHARE * total and not a.reasons <= a.above
            n.above = a.above | a.reasons if adds else a.above
            n.under = a.under or a is biggest
        for n in named:
            if n.chars <= SIDE_SHARE * total:
                for r in n.reasons - n.above:
                    held[r] = held.get(r, 0) + n.chars
        for n in named:
            n.skipped = (
                "sure" in n.reasons
                or "hidden" in n.reasons
                or n.linked > LINK_SHARE * n.chars
                or n.chars <= SIDE_SHARE * total and any(held[r] <= SIDE_SHARE * total for r in n.reasons)
                or bool(biggest) and not n.under and any(r[0] == "=" for r in n.reasons)
            )
        for n in self.nodes[1:]:
            n.skipped = n.skipped or n.parent.skipped
        # what is side matter within a marked part still speaks for that part
        weight = [0, 0, 0]
        tops: dict[int, _Node] = {}  # the outermost marked element around each node, or the node
        for n in self.nodes:
            tops[id(n)] = tops[id(n.parent)] if n.parent is not None and n.parent.main else n
        for parts, _ in self.blocks:
            for raw, node, _ in parts:
                if not node.skipped or node.main and not tops[id(node)].skipped:
                    weight[node.main] += len(raw.strip())
        if not biggest or weight[1] + weight[2] < weight[0]:
            return 0
        return 2 if weight[2] >= weight[1] else 1


def parse(source: str | None) -> list[str]:
    """Blocks that may be article text, in page order."""
    return marked(source)[0]


def _closed(source: str) -> dict[int, int]:
    """Where the elements of FILLED end, by where their start tags do; only those that are closed before another of their kind begins."""
    out = {}
    for tag, pattern in _FILLED_TAG.items():
        begun = None
        for m in pattern.finditer(source) if f"<{tag}" in source or re.search(f"<{tag}", source, re.I) else ():
            if not m[1]:
                begun = m.end()
            elif begun is not None:
                out[begun], begun = m.end(), None
    return out


#: Multiplier of the hash of a run of blocks.
_RUN = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def marked(source: str | None) -> tuple[list[str], list[tuple[int, int, bool, int, int]]]:
    """The blocks of ``parse``, and (hash, place, whether side matter or mostly links, first block, block past the last) of all
    subtrees with text, side matter too.

    Each block of text is a subtree of its own, for it may stand beside text that changes. A subtree's hash is made of those of its
    blocks and its tag, and subtrees are told by the blocks they span, so the work grows with the page and not with its depth.
    """
    page, at = _Page(), 0
    source = source or ""
    last, filled = source.rfind(">"), _closed(source)
    while at <= last and (m := _TOKEN.search(source, at)) is not None:
        page.text(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            page.end(tag)
        elif tag in _RAW_END:
            if not attrs.endswith("/") or tag in ("script", "style"):
                close = _RAW_END[tag].search(source, at)
                at = close.end() if close else len(source)
        elif tag in _FILLED_TAG:
            at = filled.get(at, at)
        else:
            page.start(tag, attrs)
            if attrs.endswith("/") and tag not in VOID and tag not in BLOCK:
                page.end(tag)
    rest = source[at:]
    page.text(rest[: min(i for i in (rest.find("<!--"), rest.find("<![CDATA["), len(rest)) if i >= 0)])
    page.flush()
    page.close(0)
    rank = page.judge()
    texts = [" ".join(html.unescape("".join(raw for raw, n, _ in parts if not n.skipped)).split()) for parts, _ in page.blocks]
    whole = [
        text if not any(n.skipped for _, n, _ in parts) else " ".join(html.unescape("".join(raw for raw, _, _ in parts)).split())
        for text, (parts, _) in zip(texts, page.blocks, strict=True)
    ]
    # the hash of a run of blocks is a polynomial in those of its blocks; before[i] and full[i] are of the first i
    before, full, powers = [0], [0], [1]
    for text in whole:
        before.append((before[-1] * _RUN + _hash(text)) & _MASK if text else before[-1])
        full.append(full[-1] + bool(text))
        powers.append(powers[-1] * _RUN & _MASK)

    def run_hash(tag: str, a: int, b: int) -> int:
        inside = (before[b] - before[a] * powers[full[b] - full[a]]) & _MASK
        return _hash(f"{tag}\n{full[b] - full[a]}\n{inside}")

    out, places = [], [0]
    alone = []
    for k, (text, all_text, (parts, node)) in enumerate(zip(texts, whole, page.blocks, strict=True)):
        read = False
        if all_text:
            linked = sum(len(raw) for raw, n, in_link in parts if in_link and not n.skipped)
            if node.end - node.begin > 1:
                alone.append((run_hash(node.tag, k, k + 1), node.place, not text or linked > LINK_SHARE * len(text), k))
            read = bool(text) and not (max(n.main for _, n, _ in parts) < rank or rank == 0 and linked > LINK_SHARE * len(text))
        if read:
            out.append(text)
        places.append(len(out))
    marks = [
        (run_hash(n.tag, n.begin, n.end), n.place, n.skipped or n.linked > LINK_SHARE * n.chars, places[n.begin], places[n.end])
        for n in page.nodes
        if n.tag in BLOCK and n.chars
    ]
    return out, marks + [(h, place, side, places[k], places[k + 1]) for h, place, side, k in alone]


def same_page(texts: list[str]) -> int:
    """A hash of the longest texts that hold ``SAME_SHARE`` of all."""
    left, some = SAME_SHARE * sum(map(len, texts)), []
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if left <= 0:
            break
        some.append(i)
        left -= len(texts[i])
    return _hash("\n".join(texts[i] for i in sorted(some)))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """A row per page with its blocks, written once; ``key`` tells rows apart."""

    def run(batches):
        keys = count(TaskContext.get().partitionId() << 33)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            rows, held = [], 0
            for page_id, url, source in zip(*columns, strict=True):
                blocks, marks = marked(source)
                whole = same_page(blocks)
                marks = [{"subtree": d, "place": at, "side": side, "read": a < b, "first": a, "past": b} for d, at, side, a, b in marks]
                rows.append((next(keys), page_id, url, host_of(url), whole, blocks, marks))
                held += len(source or "")
                if held > 2_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return written(rows.mapInArrow(tidy(run), PARSED), "parsed-pages", "zstd")


_BLOCKS = pa.list_(pa.string())
_MARKS = pa.list_(
    pa.struct([("subtree", pa.int64()), ("place", pa.int64()), ("side", pa.bool_()), ("read", pa.bool_()), ("first", pa.int32()), ("past", pa.int32())])
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), _BLOCKS, _MARKS]
    names = ["key", "page_id", "url", "host", "page_hash", "blocks", "marks"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def with_cuts(parsed: DataFrame, subtrees: DataFrame, templates: DataFrame, most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """Adds the hashes that are template on a page's host as ``cut``. Up to ``most`` templates are sent to every executor, grouped by
    host; more are joined to the pages' subtrees. Both give a page the same blocks."""
    if templates.count() <= most:
        hosts = templates.groupBy("host").agg(F.collect_list("subtree").alias("cut"))
        return parsed.join(F.broadcast(hosts), "host", "left")
    cut = subtrees.join(templates, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("cut"))
    return parsed.join(cut, "key", "left")


def site_templates(parsed: DataFrame, least: int, share: float) -> DataFrame:
    """(host, subtree) of the subtrees that are template. Only those on ``least`` page rows, and on any around a block that structure
    leaves, are counted by different pages."""
    marks = parsed.select("host", "page_hash", F.explode("marks").alias("m")).select("host", "page_hash", "m.*")
    often = marks.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("rows"), F.max("read").alias("read"))
    often = often.where("read").where(F.col("rows") >= least)
    often = written(often.select("host", "subtree"), "often")
    few = F.broadcast if often.count() <= BROADCAST_TEMPLATES else lambda df: df
    seen = marks.join(few(often), ["host", "subtree"]).groupBy("host", "subtree", "place", "page_hash").agg(F.max("side").alias("side"))
    seen = written(seen, "recurring")
    on = seen.groupBy("host", "subtree", "page_hash").agg(F.max("side").alias("side"))
    on = on.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"), F.count_if("side").alias("sides"))
    hosts = parsed.select("host", "page_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    by_host = on.where(F.col("pages") >= least).join(hosts, "host")
    by_host = by_host.where((F.col("pages") >= share * F.col("of")) | (2 * F.col("sides") > F.col("pages")))
    at = seen.groupBy("host", "subtree", "place").agg(F.count(F.lit(1)).alias("pages"))
    at = written(at.where(F.col("pages") >= least), "recurring-places")
    places = at.select("host", "place").distinct()
    few = F.broadcast if places.count() <= BROADCAST_TEMPLATES else lambda df: df
    having = marks.select("host", "place", "page_hash").join(few(places), ["host", "place"]).distinct()
    having = having.groupBy("host", "place").agg(F.count(F.lit(1)).alias("of"))
    by_place = at.join(having, ["host", "place"]).where(F.col("pages") >= share * F.col("of"))
    return by_host.select("host", "subtree").unionByName(by_place.select("host", "subtree")).distinct()


def judged_blocks(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(page_id, url, blocks, kept) of every page row: the blocks that structure leaves, and those of them under no template."""
    parsed = parsed_pages(pages)
    templates = written(site_templates(parsed, least, share), "site-templates")
    subtrees = parsed.select("key", "host", F.explode(F.array_distinct("marks.subtree")).alias("subtree"))
    judged = with_cuts(parsed, subtrees, templates).withColumn("cut", F.array_intersect("marks.subtree", "cut"))
    gone = F.filter("marks", lambda m: m["read"] & F.array_contains("cut", m["subtree"]))
    gone = F.array_sort(F.transform(gone, lambda m: F.struct(m["first"].alias("first"), (-m["past"]).alias("past"))))
    # of runs in order, those within an earlier one say nothing new
    outer = F.expr("""aggregate(gone, struct(array(struct(0 AS first, 0 AS past)) AS runs, 0 AS reach), (a, g) -> if(-g.past <= a.reach, a,
        struct(concat(a.runs, array(struct(g.first AS first, -g.past AS past))) AS runs, -g.past AS reach))).runs""")
    judged = judged.withColumn("gone", gone).withColumn("gone", F.when(F.size("gone") > 0, outer))
    kept = F.filter("blocks", lambda b, i: F.col("gone").isNull() | ~F.exists("gone", lambda g: (g["first"] <= i) & (i < g["past"])))
    return judged.select("page_id", "url", "blocks", kept.alias("kept"))


def extract(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row."""
    text = F.array_join("kept", " ")
    text = judged_blocks(pages, least, share).select("page_id", "url", text.alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
