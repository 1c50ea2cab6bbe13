"""Main text of web pages, by site style trees.

The element trees of a site's pages are merged: nodes are paths of tags and classes.
A content node's importance falls with the entropy of its texts over the pages that
have it (the same text on every page: 0, another on each: 1); a presentation
node's rises with the entropy of its children's arrangements.  Composite importance
goes from the leaves up, and branches of low importance are removed from each page,
as are elements that say themselves what they are (menus, forms, comments).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from .tables import small_batches, table

#: Branches below this importance go; inside an article only those below INSIDE, seen on PAGES pages or more.
LOW, INSIDE, PAGES = 0.5, 0.2, 8
#: What is left of the content's share with each further arrangement of a node's children.
DAMP = 0.9
#: A branch is judged by those parts that at least this share of its pages have.
SHARE = 0.25
#: Elements nested deeper belong to the last level.
DEPTH = 48
#: Nodes of low importance that are sent to every task; more are joined by site.
SENT = 500_000

# fixed values: HTML elements without an end, with raw content, and that begin a block
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
HEAD = set("base link meta noscript script style template title".split())
# fixed values: what an open element is closed by, and where the search for it ends
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title", "frameset"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
TABLE = {"table"}
# fixed values: elements, roles and words of class and id names that aren't an article's text
NOISE = set("aside button canvas datalist dialog footer form head iframe input menu meter nav noembed noframes noscript object progress script select style svg template textarea title search".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
NAMES = set(
    "ad ads adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related recommended replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
# fixed values: words of class names that turn the next one around
TURNS = {"has", "no", "not", "with", "without"}
FREE = {"html", "body", "main", "article"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An open element: its node in the site's tree, and what its place means."""

    __slots__ = ("children", "depth", "inside", "noise", "node", "tag")

    def __init__(self, tag: str, node: int, depth: int, noise: bool, inside: bool) -> None:
        self.tag, self.node, self.depth, self.noise, self.inside = tag, node, depth, noise, inside
        self.children: list[int] = []


def attributes(source: str) -> dict[str, str]:
    """An element's attributes, the first of a name; names in lower case."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return found


def says_noise(tag: str, given: dict[str, str], inside: bool) -> bool:
    """Whether an element is by its own words no article text; a header is none outside an article only."""
    if tag in NOISE:
        return True
    if tag in FREE:
        return False
    if not inside and tag == "header":
        return True
    if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or HIDDEN.search(given.get("style", "")):
        return True
    for name in ("class", "id"):
        words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", given.get(name, "")).lower())
        if any(w in NAMES and (k == 0 or words[k - 1] not in TURNS) for k, w in enumerate(words)):
            return True
    return False


class Page:
    """A page's elements and blocks of text, in order; markup that is wrong or cut off is taken as browsers take it.

    ``blocks`` holds (node and those above it, outermost first, in an article from that on; depth; noise; inside; heading; text; share of it in links),
    ``nodes`` (node, parent, depth, inside, arrangement of children) of every block-level element.
    """

    nodes_known: dict[tuple[int, str], int] = {}

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[list[int], int, bool, bool, bool, str, float]] = []
        self.nodes: list[tuple[int, int, int, bool, int]] = []
        self.stack = [Element("", 0, 0, False, False)]
        self.text: list[str] = []
        self.linked = 0
        self._parse(source)

    def _node(self, parent: int, tag: str, style: str) -> int:
        key = (parent, f"{tag}.{re.sub('[0-9]{3,}', '0', style)}")
        found = self.nodes_known.get(key)
        if found is None:
            if len(self.nodes_known) > 200_000:
                self.nodes_known.clear()
            found = self.nodes_known[key] = xxhash.xxh3_64_intdigest(f"{parent}>{key[1]}") >> 1
        return found

    def _flush(self) -> None:
        """Ends a block of text."""
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                blocks = [e for e in self.stack if e.tag in BLOCK or not e.tag]
                heading = blocks[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                told = [e.node for e in blocks if e.inside]
                self.blocks.append((told or [e.node for e in blocks], blocks[-1].depth, self.stack[-1].noise, self.stack[-1].inside, heading, text, min(1.0, self.linked / len(text))))
            self.text, self.linked = [], 0

    def _close(self, depth: int) -> None:
        """Closes the elements from ``depth`` of the stack on."""
        while len(self.stack) > depth:
            e, below = self.stack[-1], self.stack[-2]
            if e.tag in BLOCK or e.noise != below.noise:
                self._flush()
            self.stack.pop()
            if e.tag in BLOCK and e.depth != below.depth:  # deeper than DEPTH an element is part of the one it is in
                arranged = [c for k, c in enumerate(e.children) if k == 0 or c != e.children[k - 1]]
                self.nodes.append((e.node, below.node, e.depth, e.inside, xxhash.xxh3_64_intdigest(str(arranged)) >> 1 if arranged else 0))

    def _open_place(self, tags: set[str], until: set[str]) -> int | None:
        """Where the innermost open element of ``tags`` stands, if no element of ``until`` is inside it."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in until:
                return None
        return None

    def _open(self, tag: str, source: str) -> None:
        block = tag in BLOCK
        if tag not in HEAD and (k := self._open_place({"head"}, {"body"})):
            self._close(k)
        if block:
            if tag in CLOSES_P and (k := self._open_place({"p"}, {"td", "th", "caption", "button", "object", "table"})):
                self._close(k)
            if tag in CLOSED_BY:
                while k := self._open_place(CLOSED_BY[tag], SCOPE.get(tag, TABLE)):
                    self._close(k)
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1]
        given = attributes(source) if source.strip() else {}
        noise = above.noise or says_noise(tag, given, above.inside)
        main = tag in ("article", "main") or given.get("role", "").lower() in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
        if noise != above.noise and not block:
            self._flush()  # an inline advert ends the text before it without belonging to it
        if block and above.depth < DEPTH:
            e = Element(tag, self._node(above.node, tag, given.get("class", "").lower()), above.depth + 1, noise, above.inside or (main and not noise))
            next(x for x in reversed(self.stack) if x.tag in BLOCK or not x.tag).children.append(e.node)
        else:
            e = Element(tag, above.node, above.depth, noise, above.inside or (main and not noise))
        self.stack.append(e)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "p" and self._open_place({"p"}, {"td", "th", "caption", "button", "table"}) is None:
            self._flush()
            return
        k = self._open_place({tag}, {"td", "th", "table"} - {tag} if tag not in BLOCK else {"table"} - {tag} if tag in ("td", "th", "tr", "li", "p") else set())
        if k is None or (tag not in BLOCK and any(e.tag in BLOCK for e in self.stack[k:])):
            return
        if self.stack[k].noise != self.stack[k - 1].noise:
            self._flush()
        self._close(k)

    def _parse(self, source: str) -> None:
        at, links = 0, 0
        while True:
            m = TAG.search(source, at)
            part = source[at : m.start()] if m else source[at:]
            if part:
                self.text.append(part)
                if links:
                    self.linked += len(part)
            if not m:
                break
            at = m.end()
            tag = (m.group(2) or m.group(5) or "").lower()
            if not tag:
                continue
            if m.group(1) or m.group(4):
                self._end(tag)
                links = 0 if tag == "a" else links
                continue
            self._open(tag, m.group(3) or m.group(6) or "")
            links = 1 if tag == "a" else links
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else len(source)
        self._flush()
        self._close(1)


def kept(page: Page, low: set[int]) -> list[str]:
    """The blocks of the article: without noise, and without branches in ``low``.

    Where elements say that they hold the article, only what they hold counts; elsewhere,
    lists and blocks that are mostly links go, too.
    """
    quiet = [b for b in page.blocks if not b[2]]
    told = [b for b in quiet if b[3]]
    blocks = told or [b for b in quiet if b[6] <= 0.5]
    return [text for nodes, _, _, _, heading, text, _ in blocks if not (low and any(n in low for n in nodes) and not (told and heading))]


def statistics(pages: list[tuple[int, str]]) -> dict[tuple, int]:
    """Of pages (site, html): how many have each (site, node, kind, value, depth, inside).

    Kinds: 0 the node itself (value: its parent), 1 a text right in it, 2 an arrangement of its children.
    """
    found: dict[tuple, int] = {}
    for site, source in pages:
        page = Page(source)
        here = set()
        for node, parent, depth, inside, arranged in page.nodes:
            here.add((site, node, 0, parent, depth, inside))
            if arranged:
                here.add((site, node, 2, arranged, depth, inside))
        for nodes, depth, _, inside, _, text, _ in page.blocks:
            here.add((site, nodes[-1], 1, xxhash.xxh3_64_intdigest(text) >> 1, depth, inside))
        for key in here:
            found[key] = found.get(key, 0) + 1
    return found


def importance(counted: DataFrame) -> DataFrame:
    """site, node, m (pages), inside, composite, top: of every node, from rows (site, node, kind, value, depth, inside, n).

    Composite importance goes up level by level.  ``top`` is the greatest of a
    branch, its rare parts (on less than SHARE of the node's pages) left aside.
    """
    pages = counted.where("kind = 0").groupBy("site", "node").agg(F.sum("n").alias("m"), F.min("depth").alias("depth"), F.max("inside").alias("inside"), F.min("value").alias("parent"))
    shares = counted.where("kind > 0").groupBy("site", "node", "kind", "value").agg(F.sum("n").alias("n")).join(pages.select("site", "node", "m"), ["site", "node"])
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    p = F.col("n") / F.col("m")
    nodes = shares.groupBy("site", "node").agg(
        F.avg(F.when(F.col("kind") == 1, F.when(F.col("m") > 1, 1 - F.log(F.col("n").cast("double")) / log_m).otherwise(1.0))).alias("content"),
        F.sum(F.when(F.col("kind") == 2, F.when(F.col("m") > 1, -p * F.log(p) / log_m).otherwise(1.0))).alias("style"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("styles"),
    )
    nodes = cut(pages.join(nodes, ["site", "node"], "left").fillna(0, ["styles"]))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = below = None
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("sum", F.lit(0.0)).withColumn("weight", F.lit(0)).withColumn("most", F.lit(None).cast("double"))
        else:
            above = below.join(level.select("site", F.col("node").alias("parent"), F.col("m").alias("m_above")), ["site", "parent"])
            frequent = F.when(F.col("m") >= SHARE * F.col("m_above"), F.col("top"))
            children = above.groupBy("site", F.col("parent").alias("node")).agg(F.sum(F.col("composite") * F.col("m")).alias("sum"), F.sum(F.when(F.col("composite").isNotNull(), F.col("m"))).alias("weight"), F.max(frequent).alias("most"))
            level = level.join(children, ["site", "node"], "left").fillna(0, ["sum", "weight"])
        own = F.when(F.col("content").isNotNull(), F.col("m")).otherwise(0)
        inner = (F.col("sum") + F.coalesce("content", F.lit(0.0)) * own) / F.when(F.col("weight") + own > 0, F.col("weight") + own)
        damp = F.pow(F.lit(DAMP), F.col("styles"))
        composite = F.when(F.col("styles") == 0, F.col("content")).otherwise((1 - damp) * F.col("style") + damp * inner)
        below = cut(level.withColumn("composite", composite).withColumn("top", F.greatest(composite, "most", "content")).select("site", "node", "parent", "m", "inside", "composite", "top"))
        done = below if done is None else done.unionAll(below)
    return done if done is not None else nodes.select("site", "node", "parent", "m", "inside", F.lit(None).cast("double").alias("composite"), F.lit(None).cast("double").alias("top"))


def low_branches(scored: DataFrame) -> DataFrame:
    """site, low: the nodes of each site whose branch is of low importance.

    A node seen on one page says nothing, nor does a site whose pages repeat as a
    whole.  Inside articles more is asked for, and nothing goes where they repeat.
    """
    articles = scored.where("inside").groupBy("site").agg((F.sum(F.col("composite") * F.col("m")) / F.sum(F.when(F.col("composite").isNotNull(), F.col("m")))).alias("articles"))
    whole = scored.where("parent = 0").groupBy("site").agg(F.max("top").alias("whole"))
    judged = scored.where(f"m > 1 AND top < {LOW}").join(articles, "site", "left").join(whole, "site", "left")
    chosen = judged.where(f"(NOT inside AND whole >= {LOW}) OR (inside AND m >= {PAGES} AND top < {INSIDE} AND articles >= {LOW})")
    return chosen.groupBy("site").agg(F.collect_list("node").alias("low"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    The text is the article's, without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, markup and comments of readers.  Character references
    are decoded, white space inside a block is one space, blocks are joined by one
    space in page order.  A site is a host (in lower case); pages without one are one site.

    Every page's whole tree counts in its site's.  Counts are combined inside tasks before
    they are shuffled by site, node and text, so a large site is many groups; what
    comes back to the pages is a site's list of nodes of low importance.

    Defined cases: a null or empty source has an empty text.  Rows that repeat an
    id, or have none, are pages of their own (and count as such).  Only the named columns
    are read; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("html"), F.xxhash64(host).alias("site"))
    names = ["site", "node", "kind", "value", "depth", "inside"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(list(zip(batch.column("site").to_pylist(), (x.as_py() for x in batch.column("html")), strict=True)))
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(found.values(), pa.int64())], [*names, "n"])

    counted = cut(rows.select("site", "html").mapInArrow(count, "site long, node long, kind int, value long, depth int, inside boolean, n long").groupBy(*names).agg(F.sum("n").alias("n")))
    low = cut(low_branches(importance(counted)))
    sent = (low.agg(F.sum(F.size("low") + F.lit(4))).first()[0] or 0) <= SENT
    marked = rows.join(F.broadcast(low) if sent else low, "site", "left")
    out = marked.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(kept(Page(source.as_py()), set(low.as_py() or ()))) for source, low in zip(batch.column("html"), batch.column("low"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return marked.select("page_id", "url", "html", "low").mapInArrow(read, out)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op12_html_text": op12_html_text}
ORACLES: dict[str, str] = {}
