"""Problem 3: the main text of a page without what serves the site.

Composite text density: characters per tag, adjusted for links, of every node of the
page's tree; the sum of its children's densities tells how much text a node gathers.
On the way from the page's heading to the body, the node with the largest sum is the
main subtree; its containers whose density is under the least one on the way from it to
the body are pruned. What sites repeat is told by the whole corpus, not by names of
classes: texts shown outside of main text far more often than inside, containers that
such a text heads, that hold the same few texts on the pages of many cases, or that end
in the same neighbours whatever else they hold, are taken out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.html_tree import INLINE, PARTS, Node, blocks, decode, hidden, parse
from caseloom.sources.tables import c, cut, spread, table

#: A text is the site's if so many pages show it outside of main text, and so many times more than inside.
SITE_PAGES, SITE_TIMES = 5, 2
#: Containers with one first text are the site's if so many cases show them and they hold at most this share of different contents,
#: or if so many different contents share two neighbouring texts in this share of them.
BOX_CASES, BOX_KINDS, BOX_SAME = 5, 0.2, 0.5
#: Up to so many site texts (16 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_TEXTS = 200_000

# Tags and roles that serve a site.
SITE_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu"}
SITE_ROLES = {"navigation", "complementary", "contentinfo", "dialog", "banner", "search", "menu", "menubar", "tablist", "toolbar", "alertdialog"}
_HEADING = re.compile("h[1-6]")
#: What may stand before a colon and head a text.
_LABEL = re.compile(r"([^:]{2,60}):\s")


def _of_site(node: Node) -> bool:
    """Whether an element's tag or role says that it serves the site."""
    return node.tag in SITE_TAGS or bool(node.attr) and "role" in node.attr and node.attrs().get("role", "").lower() in SITE_ROLES


def _is_box(node: Node) -> bool:
    """Whether an element is a container of several parts: a list or a division, but no piece of a table or of labelled values."""
    if node.tag == "p" or (node.tag in PARTS and node.tag not in ("ul", "ol")) or _HEADING.fullmatch(node.tag):
        return False
    return any(not isinstance(k, str) and k.tag not in INLINE for k in node.kids)


def measure(root: Node) -> None:
    """Composite text density of every node, and the sum over its children."""

    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if not isinstance(k, str)]
    for x in reversed(order):
        if hidden(x):
            continue
        for k in x.kids:
            if isinstance(k, str):
                x.c += len(k) if "\n" not in k and "  " not in k else len(" ".join(k.split()))
            else:
                x.c += k.c
                x.t += k.t + 1
                x.lc += k.lc
                x.lt += k.lt + (k.tag == "a")
        if x.tag == "a":
            x.lc = x.c
    base = root.lc / max(root.c, 1)
    for x in order:
        if not x.c:
            continue
        links, other = max(x.lc, 1), max(x.c - x.lc, 1)
        log_of = math.log(x.c / other * x.lc + base * x.c + math.e)
        ratio = x.c / links * max(x.t, 1) / max(x.lt, 1)
        x.d = x.c / max(x.t, 1) * (math.log(max(ratio, 1.0000001)) / math.log(log_of) if log_of > 1.0000001 else math.log(max(ratio, 1.0000001)))
    for x in order:
        x.sum = sum(k.d for k in x.kids if not isinstance(k, str))


class Page:
    """The blocks of a page: heading, own blocks with the containers that they are in, and the site's; none of its own where it shows no item.

    own: (text, numbers of containers within the main subtree, the outermost first); boxes: the texts directly in each container.
    """

    def __init__(self, body: bytes):
        root, self.title = parse(decode(body))
        self.heading: str | None = None
        self.own: list[tuple[str, tuple[int, ...]]] = []
        self.site: list[str] = []
        self.boxes: list[list[str]] = []
        found = blocks(root)
        at = self._find_heading(found)
        if at is None:
            self.site = [b for b, _ in found]
            return
        self.heading = found[at][0]
        measure(root)
        path = []
        x = found[at][1]
        while x is not root and x is not None:
            path.append(x)
            x = x.up
        holders = [x for x in path if x.tag not in INLINE and x.tag not in ("html", "p", "tr", "tbody", "table") and not re.fullmatch("h[1-6]|dt|dd|ul|ol", x.tag)] or [root]
        main = max(holders, key=lambda x: x.sum)
        i = path.index(main) if main in path else len(path) - 1
        floor = min((x.d for x in path[i:] if x.tag != "html"), default=0.0)
        self.own.append((self.heading, ()))
        within = self._status(main, set(map(id, path)), floor)
        for k, (text, node) in enumerate(found):
            if k == at:
                continue
            boxes = within(node) if k > at else None
            if boxes is None:
                self.site.append(text)
                continue
            self.own.append((text, boxes))
            if boxes:
                self.boxes[boxes[-1]].append(text)

    def _status(self, main: Node, path: set[int], floor: float) -> Callable[[Node], tuple[int, ...] | None]:
        """For an element after the heading, the containers within the main subtree that it is in; None outside of main, in a part of
        the site, or in a container under floor."""
        known: dict[int, tuple[int, ...] | None] = {id(main): ()}

        def of(node: Node) -> tuple[int, ...] | None:
            up = []
            while node is not None and id(node) not in known:
                up.append(node)
                node = node.up
            at = known[id(node)] if node is not None else None
            for x in reversed(up):
                if at is not None and x.tag not in INLINE:
                    if _of_site(x):
                        at = None
                    elif _is_box(x):
                        if at == () and id(x) not in path and x.d < floor and x.tag not in PARTS:
                            at = None
                        else:
                            self.boxes.append([])
                            at = (*at, len(self.boxes) - 1)
                known[id(x)] = at
            return at

        return of

    def _find_heading(self, found: list[tuple[str, Node]]) -> int | None:
        """The block that the page's title names: a proper beginning of it, before a separator and the site's name."""
        best, title = None, self.title
        for i, (text, node) in enumerate(found):
            if len(text) < len(title) and title.startswith(text) and re.match(r"\s*[|–—:·»/-]\s*\S", title[len(text) :]):
                x = node
                while x is not None and not _of_site(x):
                    x = x.up
                if x is None and (best is None or len(text) > len(found[best][0])):
                    best = i
        return best


def _md5(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


#: Kinds of rows of page_blocks().
SITE, OWN, HEADING, BOX = 0, 1, 2, 3


def page_blocks(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(__page, __kind, __md5, __boxes, __label, __head, __first, __pairs): the different blocks and the containers of every page.

    SITE, OWN and HEADING are blocks: __boxes their containers, __label the hash of what stands before a colon, __head whether they
    are the first in their container. BOX is a container: __boxes its number, __md5 its contents, __first its first text, __label
    the page's heading, __pairs hashes of its neighbouring texts.
    """

    def rows_of(page: Page) -> list[tuple]:
        seen: dict[tuple, tuple] = {}
        direct = {page.heading}
        for text, boxes in page.own:
            head = bool(boxes) and page.boxes[boxes[-1]][0] == text
            if not head:
                direct.add(text)
            if text != page.heading:
                label = _LABEL.match(text)
                seen[text, boxes] = (OWN, _md5(text), list(boxes), _md5(label[1].rstrip()) if label else None, head, None, None)
        for text in page.site:
            if text not in direct:
                seen[text, None] = (SITE, _md5(text), None, None, False, None, None)
        if page.heading is None:
            return list(seen.values())
        heading = _md5(page.heading)
        boxes = [
            (BOX, _md5("\n".join(b)), [k], heading, len(b) > 1, _md5(b[0]), sorted({xxhash.xxh64_intdigest(f"{x}\n{y}".encode("utf-8", "surrogatepass")) - (1 << 63) for x, y in zip(b, b[1:], strict=False)}))
            for k, b in enumerate(page.boxes) if b
        ]
        return [(HEADING, heading, None, None, False, None, None), *seen.values(), *boxes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int8(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))
        names = ("__kind", "__md5", "__boxes", "__label", "__head", "__first", "__pairs")
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                at, rows = [], []
                for i, body in enumerate(part.column(1).to_pylist()):
                    got = rows_of(Page(body))
                    at += [i] * len(got)
                    rows += got
                cols = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, t) for x, t in zip(cols, types, strict=True)]], names=["__page", *names])

    rows = spread(pages.select(c(id_col).cast("long").alias("__page"), c(body_col).alias("__body")).where(F.length("__body") > 0))
    return rows.mapInArrow(run, "__page long, __kind byte, __md5 binary, __boxes array<int>, __label binary, __head boolean, __first binary, __pairs array<long>")


def site_boxes(boxes: DataFrame) -> DataFrame:
    """(__first): first texts of containers of several texts that are the site's by what they hold: the same on the pages of
    many cases, or, in most of their different contents, the same two neighbours."""
    kinds = boxes.where("__head").groupBy("__first", "__md5", "__label").agg(F.any_value("__pairs").alias("pairs")).groupBy("__first", "__md5").agg(F.count(F.lit(1)).alias("cases"), F.any_value("pairs").alias("pairs"))
    kinds = cut(kinds, "box-kinds")
    per = kinds.groupBy("__first").agg(F.sum("cases").alias("cases"), F.count(F.lit(1)).alias("kinds"))
    fixed = per.where((F.col("cases") >= BOX_CASES) & (F.col("kinds") <= BOX_KINDS * F.col("cases"))).select("__first")
    pairs = kinds.select("__first", F.explode("pairs").alias("pair")).groupBy("__first", "pair").agg(F.count(F.lit(1)).alias("k")).groupBy("__first").agg(F.max("k").alias("k"))
    ends = pairs.join(per.where(F.col("kinds") >= BOX_CASES), "__first").where(F.col("k") >= BOX_SAME * F.col("kinds")).select("__first")
    return fixed.unionByName(ends).distinct()


def main_blocks(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(__page, __own, __md5): blocks of the main text, the heading (2) included.

    Null, empty and other bodies that show no item of their own have none; equal pages
    have equal blocks; the site's texts and containers are told by all pages given.
    """
    rows = cut(page_blocks(pages, id_col, body_col), "blocks")
    inside = (F.col("__kind") == HEADING) | ((F.col("__kind") == OWN) & ~F.col("__head"))
    shown = rows.where(F.col("__kind") != BOX).groupBy("__md5").agg(F.count_if(F.col("__kind") == SITE).alias("n_out"), F.count_if(inside).alias("n_in"))
    sites = cut(shown.where((F.col("n_out") >= SITE_PAGES) & (F.col("n_out") >= SITE_TIMES * F.col("n_in"))).select("__md5"), "site-texts")
    boxes = rows.where(F.col("__kind") == BOX)
    firsts = site_boxes(boxes).unionByName(sites.select(F.col("__md5").alias("__first"))).distinct()
    firsts = cut(firsts, "site-firsts")
    few = firsts.count() <= BROADCAST_TEXTS  # site texts are among them
    bound = F.broadcast if few else lambda df: df
    bad = boxes.join(bound(firsts), "__first", "left_semi").groupBy("__page").agg(F.collect_set(F.col("__boxes")[0]).alias("__bad"))  # containers of one page
    own = rows.where(F.col("__kind") == OWN).select("__page", "__md5", "__boxes", "__label")
    own = own.join(bound(sites), "__md5", "left_anti").join(bound(sites.select(F.col("__md5").alias("__label"))), "__label", "left_anti")
    loose, boxed = own.where(F.size("__boxes") == 0), own.where(F.size("__boxes") > 0)
    boxed = cut(boxed.join(bad, "__page", "left").select("__page", "__md5", F.coalesce(F.arrays_overlap("__boxes", "__bad"), F.lit(False)).alias("__out")), "boxed")
    # Texts of the site's containers that stand alone on some pages.
    out = boxed.where("__out").groupBy("__md5").agg(F.count(F.lit(1)).alias("n_out")).where(F.col("n_out") >= SITE_PAGES)
    out = cut(out, "box-texts")
    bound = F.broadcast if out.count() <= BROADCAST_TEXTS else lambda df: df
    own = loose.select("__page", "__md5").unionByName(boxed.where("NOT __out").select("__page", "__md5"))
    kept = own.join(bound(out.select("__md5")), "__md5", "left_semi").groupBy("__md5").agg(F.count(F.lit(1)).alias("n_in"))
    alone = out.join(kept, "__md5", "left").where(F.col("n_out") >= SITE_TIMES * F.coalesce("n_in", F.lit(0))).select("__md5")
    own = own.join(bound(alone), "__md5", "left_anti").distinct()
    head = rows.where(F.col("__kind") == HEADING).select("__page", F.lit(HEADING).alias("__own"), "__md5")
    return own.select("__page", F.lit(OWN).alias("__own"), "__md5").unionByName(head)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the blocks of each page's own case, and of its bare title where one is recorded."""
    found = main_blocks(table(spark, sf_dir, "http_outcome"), "page_id", "body")
    body = found.select(F.col("__page").alias("page_id"), F.lit("body").alias("piece"), F.lower(F.hex("__md5")).alias("block_md5"))
    titled = table(spark, sf_dir, "page_validation").where(F.col("case_title").isNotNull()).select("page_id").distinct()
    heads = found.where(F.col("__own") == HEADING).select(F.col("__page").alias("page_id"), "__md5").join(titled, "page_id", "left_semi")
    return body.unionByName(heads.select("page_id", F.lit("title").alias("piece"), F.lower(F.hex("__md5")).alias("block_md5")))


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the bare title and the main text, a line a block, as p3_found has them; null where a page shows no case."""
    pages = table(spark, sf_dir, "http_outcome")
    kept = main_blocks(pages, "page_id", "body").groupBy("__page").agg(F.collect_set("__md5").alias("kept"))  # blocks of one page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                titles, texts = [], []
                for body, hashes in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    page = Page(body) if hashes else None
                    own = [t for t, _ in page.own if _md5(t) in set(hashes)] if page else []
                    titles.append(page.heading if page else None)
                    texts.append("\n".join(own) if own else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["page_id", "title", "main_text"])

    rows = pages.select("page_id", "body").join(kept.withColumnRenamed("__page", "page_id"), "page_id", "left")
    return rows.mapInArrow(run, "page_id long, title string, main_text string")


def p3_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, those with a title and no text or a text and no title (0), titles that aren't the beginning of the page's text (0), and pages of failed fetches with a text (0)."""
    got = p3_text(spark, sf_dir).join(table(spark, sf_dir, "http_outcome").select("page_id", "status", F.coalesce(F.octet_length("body"), F.lit(0)).alias("n")), "page_id")
    return got.agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("title").isNull() != F.col("main_text").isNull()).alias("n_torn"), F.count_if(~F.startswith("main_text", "title")).alias("n_elsewhere"),
        F.count_if((F.coalesce("status", F.lit(0)) >= 400) & F.col("title").isNotNull()).alias("n_of_failures"), F.count_if((F.col("n") == 0) & F.col("title").isNotNull()).alias("n_of_empty"),
    )


QUERIES = {"p3_found": p3_found, "p3_text": p3_text, "p3_invariants": p3_invariants}
ORACLE = {"p3_invariants": "SELECT count(*) AS n_pages, 0 AS n_torn, 0 AS n_elsewhere, 0 AS n_of_failures, 0 AS n_of_empty FROM http_outcome"}
