"""HTML extraction by wrapper induction.

A page's tree is read into blocks of text, each with the slot it stands in: its element's node in the page's tree, equal
siblings folded into one. A host's most frequent tree is its reference; the host's other trees are aligned
with it by simple tree matching (the largest common tree that keeps order and ancestry), so that their nodes take
the reference's names. Over all pages of the host a slot whose text is always the same is template, and one whose text
varies, or that one page alone has, is content. What pages set aside (menus, headers, footers, sidebars, notices, adverts,
forms, comments) is no content wherever it stands, as it varies too; an article's own header is not set aside, nor is what holds the
page's main element or only article.

Pages that say the same outside those parts are copies and count once. A host of which there is only one such page shows
neither constancy nor variation; there content is what stands in an article or main element, if the page has one. Two pages may say the same by
chance (an article and its revision): of a host with two, what is constant within an article or main element stays. From three pages on the verdict over the pages decides alone.

What is gathered for each host are counts and extremes of text hashes by tree and slot, so a host that holds a third
of all pages is as many rows as any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .urlfilter import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select option title".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup li main nav ol p pre section summary table tbody thead tfoot tr td th caption ul br hr".split()
)
CLOSES_P = BLOCKS - {"html", "body", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"}
SELF_CLOSING = {"li": ("li", ("ul", "ol")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu head".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar"
    " aside contentinfo complementary cookie cookies consent notice alert popup modal newsletter subscribe share sharing social related comment comments commentlist commentform respond reply disqus form login search adsbygoogle adbox adslot topbar toolbar pagination pager gdpr widget widgets notification notifications".split()
)
MAIN = frozenset(("article", "main"))
FRAME = frozenset(("html", "body", "main"))  # never set aside, whatever their names
OWN_HEADER = frozenset(("header", "masthead"))  # of an article: part of it
READER = frozenset(("comment", "reply"))  # names of an article that a reader wrote
MODIFIER = re.compile(r"(?:has|with|no|is|without|hide|show)[-_]")  # such a class says what a layout has, not what a part is

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_OTHER = re.compile(r"<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*\Z")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _label(tag: str, attributes: str) -> str:
    """tag.name.name: the element's tag with its class, id and role words, digits left out."""
    tokens = [t for m in _NAMES.finditer(attributes) for t in (m[2] or m[3] or m[4] or "").lower().split()]
    words = {w for t in tokens if not MODIFIER.match(t) for w in re.split(r"[^a-z]+", t) if w}
    return ".".join([tag, *sorted(words)])


def blocks(html: str, labels: dict[tuple[str, str], str] | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The page's tree, (parent, label) of each node (node 0 is the root, parents come first), and its blocks in page
    order: (node, text). ``labels`` remembers what ``_label`` gave."""
    labels = {} if labels is None else labels
    out: list[tuple[int, str]] = []
    tree: list[tuple[int, str]] = [(-1, "")]
    number: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = []  # (tag, node that its text stands in)
    opened: dict[str, int] = {}
    text: list[str] = []
    where = 0

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                out.append((where, said))

    def say(piece: str) -> None:
        nonlocal where
        if piece:
            if not text:
                where = stack[-1][1] if stack else 0
            text.append(unescape(piece) if "&" in piece else piece)

    def close(tag: str, stops: tuple[str, ...] = ()) -> None:
        wanted = tag.split()
        if not any(opened.get(t) for t in wanted):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in wanted:
                if any(t in BLOCKS for t, _ in stack[i:]):
                    flush()
                for t, _ in stack[i:]:
                    opened[t] -= 1
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt)
        if not m:
            other = _OTHER.match(html, lt)
            if other:
                at = other.end()
            else:
                say("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened.get("p"):
                flush()
            close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if not m[3].endswith("/"):
                at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close("p", ("article", "section", "div", "table", "td", "li", "main", "body"))
        if tag in SELF_CLOSING:
            close(*SELF_CLOSING[tag])
        own = stack[-1][1] if stack else 0
        if tag in BLOCKS:
            key = (tag, m[3])
            label = labels.get(key)
            if label is None:
                if len(labels) > 20_000:
                    labels.clear()
                label = labels[key] = _label(*key)
            node = number.setdefault((own, label), len(tree))
            if node == len(tree):
                tree.append((own, label))
            own = node
        if not m[3].endswith("/"):
            stack.append((tag, own))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return tree, out


def parts(tree: list[tuple[int, str]]) -> tuple[list[bool], list[bool]]:
    """Of each node: whether it stands in a part that is set aside, and whether it stands in an article or main element that isn't."""
    split = [label.split(".") for _, label in tree]
    article = [tag == "article" and not READER.intersection(names) for tag, *names in split]
    goal = [tag == "main" for tag, *_ in split]
    if not any(goal) and sum(article) == 1:
        goal = article
    holds = list(goal)
    for n in range(len(tree) - 1, 0, -1):
        if holds[n]:
            holds[tree[n][0]] = True
    inside, aside = [False] * len(tree), [False] * len(tree)
    for n in range(1, len(tree)):
        up, (tag, *names) = tree[n][0], split[n]
        if tag == "article":
            own = not article[n]
        elif tag in FRAME or holds[n]:
            own = False
        else:
            spared = OWN_HEADER if inside[up] else frozenset()
            own = tag in ASIDE_TAGS - spared or not (ASIDE_NAMES - spared).isdisjoint(names)
        aside[n] = aside[up] or own
        inside[n] = not aside[n] and (inside[up] or tag in MAIN)
    return aside, inside


def tree_text(tree: list[tuple[int, str]]) -> str:
    return "\n".join(f"{up} {label}" for up, label in tree)


def tree_of(text: str) -> list[tuple[int, str]]:
    return [(int(up), label) for up, _, label in (line.partition(" ") for line in text.split("\n"))]


def _heaviest(places: list[int], weights: list[int]) -> list[int]:
    """Positions of the heaviest strictly increasing subsequence of ``places``."""
    rank = {p: i + 1 for i, p in enumerate(sorted(set(places)))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(rank) + 1)  # a Fenwick tree of (weight, position) over the places
    before = [-1] * len(places)
    top = (0, -1)
    for i, (p, w) in enumerate(zip(places, weights, strict=True)):
        k, found = rank[p] - 1, (0, -1)
        while k:
            found, k = max(found, best[k]), k & (k - 1)
        before[i] = found[1]
        own = (found[0] + w, i)
        top, k = max(top, own), rank[p]
        while k < len(best):
            best[k], k = max(best[k], own), k + (k & -k)
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(reference: list[tuple[int, str]], tree: list[tuple[int, str]]) -> list[int | None]:
    """Simple tree matching: for each node of ``tree`` the node of ``reference`` it is matched with, if any.

    Siblings have different labels, so a node has one possible partner at most, the one of its path; among the partners of
    a pair's children the heaviest choice that keeps their order is taken, deepest pairs first."""
    place = {node: i for i, node in enumerate(reference)}
    partner: list[int | None] = [0] + [None] * (len(tree) - 1)
    kids: list[list[int]] = [[] for _ in tree]
    for n in range(1, len(tree)):
        up = partner[tree[n][0]]
        partner[n] = None if up is None else place.get((up, tree[n][1]))
        if partner[n] is not None:
            kids[tree[n][0]].append(n)
    size, chosen = [0] * len(tree), [[] for _ in tree]
    for n in range(len(tree) - 1, -1, -1):
        if kids[n]:
            keep = _heaviest([partner[k] for k in kids[n]], [1 + size[k] for k in kids[n]])
            chosen[n] = [kids[n][i] for i in keep]
            size[n] = sum(1 + size[k] for k in chosen[n])
    out: list[int | None] = [0] + [None] * (len(tree) - 1)
    todo = [0]
    while todo:
        for k in chosen[todo.pop()]:
            out[k] = partner[k]
            todo.append(k)
    return out


def names(reference: list[tuple[int, str]], tree: list[tuple[int, str]]) -> list[int]:
    """A number for each node of ``tree``: its partner's in ``reference``, or a negative one that is the same for equal paths
    below the same partner."""
    out: list[int] = []
    for (up, label), to in zip(tree, align(reference, tree), strict=True):
        out.append(to if to is not None else -1 - (xxhash.xxh64_intdigest(f"{out[up]} {label}") >> 1))
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, tree, blocks (array of slot, text; what is set aside is left out)."""
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[tuple[str, str], str] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                trees, found = [], []
                for value in batch.column(3):
                    tree, own = blocks(value.as_py() or "", labels)
                    aside, _ = parts(tree)
                    trees.append(tree_text(tree))
                    found.append([{"slot": n, "text": t} for n, t in own if not aside[n]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(trees, pa.string()), pa.array(found, kind)], ["page_id", "url", "host", "tree", "blocks"])

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, host string, tree string, blocks array<struct<slot:int,text:string>>"
    )


def wrappers(rows: DataFrame) -> DataFrame:
    """rows: host, tree, key (a digest of tree), blocks. host, key, content (array of slots): which slots of each tree of a host hold content.

    Of equally frequent trees the one with the smaller digest is the reference."""
    trees = rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.first("tree").alias("tree"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "key"))
    reference = trees.withColumn("__r", first).filter("__r = 1").select("host", F.col("tree").alias("reference"))
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("name", pa.int64()), ("inside", pa.bool_()), ("main", pa.bool_())]))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (tree_of(batch.column(i)[r].as_py()) for i in (2, 3))
                _, inside = parts(b)
                none = not any(inside)
                own = [{"slot": n, "name": x, "inside": y, "main": y or none} for n, (x, y) in enumerate(zip(names(a, b), inside, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), pa.array([own], kind)], ["host", "key", "nodes"])

    aligned = trees.join(reference, "host").select("host", "key", "reference", "tree").mapInArrow(named, "host string, key string, nodes array<struct<slot:int,name:long,inside:boolean,main:boolean>>")
    nodes = aligned.select("host", "key", F.explode("nodes").alias("x")).select("host", "key", "x.*")
    page = F.xxhash64(F.transform("blocks", lambda b: b["text"]))  # pages of the same texts are copies and count once
    hashed = rows.select("host", "key", page.alias("p"), F.explode("blocks").alias("b")).select("host", "key", "p", "b.slot", F.xxhash64("b.text").alias("h"))
    seen = hashed.groupBy("host", "key", "slot").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    joined, _ = written(seen.join(nodes, ["host", "key", "slot"]), "slots")
    one = F.min("first") == F.max("last")
    varies = joined.groupBy("host", "name").agg(((F.min("lo") != F.max("hi")) | one).alias("varies"))
    pages = rows.filter(F.size("blocks") > 0).select("host", page.alias("p")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    verdict = F.when(F.col("pages") == 1, F.col("main")).otherwise(F.col("varies") | ((F.col("pages") == 2) & F.col("inside")))
    good = joined.join(varies, ["host", "name"]).join(pages, "host").filter(verdict)
    return good.groupBy("host", "key").agg(F.collect_set("slot").alias("content"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; other columns are ignored, whatever their names.

    Null html, and html without content, give an empty text. A null url is a page of the host without a name. Tags
    that the html breaks off in are dropped, elements it leaves open end with it; pages are read whole at any length and depth. Rows that
    repeat stay and get the same text; a page and its copies count once for its host. An empty table gives an empty result."""
    rows, _ = written(parsed(pages).withColumn("key", F.md5("tree")), "blocks")
    found, _ = written(wrappers(rows), "wrappers")  # written, so that its size decides how it is joined
    content = found.select(F.col("host").alias("__h"), F.col("key").alias("__t"), "content")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("content", b["slot"])), lambda b: b["text"]), "\n")
    return (
        rows.select("page_id", "url", "host", "key", "blocks").join(content, (F.col("host") == F.col("__h")) & (F.col("key") == F.col("__t")), "left")
        .select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
