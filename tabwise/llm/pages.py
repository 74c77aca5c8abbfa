"""Main text of web pages by wrapper induction.

The block elements of a page form a tree (inline elements and repeated
paragraphs, list items and table rows belong to one node). The commonest tree
of a host is its wrapper; every page's tree is aligned with it by simple tree
matching. For each wrapper node the texts of all pages are counted, pages with
the same main text once: a node whose few texts recur over the host's pages is
template, a node whose texts vary is a content slot. Both tables, a wrapper and
a list of template nodes per host, are joined with the pages again.

What the page itself says comes first: scripts, styles, forms, navigation,
asides, footers, page headers and elements whose class, id or role names a
menu, advert, notice, comment and the like are no main text, and where a page
has an ``article`` (or ``main``) the text is the longest one's. Headings stay.

Three passes parse the pages on the executors; shuffled are tree shapes and
text hashes, never the pages. Counts are combined before each shuffle, so a
host with a third of all pages costs no more than others.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import hinted, small_batches, written

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

#: Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p "
    "pre search section select summary table tbody td template tfoot th thead tr ul".split())
REPEATED = set("p li tr td th dt dd h1 h2 h3 h4 h5 h6 pre blockquote figure option".split())
NO_CONTENT = set(
    "head nav aside footer form button select datalist option optgroup menu dialog noscript template object svg "
    "canvas audio video map math iframe script style title textarea xmp noembed noframes search".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                  "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
#: Words of classes, ids and roles that name something other than main text.
NO_CONTENT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar "
    "aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs masthead topbar toolbar header footer "
    "colophon contentinfo complementary cookie cookies consent gdpr notice notices notification popup modal overlay "
    "comment comments commentlist reply replies respond discussion disqus reactions share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login search searchform widget widgets "
    "pagination pager copyright hidden".split())

_RAW_END = {tag: re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I) for tag in RAW}
#: Levels of the tree, children of a node, open elements; text beyond goes to the last of them.
MAX_DEPTH, MAX_CHILDREN, MAX_OPEN = 64, 64, 256


class Page:
    """Block tree and text blocks of one page."""

    def __init__(self, source: str):
        self.labels: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.children: list[list[int]] = [[]]
        self.blocks: list[tuple[int, str, bool, int]] = []  # node, text, no content, article number
        self.kinds: list[str] = []  # tag of each article number
        self._parse(source)

    def _child(self, parent: int, label: str, tag: str) -> int:
        """The node for an element: a repeated one joins its neighbour."""
        here = self.children[parent]
        if here and self.labels[here[-1]] == label and (tag in REPEATED or len(here) >= MAX_CHILDREN):
            return here[-1]
        if len(here) >= MAX_CHILDREN:
            label = "#more"
            if self.labels[here[-1]] == label:
                return here[-1]
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        here.append(len(self.labels) - 1)
        return here[-1]

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, int, int]] = [("#root", 0, 0, -1)]  # tag, node, no content (2: by element), article
        text: list[str] = []

        def flush() -> None:
            if text:
                block = _SPACE.sub(" ", "".join(text)).strip()
                if block:
                    _, node, hidden, article = stack[-1]
                    self.blocks.append((node, block, bool(hidden), article))
                text.clear()

        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                text.append(html.unescape(source[at:]))
                break
            if m.start() > at:
                text.append(html.unescape(source[at:m.start()]))
            at = max(m.end(), m.start() + 1)
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if closing:
                if tag == "br":
                    text.append(" ")
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if k:
                    if tag in BLOCK or any(s[0] in BLOCK or s[2] != stack[k - 1][2] for s in stack[k:]):
                        if tag not in BLOCK and any(s[0] in BLOCK for s in stack[k + 1:]):
                            continue  # an inline end tag does not close blocks
                        flush()
                    del stack[k:]
                continue
            if tag in RAW:
                close = _RAW_END[tag].search(source, at)
                at = close.end() if close else end
                continue
            if tag == "br" or tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    text.append(" " if tag in ("br", "wbr", "img") and tag != "wbr" else "")
                continue
            if tag in BLOCK:
                flush()
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
                if k and not any(s[0] in ("button", "table", "object") for s in stack[k:]):
                    del stack[k:]
                same, scope = CLOSED_BY_SAME.get(tag, ()), SCOPES.get(tag, ())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in same:
                        del stack[i:]
                        break
            if attributes.endswith("/") and tag in ("svg", "path"):
                continue
            self._open(stack, tag, attributes, flush)
        flush()

    def _open(self, stack: list, tag: str, attributes: str, flush) -> None:
        _, node, hidden, article = stack[-1]
        names: list[str] = []
        said = False
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), (a or b or c)
                if name in ("class", "id", "role"):
                    names += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    said = True
        landmark = tag in ("article", "main") or "main" in names and tag == "div"
        no_content = said or any(n in NO_CONTENT_WORDS for n in names)
        if tag in ("html", "body"):
            no_content = said
        if tag == "header" and article < 0:
            no_content = True
        if landmark and hidden == 1 and not no_content:
            hidden = 0  # an ancestor's class does not hide an article
        if tag in NO_CONTENT:
            hidden = 2
        elif no_content:
            hidden = hidden or 1
        if tag in BLOCK:
            if len(stack) < MAX_DEPTH:
                node = self._child(node, ".".join([tag, *sorted(set(names))]), tag)
            if tag in ("article", "main") and not hidden:
                nested = article >= 0 and (tag == "main" or self.kinds[article] == "article")
                if not nested:
                    article = len(self.kinds)
                    self.kinds.append(tag)
        elif hidden != stack[-1][2]:
            flush()
        if len(stack) < MAX_OPEN:
            stack.append((tag, node, hidden, article))

    def shape(self) -> str:
        """The tree as text: parent number and label of every node."""
        return "\n".join(f"{p} {label}" for p, label in zip(self.parents, self.labels, strict=True))

    def texts(self) -> dict[int, str]:
        """Text per node (all its blocks)."""
        out: dict[int, list[str]] = {}
        for node, text, _, _ in self.blocks:
            out.setdefault(node, []).append(text)
        return {n: "\n".join(t) for n, t in out.items()}

    def main_text(self, template: set[int] = frozenset()) -> str:
        """Blocks that are main text, joined by an empty line. ``template``:
        nodes that the host's pages have in common."""
        shown = [b for b in self.blocks if not b[2]]
        kept = [b for b in shown if b[0] not in template]
        sizes: Counter = Counter()
        for _, text, _, article in kept:
            if article >= 0:
                sizes[article] += len(text)
        for kind in ("article", "main"):
            mine = [a for a in sizes if self.kinds[a] == kind]
            if mine:
                best = max(mine, key=lambda a: (sizes[a], -a))
                return "\n\n".join(t for _, t, _, a in kept if a == best)
        return "\n\n".join(t for _, t, _, _ in kept)


def tree(shape: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a shape's nodes."""
    labels, children = [], []
    for i, line in enumerate(shape.split("\n")):
        parent, label = line.split(" ", 1)
        labels.append(label)
        children.append([])
        if int(parent) >= 0:
            children[int(parent)].append(i)
    return labels, children


def align(shape: str, wrapper: str) -> dict[int, int]:
    """Simple tree matching: node of ``shape`` -> node of ``wrapper``. Two
    nodes match if their labels do; their children match in order so that the
    number of matched nodes is largest."""
    a_labels, a_children = tree(shape)
    if shape == wrapper:
        return {i: i for i in range(len(a_labels))}
    b_labels, b_children = tree(wrapper)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Matched nodes below (and with) a pair, and the pairs of children."""
        if (a, b) in memo:
            return memo[a, b]
        if a_labels[a] != b_labels[b]:
            memo[a, b] = 0, []
            return memo[a, b]
        xs, ys = a_children[a], b_children[b]
        size = [[match(x, y)[0] for y in ys] for x in xs]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(len(xs)):
            for j in range(len(ys)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size[i][j])
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        memo[a, b] = 1 + best[len(xs)][len(ys)], pairs
        return memo[a, b]

    match(0, 0)
    out, todo = {}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += memo[a, b][1]
    return out


def places(wrapper: str) -> tuple[set[int], set[int]]:
    """Nodes inside an article or main element, and headings."""
    labels, children = tree(wrapper)
    inside, todo = set(), [i for i, x in enumerate(labels) if x.split(".")[0] in ("article", "main")]
    while todo:
        node = todo.pop()
        if node not in inside:
            inside.add(node)
            todo += children[node]
    return inside, {i for i, x in enumerate(labels) if re.match(r"h[1-6](\.|$)", x)}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def wrappers(pages: DataFrame, min_pages: int = 5, variety: float = 0.3, max_hosts: int = 200_000) -> DataFrame:
    """(host, wrapper, template): the commonest tree of every host and the
    nodes of it that are template: found with ``min_pages`` different main
    texts or more, with at most ``variety`` different texts for each of them.
    Inside an article it takes twice the pages and next to no variety, and
    headings are never template, so that pages whose articles have much in
    common keep them. ``pages``: host, html."""
    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = Counter(zip(frame["host"], (Page(h).shape() for h in frame["html"]), strict=True))
            yield pd.DataFrame({"host": [k[0] for k in found], "shape": [k[1] for k in found], "n": list(found.values())})

    trees = pages.select("host", "html").mapInPandas(shapes, "host string, shape string, n bigint")
    counted = trees.groupBy("host", "shape").agg(F.sum("n").alias("n"))
    common = written(counted.groupBy("host").agg(F.max(F.struct("n", "shape")).alias("m")).select(
        "host", F.col("m.shape").alias("wrapper")))

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], dict[int, int]] = {}
        kinds: dict[str, tuple[set[int], set[int]]] = {}
        for frame in frames:
            rows = set()
            for name, source, wrapper in zip(frame["host"], frame["html"], frame["wrapper"], strict=True):
                page = Page(source)
                shape = page.shape()
                if (shape, wrapper) not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[shape, wrapper] = align(shape, wrapper)
                to, body = known[shape, wrapper], _hash(page.main_text())
                if wrapper not in kinds:
                    if len(kinds) > 10_000:
                        kinds.clear()
                    kinds[wrapper] = places(wrapper)
                inside, headings = kinds[wrapper]
                rows.update((name, to[n], to[n] in inside, _hash(t), body) for n, t in page.texts().items()
                            if n in to and to[n] not in headings)
            if rows:
                yield pd.DataFrame(sorted(rows), columns=["host", "node", "inside", "text", "body"])

    found = pages.join(hinted(common, max_hosts), "host").select("host", "html", "wrapper").mapInPandas(
        slots, "host string, node int, inside boolean, text bigint, body bigint")
    once = found.groupBy("host", "node", "inside", "text", "body").agg(F.count(F.lit(1)).alias("c"))
    by_text = once.groupBy("host", "node", "inside", "text").agg(F.count(F.lit(1)).alias("bodies"))
    by_node = by_text.groupBy("host", "node", "inside").agg(
        F.sum("bodies").alias("bodies"), F.count(F.lit(1)).alias("texts"))
    recurs = F.when(F.col("inside"), (F.col("bodies") >= 2 * min_pages) & (
        F.col("texts") <= F.greatest(F.lit(1.0), F.lit(variety / 15) * F.col("bodies")))).otherwise(
        (F.col("bodies") >= min_pages) & (F.col("texts") <= variety * F.col("bodies")))
    template = by_node.filter(recurs).groupBy(
        "host").agg(F.array_sort(F.collect_list("node")).alias("template"))
    return written(common.join(template, "host", "left").select(
        "host", "wrapper", F.coalesce("template", F.array().cast("array<int>")).alias("template")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            max_hosts: int = 200_000) -> DataFrame:
    """Id, url and main text of every row. Null html is empty; a row without a
    host is on the host of the empty name."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col), F.col(url_col), name.alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    small_batches(pages.sparkSession)
    found = wrappers(rows, max_hosts=max_hosts)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], dict[int, int]] = {}
        for frame in frames:
            texts = []
            for source, wrapper, template in zip(frame["html"], frame["wrapper"], frame["template"], strict=True):
                page, drop = Page(source), set(template)
                if drop:
                    shape = page.shape()
                    if (shape, wrapper) not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[shape, wrapper] = align(shape, wrapper)
                    drop = {n for n, w in known[shape, wrapper].items() if w in drop}
                texts.append(page.main_text(drop))
            yield pd.DataFrame({id_col: frame[id_col], url_col: frame[url_col], "text": texts})

    return rows.join(hinted(found, max_hosts), "host").select(
        id_col, url_col, "html", "wrapper", "template").mapInPandas(
        run, f"`{id_col}` {kind}, `{url_col}` string, text string")
