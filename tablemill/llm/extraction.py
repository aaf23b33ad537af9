"""Main text of web pages: boosted trees over DOM-node features, decoded so that no kept node is below a dropped one."""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages learned from, the first in a seeded order.
EXAMPLES = 400

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements inside which any element may end in "/>".
FOREIGN = frozenset("svg math".split())
#: Elements whose text is not part of the page as shown: inert parts, choices of a control, notes to drawings and formulas.
UNSEEN = frozenset("template select desc metadata annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements and attribute words that speak against or for main text.
AGAINST_TAGS = frozenset("nav footer aside form header menu button fieldset dialog head search".split())
FOR_TAGS = frozenset("article main".split())
AGAINST = frozenset(
    "nav navbar navigation menu footer header masthead sidebar aside rail ad ads advert adverts advertisement adsbygoogle banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login form search share "
    "sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments commentlist discussion reply replies respond disqus "
    "widget toolbar copyright legal disclaimer skip tags complementary contentinfo".split()
)
FOR = frozenset("article content main post entry story body text articlebody maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PLAIN = re.compile("[a-z]+")


class Node:
    """An element; ``items`` holds child nodes and pieces of text (line number, text, inside a link)."""

    __slots__ = ("tag", "words", "parent", "items", "label")

    def __init__(self, tag: str, words: frozenset, parent: "Node | None"):
        self.tag, self.words, self.parent, self.items, self.label = tag, words, parent, [], None
        if parent is not None:
            parent.items.append(self)


def parse(page: str) -> Node:
    """Tree of a page. Ends that are missing are implied, unknown or inline elements add no node unless named."""
    root = node = Node("html", frozenset(), None)
    open_tags: list[tuple[str, Node]] = []  # names of open elements with the node in which they began
    places: dict[str, list[int]] = defaultdict(list)  # where in ``open_tags`` each name and each block is
    blocks: list[int] = []
    at, line, links, unseen = 0, 0, 0, 0

    def nearest(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    def text(piece: str) -> None:
        if unseen:
            return
        if piece and not piece.isspace():
            node.items.append((line, entities.unescape(piece) if "&" in piece else piece, links > 0))
        elif piece:
            node.items.append((line, " ", links > 0))

    def close(k: int) -> None:
        nonlocal node, links, line, unseen
        for name, before in reversed(open_tags[k:]):
            places[name].pop()
            if name in BLOCKS:
                blocks.pop()
            links -= name == "a"
            unseen -= name in UNSEEN
            line += name in BLOCKS and not unseen
            node = before
        del open_tags[k:]

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = nearest((name,))
            if k >= 0 and (name in BLOCKS or k >= nearest(("table", "body"))):
                close(k)
            continue
        attributes = m[3] if m[2] else m[6]
        empty = bool(attributes) and attributes.rstrip().endswith("/")
        if name in RAW:
            if empty and nearest(FOREIGN) >= 0:
                continue
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name in ("hr",):
                line += not unseen
            elif name in ("br", "img"):
                node.items.append((line, " ", links > 0))
            continue
        if name in BLOCKS:
            line += not unseen
            shut, until = CLOSES.get(name, (set(), set()))
            shuts = shut | {"p"}
            while (k := nearest(shuts)) >= 0 and k > nearest((until | {"template"}) - shuts) and (shut or k == blocks[-1]):
                close(k)
        words = frozenset(PLAIN.findall(" ".join(ATTRIBUTE.findall(attributes)).lower())) if "=" in (attributes or "") else frozenset()
        before = node
        if name == "html":
            continue
        if name in BLOCKS or words and name not in ("a", "html"):
            node = Node(name, words, node)
        if not empty or name in BLOCKS:
            places[name].append(len(open_tags))
            if name in BLOCKS:
                blocks.append(len(open_tags))
            open_tags.append((name, before))
            links += name == "a"
            unseen += name in UNSEEN
        else:
            node = before
    text(page[at:])
    return root


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.items) if isinstance(c, Node))
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl table".split())


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node, parents before children: its own words, those above, subtree density, depth, siblings."""
    place = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    parent = [place[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    chars, linked, lines, commas, tags = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    for i, x in enumerate(nodes):
        seen = set()
        for c in x.items:
            if c.__class__ is tuple:
                size = len(c[1])
                chars[i] += size
                if c[2]:
                    linked[i] += size
                commas[i] += c[1].count(",") + c[1].count(".")
                seen.add(c[0])
        lines[i] = len(seen)
    own = list(chars)
    good = [x.tag in FOR_TAGS for x in nodes]
    good_below = list(good)
    kids = [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        lines[p] += lines[i]
        commas[p] += commas[i]
        tags[p] += tags[i]
        good_below[p] |= good_below[i]
        kids[p] += 1
    against = [len(x.words & AGAINST) if x.words else 0 for x in nodes]
    favour = [len(x.words & FOR) if x.words else 0 for x in nodes]
    bad_tag = [x.tag in AGAINST_TAGS for x in nodes]
    depth, above_words, above_tag, above_for, number, seen_kids, previous, following = ([0] * n for _ in range(8))
    last_kid = [-1] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above_words[i] = max(above_words[p], against[p])
        above_tag[i] = above_tag[p] or bad_tag[p]
        above_for[i] = above_for[p] or good[p] or favour[p] > 0
        number[i] = seen_kids[p]
        seen_kids[p] += 1
        before = last_kid[p]
        if before >= 0:
            previous[i] = chars[before]
            following[before] = chars[i]
        last_kid[p] = i
    heading = [x.tag in HEADINGS for x in nodes]
    listed = [x.tag in LISTS for x in nodes]
    raw = np.array([
        against, above_words, favour, above_for, bad_tag, above_tag, good, good_below, chars, own, linked, tags, lines, depth, number, heading,
        listed, previous, following, commas, parent, kids,
    ], float)
    of = raw[20].astype(int)
    size, total = np.maximum(raw[8], 1), max(raw[8, 0], 1.0)
    siblings = np.where(of >= 0, raw[21][of], 1)
    up = np.where(of >= 0, raw[8][of], total)
    start = np.cumsum(raw[9]) - raw[9]
    return np.concatenate([
        raw[:8], np.log1p(raw[8:10]),
        [raw[10] / size, raw[8] / raw[11], raw[8] / np.maximum(raw[12], 1), raw[13], raw[14] / siblings, siblings, start / total, raw[8] / total, raw[8] / np.maximum(up, 1)],
        raw[15:17], np.log1p(raw[17:19]), [raw[19] / size],
    ]).T


def mark(nodes: list[Node]) -> bool:
    """Label the nodes by what the page's own elements say; False for a page that has no main element.

    1: holds or is inside the main element and no element or word against it lies between; 0: the others.
    """
    if not any(n.tag in FOR_TAGS for n in nodes):
        return False
    for n in nodes:
        above = n.parent.label if n.parent is not None else "out"
        bad = n.tag in AGAINST_TAGS or bool(n.words & AGAINST and not n.words & FOR)
        n.label = "bad" if above == "bad" or bad else "in" if above == "in" or n.tag in FOR_TAGS else "out"
    inside = {id(n) for n in nodes if n.label == "in"}
    for n in reversed(nodes):
        if id(n) in inside and n.parent is not None:
            inside.add(id(n.parent))
    for n in nodes:
        n.label = int(id(n) in inside and n.label != "bad")
    return True


#: Containers that pages of other make have, as (element, attribute words, links inside).
EXTRAS = [
    ("div", "comments", False), ("section", "comment list", False), ("ol", "commentlist", False), ("div", "sidebar", True), ("aside", "", False),
    ("div", "cookie notice", False), ("div", "newsletter signup", False), ("form", "", False), ("div", "related posts", True),
    ("div", "share social", True), ("div", "advert", False), ("div", "promo banner", False), ("header", "", True), ("div", "breadcrumb", True),
    ("ul", "menu", True), ("div", "alert notice", False), ("footer", "", False), ("div", "widget", False), ("div", "sponsored", False),
]


def vary(root: Node, rng: random.Random) -> list[Node]:
    """A variant of a labelled page: other element names and words for the same parts, and further parts around and inside."""
    nodes = preorder(root)
    bodies = [n for n in nodes if n.label == 1 and any(isinstance(c, Node) for c in n.items)]
    pool = [c[1] for n in nodes for c in n.items if not isinstance(c, Node) and len(c[1]) > 20] or ["text"]
    for n in nodes:
        if n.tag in FOR_TAGS and rng.random() < 0.6:
            n.tag, n.words = "div", frozenset(rng.choice(["content", "post entry", "story", "main", "article body", "", "", "x"]).split())
        elif n.label == 0 and n.tag in AGAINST_TAGS and rng.random() < 0.6:
            word = {"nav": "menu navigation", "header": "header masthead", "aside": "sidebar", "form": "form signup", "footer": "footer"}.get(n.tag, "widget")
            n.tag, n.words = "div", frozenset(rng.choice([word, word, word, ""]).split())
    for _ in range(rng.randint(1, 5)):
        tag, words, links = rng.choice(EXTRAS)
        where = rng.choice(bodies) if bodies else root
        extra = Node(tag, frozenset(words.split()), None)
        extra.parent, extra.label = where, 0
        for k in range(rng.randint(1, 6)):
            child = Node(rng.choice(["p", "li", "div"]), frozenset(rng.choice(["", "", "comment", "item"]).split()), extra)
            child.label = 0
            child.items.append((-1 - k, rng.choice(pool)[: rng.choice([20, 60, 200, 2000])], links))
        where.items.insert(rng.choice([0, len(where.items)]), extra)
    return preorder(root)


def examples(pages: Iterator[pd.DataFrame], variants: int = 3) -> Iterator[pd.DataFrame]:
    """Feature rows and labels of the nodes that hold text, for each page and its variants."""
    for pdf in pages:
        for page in pdf["html"]:
            rng = random.Random(zlib.crc32(page.encode("utf-8", "surrogatepass")))
            for k in range(variants + 1):
                root = parse(page)
                nodes = preorder(root)
                if not mark(nodes):
                    break
                if k:
                    nodes = vary(root, rng)
                x = features(nodes)
                keep = np.expm1(x[:, 8]) > 0
                yield pd.DataFrame({"x": [r.tolist() for r in x[keep]], "label": np.array([n.label for n in nodes], float)[keep]})


class Trees:
    """A fitted ensemble as nested splits, evaluated on blocks of rows."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights = trees, weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for tree, weight in zip(self.trees, self.weights):
            stack = [(tree, np.arange(len(x)))]
            while stack:
                t, rows = stack.pop()
                if not isinstance(t, tuple):
                    margin[rows] += weight * t
                elif len(rows):
                    left = x[rows, t[0]] <= t[1]
                    stack += [(t[2], rows[left]), (t[3], rows[~left])]
        return 1 / (1 + np.exp(-2 * margin))


def exported(model: GBTClassificationModel) -> Trees:
    """The splits of a fitted model, read from its own description."""
    def read(lines: list[str]):
        line = lines.pop(0).strip()
        if line.startswith("Predict"):
            return float(line.partition(":")[2])
        m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
        left = read(lines)
        lines.pop(0)
        return int(m[1]), float(m[2]), left, read(lines)

    return Trees([read(t.toDebugString.strip().split("\n")[1:]) for t in model.trees], list(model.treeWeights))


def train(pages: DataFrame, page: str = "html", order: str = "page_id", limit: int = EXAMPLES, seed: int = 17) -> Trees | None:
    """Fit boosted trees on the nodes of at most ``limit`` pages that have a main element, the first by a seeded hash of ``order``.

    Labels come from the elements of those pages themselves; variants of each page rename and add parts, so
    that what is learned is not one site's markup. None when no page has a main element.
    """
    spark = pages.sparkSession
    rows = pages.filter(F.col(page).isNotNull() & F.col(page).rlike(r"(?i)<(article|main)[\s>]")).select(F.col(order).alias("k"), F.xxhash64(F.lit(seed), F.col(order), F.octet_length(page)).alias("h"), F.col(page).alias("html"))
    top = rows.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if top is None:
        return None
    table = rows.filter(F.col("h") <= top).dropDuplicates(["h"]).select("html").repartition(4)
    nodes = table.mapInPandas(examples, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    from tablemill.llm.common import Scratch

    nodes = Scratch(spark).settle(nodes, "nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    return exported(GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, maxBins=32).fit(nodes))


def decode(nodes: list[Node], p: np.ndarray, own: np.ndarray) -> list[bool]:
    """Which nodes stay open: the likeliest choice in which a dropped node drops all below it.

    Nodes weigh by the logarithm of their own text, so that empty wrappers follow what they hold.
    """
    p = np.clip(p, 1e-6, 1 - 1e-6)
    weight = np.log1p(own) + 0.1
    place = {id(n): i for i, n in enumerate(nodes)}
    keep, drop = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    open_ = [False] * len(nodes)
    for i, n in enumerate(nodes):
        open_[i] = (n.parent is None or open_[place[id(n.parent)]]) and keep[i] > drop[i]
    return open_


def kept_text(nodes: list[Node], open_: list[bool]) -> str:
    """Text of the open nodes: white space to one space, a line for each block, in page order."""
    lines: list[tuple[object, list[str]]] = []
    place = {id(n): i for i, n in enumerate(nodes)}
    stack: list = [nodes[0]] if nodes else []
    while stack:
        item = stack.pop()
        if isinstance(item, Node):
            if open_[place[id(item)]]:
                stack.extend(reversed(item.items))
        elif lines and lines[-1][0] == item[0]:
            lines[-1][1].append(item[1])
        else:
            lines.append((item[0], [item[1]]))
    joined = (" ".join("".join(parts).split()) for _, parts in lines)
    return "\n".join(t for t in joined if t)


def main_text(spark: SparkSession, page: str | Column, trees: Trees | None) -> Column:
    """Main text of a page; empty for null and empty pages and where nothing is kept.

    Without trees (no page to learn from) a node is judged by its elements and words alone, in the same
    hierarchical way. Pages are parsed whole, a group of pages at a time.
    """
    held = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        for pages in batches:
            out: list[str] = []
            values = [p or "" for p in pages]
            at = 0
            while at < len(values):
                group, size = [], 0
                while at < len(values) and (not group or size < 2 << 20):
                    group.append(preorder(parse(values[at])))
                    size += len(values[at])
                    at += 1
                tables = [features(nodes) for nodes in group]
                x = np.concatenate(tables)
                p = model.probability(x) if model is not None else np.where(x[:, 0] + x[:, 1] + x[:, 4] + x[:, 5] > 0, 0.02, 0.9)
                begin = 0
                for nodes, table in zip(group, tables):
                    share = p[begin : begin + len(nodes)]
                    begin += len(nodes)
                    out.append(kept_text(nodes, decode(nodes, share, np.expm1(table[:, 9]))))
            yield pd.Series(out)

    return extract.asNondeterministic()(page)
