"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Every block element is a node, and so is each run of loose text between the
blocks within another; a node has features of its subtree (how much text, how
much of it in links and lists, how it is punctuated), of its attributes' words
and its ancestors', of its depth and of its place among its siblings.  Trees
trained with Spark ML give a node's probability to be main text.  Decoding
gives each node one of three states: all in, all out, or mixed, which asks its
children; a node that is in (or out) takes its whole subtree along, so that no
choice contradicts one above it, and the likeliest states are found bottom-up.

Labels come from the pages that mark their text with ``article`` or ``main``.
A copy of each is disguised for training: the marked element is renamed, and
menus, notices, adverts, sidebars, comments and the like, made of the page's
own text, are put around and into it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import stored

#: Labelled pages that a model is fitted on, at most: those whose ids have the smallest hashes.
SAMPLE_PAGES = 600
TREES, DEPTH, STEP = 20, 4, 0.3

# Fixed lists: elements of HTML, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph, and the other ones that are blocks; all elements beside these, also unknown ones, are inline.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "listing main menu nav ol p plaintext pre search section summary table ul xmp li dt dd".split())
BLOCKS = ENDS_P | frozenset("html body tr td th thead tbody tfoot caption legend".split())
#: Elements without main text of their own: never part of the result, and no end of a block.
DROPPED = frozenset("script style template head title iframe embed svg math canvas audio video map button select textarea input option optgroup datalist".split())
#: Elements that are dropped as well, unless they hold half of the page's text or more: then they stand around the page, not in it.
HOLDERS = frozenset("form noscript dialog object".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
#: Where the search for an element to close ends.
SCOPES = frozenset("html body article section main div table ul ol dl nav aside header footer form blockquote td th".split())
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager skip toc".split(),
    "frame": "header masthead topbar footer bottom copyright legal imprint colophon".split(),
    "side": "aside sidebar side rail widget widgets related recommended recommendations popular trending more teaser teasers".split(),
    "advert": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion reviews feedback".split(),
    "form": "form login search share sharing social follow buttons tools meta byline tags".split(),
    "text": "article content main post entry story body text prose page".split(),
}
GROUPS = {word: number for number, words in enumerate(WORDS.values()) for word in words}
KINDS = {tag: number for number, tags in enumerate((("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"), ("div", "section"), ("blockquote", "pre"), ("table", "tr", "td", "th"))) for tag in tags}


@dataclass(eq=False)
class Node:
    tag: str
    words: tuple[str, ...] = ()
    parent: Node | None = None
    children: list = field(default_factory=list)
    gold: bool = False


class _Builder(HTMLParser):
    """DOM of a page with the implied ends of paragraphs, list items and cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - CLOSES[tag])
        if tag in ENDS_P:
            self._close({"p"}, SCOPES)
        found = [w for name, value in attrs if name in ("class", "id", "role") and value for w in re.split(r"[^a-z]+", value.lower()) if w]
        node = Node(tag, tuple(found), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:  # HTML knows the slash for blocks as little as for any other
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, frozenset() if tag in SCOPES else SCOPES)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The page's tree; text that belongs to no element stays with the root."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _open_holders(builder.root)
    return builder.root


def _open_holders(root: Node) -> None:
    """Make holders of half of the page's text or more plain containers, and drop the others."""
    order, sizes = [root], {}
    for node in order:
        if node.tag not in DROPPED:
            order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        sizes[id(node)] = 0 if node.tag in DROPPED else sum(
            sizes[id(c)] if isinstance(c, Node) else len(c) - c.count(" ") - c.count("\n") for c in node.children)
    for node in order:
        if node.tag in HOLDERS:
            node.tag, node.words = ("div", ()) if 2 * sizes[id(node)] >= sizes[id(root)] > 0 else ("template", ())


def is_inline(tag: str) -> bool:
    return tag not in BLOCKS and tag not in DROPPED and tag[0] != "#"


def is_block(node) -> bool:
    return isinstance(node, Node) and not is_inline(node.tag) and node.tag not in DROPPED


def holds_blocks(node: Node) -> bool:
    """Whether a block stands in the node, directly or within inline elements."""
    stack = list(node.children)
    while stack:
        child = stack.pop()
        if is_block(child):
            return True
        if isinstance(child, Node) and is_inline(child.tag):
            stack.extend(child.children)
    return False


# --- features -----------------------------------------------------------------

@dataclass
class _Stats:
    """Sums over a node's subtree."""
    chars: int = 0
    links: int = 0
    stops: int = 0
    listed: int = 0
    dropped: int = 0
    blocks: int = 0
    leaves: int = 0
    longest: int = 0
    words: np.ndarray = field(default_factory=lambda: np.zeros(len(WORDS)))


#: Tag of the nodes that stand for runs of loose text.
LOOSE = "#text"
FEATURES = 14 + 7 + 1 + 3 * len(WORDS)


class Page:
    """Block nodes of a page in order, their features, and their children among them.

    Text beside blocks is a node of tag ``LOOSE`` for each run between them.
    ``keys`` tell the nodes apart in ``text_of``: a block by its element, a run
    by the element of its block and the number of blocks in it before the run.
    """

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node] = []
        self.keys: list[tuple[int, int]] = []
        self.parents: list[int] = []
        self.stats: list[_Stats] = []
        self.begins: list[int] = []
        self.depths: list[int] = []
        self.above: list[np.ndarray] = []
        self.chars = 0
        self._walk(root, -1, 0, np.zeros(len(WORDS)))

    def _own_words(self, node: Node) -> np.ndarray:
        own = np.zeros(len(WORDS))
        for word in (node.tag, *node.words):
            if word in GROUPS:
                own[GROUPS[word]] += 1
        return own

    def _walk(self, root: Node, parent: int, depth: int, above: np.ndarray) -> None:
        # (node, parent, depth, words above, inside a link, inside a list); a stack, as pages nest deeply.
        stack = [(root, parent, depth, above, False, False)]
        own: list[np.ndarray] = []
        seen: list[int] = []  # of each node, the blocks in it so far
        runs: dict[tuple[int, int], int] = {}
        mixed: dict[int, bool] = {}

        def add(node: Node, key: tuple[int, int], up: int, level: int, over: np.ndarray, mine: np.ndarray) -> int:
            self.nodes.append(node)
            self.keys.append(key)
            self.parents.append(up)
            self.stats.append(_Stats())
            self.begins.append(self.chars)
            self.depths.append(level)
            self.above.append(over)
            own.append(mine)
            seen.append(0)
            return len(self.nodes) - 1

        while stack:
            node, up, level, over, link, listed = stack.pop()
            if isinstance(node, str):
                if not node.strip():
                    pass
                elif (up, seen[up]) in runs:
                    up = runs[up, seen[up]]
                else:
                    block = self.nodes[up]
                    if up not in mixed:
                        mixed[up] = holds_blocks(block)
                    if mixed[up]:
                        run = (up, seen[up])
                        up = runs[run] = add(Node(LOOSE, parent=block, gold=block.gold), (id(block), seen[up]), up, level, over, np.zeros(len(WORDS)))
                size = len(node) - node.count(" ") - node.count("\n")
                s = self.stats[up]
                s.chars += size
                s.links += size if link else 0
                s.listed += size if listed else 0
                s.stops += node.count(".") + node.count(",") + node.count("!") + node.count("?")
                self.chars += size
                continue
            if node.tag in DROPPED:
                if up >= 0:
                    self.stats[up].dropped += 1
                continue
            at, words = up, over
            if not is_inline(node.tag):
                mine = self._own_words(node)
                if up >= 0:
                    seen[up] += 1
                at = add(node, (id(node), -1), up, level, over, mine)
                words, level = over + mine, level + 1
            link, listed = link or node.tag == "a", listed or node.tag == "li"
            stack.extend((c, at, level, words, link, listed) for c in reversed(node.children))
        self.own = own
        for i in range(len(self.nodes) - 1, 0, -1):
            s, t = self.stats[i], self.stats[self.parents[i]]
            s.leaves, s.longest = (s.leaves, s.longest) if s.blocks else (1, s.chars)
            for name in ("chars", "links", "stops", "listed", "dropped", "leaves"):
                setattr(t, name, getattr(t, name) + getattr(s, name))
            t.blocks += s.blocks + 1
            t.longest = max(t.longest, s.longest)
            t.words = t.words + s.words + own[i]

    def features(self) -> np.ndarray:
        """(nodes, features)."""
        n = len(self.nodes)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i, up in enumerate(self.parents):
            if up >= 0:
                kids[up].append(i)
        self.kids = kids
        # Place among the siblings, their number, and how many have the same tag: each parent's children are counted once.
        place, beside, alike = [0] * n, [1] * n, [1] * n
        for same in kids:
            tags = Counter(self.nodes[k].tag for k in same)
            for at, k in enumerate(same):
                place[k], beside[k], alike[k] = at, len(same), tags[self.nodes[k].tag]
        out = np.zeros((n, FEATURES))
        total = max(self.chars, 1)
        out[:, :14] = [(
            self.depths[i], s.chars, s.links / max(s.chars, 1), 100 * s.stops / max(s.chars, 1), s.blocks, len(kids[i]),
            place[i] / beside[i], beside[i], alike[i] / beside[i], self.begins[i] / total, s.chars / total,
            s.listed / max(s.chars, 1), s.dropped, s.longest) for i, s in enumerate(self.stats)]
        for i, node in enumerate(self.nodes):
            if node.tag in KINDS:
                out[i, 14 + KINDS[node.tag]] = 1
        out[:, 21] = [s.chars / max(s.leaves, 1) for s in self.stats]
        out[:, 22:] = np.concatenate([self.own, self.above, [s.words for s in self.stats]], 1)
        logs = [1, 4, 13, 21, *range(FEATURES - len(WORDS), FEATURES)]
        out[:, logs] = np.log1p(out[:, logs])
        return out


# --- model --------------------------------------------------------------------

@dataclass
class Model:
    """Boosted trees as arrays: (tree, node) of feature, threshold, left, right and value."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, trees, rows = np.zeros(len(x)), np.arange(len(self.feature))[:, None], np.arange(len(x))
        at = np.zeros((len(trees), len(x)), np.int64)  # all trees go down together
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[trees, at]
            at = np.where(f < 0, at, np.where(go_left, self.left[trees, at], self.right[trees, at]))
        for value in self.value[trees, at]:
            total += value
        return 2 * total


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def _arrays(model: GBTClassificationModel) -> Model:
    """The trees of a Spark ML model, from their printed form."""
    size = 2 ** (DEPTH + 1)
    shape = (len(model.trees), size)
    out = Model(np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape))
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        lines = [line.strip() for line in tree.toDebugString.splitlines()[1:] if line.strip()]
        used = 0

        def read(at: int) -> int:
            """Fills in the node whose text starts at this line; the line after it."""
            nonlocal used
            here, used = used, used + 1
            if lines[at].startswith("Predict:"):
                out.value[t, here] = weight * float(lines[at].split(":")[1])
                return at + 1
            split = _SPLIT.match(lines[at])
            out.feature[t, here], out.threshold[t, here] = int(split[1]), float(split[2])
            out.left[t, here] = used
            at = read(at + 1)  # then a line with Else
            out.right[t, here] = used
            return read(at + 1)

        read(0)
    return out


def no_model() -> Model:
    """Knows nothing: every node is as likely in as out."""
    return Model(np.full((0, 1), -1), np.zeros((0, 1)), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1)))


def _mark(root: Node) -> bool:
    """Marks the page's text as it says itself: the first article, else main, but for frames within it."""
    def first(tag: str) -> Node | None:
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                return node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in DROPPED)
        return None

    top = first("article") or first("main")
    stack = [top] if top is not None else []
    while stack:
        node = stack.pop()
        node.gold = True
        stack.extend(c for c in node.children if is_block(c) and c.tag not in ("nav", "aside", "footer"))
    return top is not None


def _disguise(root: Node, rng: np.random.Generator) -> None:
    """Renames the marked element and adds boilerplate of the page's own text, unmarked."""
    everything = [root]
    for node in everything:
        everything.extend(c for c in node.children if isinstance(c, Node))
    top = next(n for n in everything if n.gold)
    texts = [c for n in everything if n.tag == "p" for c in n.children if isinstance(c, str) and c.strip()] or ["text"]
    top.tag, top.words = [("article", ()), ("div", ("content",)), ("div", ("post", "body")), ("main", ()), ("section", ("story",)), ("div", ("entry", "content")), ("div", ())][rng.integers(7)]

    def text(most: int) -> str:
        t = texts[rng.integers(len(texts))]
        return t if most == 0 else " ".join(t.split()[:most])

    def made(tag: str, words: tuple, children: list) -> Node:
        node = Node(tag, words)
        node.children = children
        for c in children:
            if isinstance(c, Node):
                c.parent = node
        return node

    def links(n: int) -> Node:
        return made("ul", (), [made("li", (), [made("a", (), [text(3)])]) for _ in range(n)])

    def remark() -> Node:
        return made("div", ("comment",), [made("p", (), [text(0)])])

    def word(group: str) -> str:
        return WORDS[group][rng.integers(len(WORDS[group]))]

    box = lambda: ("div", "section", "aside")[rng.integers(3)]
    kinds = [
        lambda: made("header", (), [made("a", (), [text(4)]), links(3)]), lambda: made("div", (word("frame"),), [made("p", (), [text(8)])]),
        lambda: made("nav", (), [links(5)]), lambda: made("div", (word("menu"),), [links(4)]),
        lambda: made("aside", (), [made("h3", (), [text(3)]), made("p", (), [text(0)])]), lambda: made(box(), (word("side"),), [made("h3", (), [text(3)]), links(4)]),
        lambda: made(box(), (word("side"),), [made("p", (), [text(0)])]),
        lambda: made(box(), (word("advert"),), [made("p", (), [text(0)])]), lambda: made("div", (word("advert"),), [text(12)]),
        lambda: made("div", (word("notice"),), [made("p", (), [text(20)])]), lambda: made(box(), (word("notice"),), [text(0)]),
        lambda: made(box(), (word("comment"),), [made("h2", (), [text(2)])] + [remark() for _ in range(rng.integers(1, 6))]), lambda: made("ol", (word("comment"),), [made("li", (), [made("p", (), [text(0)])]) for _ in range(3)]),
        lambda: made("div", (word("form"),), [made("a", (), [text(1)]), made("a", (), [text(1)])]), lambda: made("footer", (), [made("p", (), [text(0)])]),
    ]
    parent = top.parent or root
    for k in rng.choice(len(kinds), rng.integers(3, 8), replace=False):
        node = kinds[k]()
        place = top if rng.random() < 0.35 else parent
        node.parent = place
        near = [i for i, c in enumerate(place.children) if is_block(c)] or [0]
        place.children.insert(near[rng.integers(len(near))] + int(rng.integers(2)), node)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, label) of the nodes of labelled pages and of their disguised copies."""
    for batch in batches:
        rows, labels = [], []
        for html in batch.column("html").to_pylist():
            for copy in (0, 1, 2):
                root = parse(html)
                if not _mark(root):
                    break
                if copy:
                    _disguise(root, np.random.default_rng([len(html), copy]))
                page = Page(root)
                x = page.features()
                inside = np.array([n.gold for n in page.nodes])
                partly = np.zeros(len(inside), bool)
                whole = inside.copy()
                for i in range(len(inside) - 1, 0, -1):
                    partly[page.parents[i]] |= inside[i] | partly[i]
                    whole[page.parents[i]] &= whole[i]
                sure = whole | ~partly & ~inside  # a node of both kinds is no example
                rows.extend(x[sure])
                labels.extend(whole[sure].astype(float))
        yield pa.RecordBatch.from_pydict({"features": pa.array(rows, pa.list_(pa.float64())), "label": pa.array(labels, pa.float64())})


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """Boosted trees from at most ``sample`` of the pages that mark their text."""
    marked = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).filter(F.lower("html").rlike("<(article|main)[ >]"))
    # Only ids are ranked; the chosen ones, at most ``sample``, then fetch their pages.
    chosen = stored(marked.select("id", F.xxhash64("html").alias("print")).orderBy(F.xxhash64("id"), "print").limit(sample), "html-sample")
    texts = marked.withColumn("print", F.xxhash64("html")).join(F.broadcast(chosen.distinct()), ["id", "print"]).dropDuplicates(["id", "print"]).select("html")
    examples = stored(texts.repartition(8).mapInArrow(_examples, "features array<double>, label double"), "html-examples")
    if examples.select("label").distinct().count() < 2:
        return no_model()
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=3, cacheNodeIds=False)
    return _arrays(boosted.fit(examples.select(array_to_vector("features").alias("features"), "label")))


# --- extraction ---------------------------------------------------------------

def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Whether each node's own text is in: the likeliest states of the tree."""
    n = len(page.nodes)
    log_in, log_out = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    all_in, all_out = log_in.copy(), log_out.copy()
    for i in range(n - 1, 0, -1):
        all_in[page.parents[i]] += all_in[i]
        all_out[page.parents[i]] += all_out[i]
    best = np.zeros(n)
    mixed = np.full(n, np.log(0.5))
    for i in range(n - 1, -1, -1):
        if not page.kids[i]:
            mixed[i] = -np.inf
        best[i] = max(all_in[i], all_out[i], mixed[i])
        if i:
            mixed[page.parents[i]] += best[i]
    inside, decided = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        up = page.parents[i]
        if up >= 0 and decided[up]:
            inside[i], decided[i] = inside[up], True
        elif best[i] > mixed[i]:
            inside[i], decided[i] = all_in[i] >= all_out[i], True
    return inside


def text_of(root: Node, inside: dict[tuple[int, int], bool]) -> str:
    """Blocks of the nodes that are in, by ``Page.keys``, in page order: white space as one space, two line feeds between blocks."""
    blocks: list[list[str]] = [[]]
    seen: dict[int, int] = {}
    stack: list = [(root, 0)]
    while stack:
        node, up = stack.pop()  # up: the id of the block that the node is in
        if node is None:
            blocks.append([])
        elif isinstance(node, str):
            kept = inside.get((up, seen[up]))
            if inside.get((up, -1), False) if kept is None else kept:
                blocks[-1].append(node)
        elif node.tag == "br":
            blocks[-1].append(" ")
        elif node.tag not in DROPPED:
            if not is_inline(node.tag):
                if up:
                    seen[up] += 1
                up = id(node)
                seen[up] = 0
                if node.tag not in ("td", "th"):
                    blocks.append([])
                    stack.append((None, 0))
                else:
                    blocks[-1].append(" ")
            stack.extend((c, up) for c in reversed(node.children))
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def extract(html: str, model: Model) -> str:
    """The page's main text."""
    root = parse(html)
    page = Page(root)
    inside = decode(page, model.log_odds(page.features()))
    return text_of(root, {key: bool(k) for key, k in zip(page.keys, inside)})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row from its whole html.

    Null and empty pages and those without main text have an empty text;
    repeated rows are extracted each, other columns are ignored, and an empty
    table gives an empty table.  A block is an element that HTML lays out as
    one; a table's row is a block, whose cells are joined by a space.  Forms and
    the like are left out, but for those that stand around the page.  Without a page that marks its text there is
    no model, and all text but forms, scripts and styles is taken.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kept = pages.sparkSession.sparkContext.broadcast(fit(pages, id_col, html_col))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract(h.as_py(), kept.value) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
