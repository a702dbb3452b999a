"""Main text of web pages by a minimum cut over their blocks of text.

A page is read into blocks, the text between tags that break lines. Each block has
log odds of being content, a sum of two bounded parts. The first is a logistic
classifier over the block's own text and tag: its length, links, punctuation and the
like. It is fitted on a bounded sample of the table's own pages, whose blocks inside
articles are taken as content and whose blocks inside navigation, footers, asides and
the like as boilerplate; where a sample has not both, fixed weights stand in. The second
is evidence of the elements around the block: the nearest one that tells, as an article
or a footer, and weak hints of names on the way.

Positive odds are the capacity of the block's edge from the source, negative ones that
of its edge to the sink. Neighbouring blocks, and blocks that follow each other under one
parent, are joined by smoothness edges, the stronger the nearer they stand in the
document's tree; together they outweigh odds of weak evidence. The minimum cut, found by
maximum flow, separates content from boilerplate at the least total cost.

Names of classes and ids count as a whole: site-footer tells of a footer, has-sidebar
and menu-open of a state, category-social of a subject; a name of which only a part is
against, as search-engines, is a hint. Ids of headings and paragraphs are anchors and tell
nothing. A form tells only if its controls are many for its text. An article inside an
element that is against counts only where the page has none outside such. What stands outside
the articles of a page is against if they hold most of the text that nothing is against.

Text of scripts, styles, comments, controls and the head is no block at all and breaks
none. Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by two line breaks. Null or empty html has
empty text. Pages of any length are read whole; repeated rows give repeated results; an
empty table gives none. Columns ``text`` and ``n_chars``, in any case, are replaced; all
others are kept.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.byte_bpe import pieces, with_columns_from
from remitlens.llm.common import importable

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements whose text is not shown as text of the page; they break no block either.
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas audio video annotation annotation-xml button select textarea option datalist".split())
CONTROLS = frozenset("input button select textarea".split())
#: An open one of these ends where another of its group starts.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article section main body div ul ol dl table td th aside nav footer header form blockquote html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose ids are anchors.
ANCHORED = HEADINGS | frozenset("p li dt dd a span blockquote pre td th figure img".split())

#: Evidence, as log odds: of elements that tell, of hints, of blocks outside a page's article, of those of a page without one.
ARTICLE, MAIN, AGAINST_ODDS, PARTLY_ODDS, FOR_ODDS, OUTSIDE, UNMARKED = 2.5, 1.5, -4.0, -1.0, 1.0, -3.0, 0.3
#: Bound of the classifier's log odds, either way.
TEXT_ODDS = 2.5
TELLING = frozenset("nav footer aside header dialog menu fieldset".split())
#: Characters of text for each control up to which a form tells.
FORM_CHARS = 200
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar "
    "complementary contentinfo alert alertdialog dialog widget".split()
)
FOR = frozenset("article articlebody body content entry main post story text".split())
#: Parts of a name that leave its meaning to the others, as in site-footer.
NEUTRAL = frozenset(
    "area article bar block blog body bottom box btn button buttons container content entry fixed global group holder icon icons inner item items left link links list main "
    "mobile outer overlay page panel post posts primary right row secondary section site sticky story sub text thread title top widgets wrap wrapper".split()
)
#: Names with one of these anywhere, or that start with one of the latter, tell of other elements, of states or of the page's subject.
STATES = frozenset("has have no not non with without open opened closed active inactive visible shown expanded collapsed enabled disabled loaded".split())
SUBJECTS = frozenset("cat category format is tag tagged term topic type".split())
#: What an article of its own may be that is not the page's.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo promoted recommended related replies reply sponsored".split())
#: Smoothness: of blocks with one parent, one grandparent, others; across the border of an element that tells; of later siblings.
NEAR, FAR, APART, ACROSS, SIBLING = 1.6, 1.0, 0.3, 0.05, 0.6

#: Blocks of which a fit takes all that they teach; it takes less of fewer.
ENOUGH_BLOCKS = 200
#: The sample that the classifier is fitted on: pages, blocks of a page; ridge penalty and steps of the fit.
SAMPLE_PAGES, SAMPLE_BLOCKS, RIDGE, STEPS = 512, 256, 60.0, 25
FEATURES = ("one", "length", "linked", "ends", "sentences", "commas", "digits", "upper", "symbols", "word_length", "paragraph", "heading", "item", "cell", "quote", "rights")
#: Weights where there is nothing to learn from, and where learning starts.
FALLBACK = np.array([-1.6, 1.4, -4.0, 0.5, 0.5, 10.0, -1.0, -1.0, -4.0, 0.0, 1.2, 1.6, -0.4, -0.2, 1.0, -4.0])

_WORD_PARTS, _RIGHTS = re.compile(r"[^a-z]+"), re.compile(r"©|copyright\b|all rights reserved", re.I)


def features(text: str, linked: int, tag: str) -> list[float]:
    """What the classifier sees of a block."""
    n = len(text)
    size = max(n, 1)
    spaces = text.count(" ")
    return [
        1.0,
        math.log1p(n) / 4,
        linked / size,
        float(text.endswith((".", "!", "?", ":", "”", '"', "…"))),
        math.log1p(text.count(". ") + text.count("! ") + text.count("? ")),
        text.count(",") / size,
        sum(map(text.count, "0123456789")) / size,
        sum(map(str.isupper, text[:2000])) / min(size, 2000),
        sum(map(text.count, "|/>•·»©_=")) / size,
        min(n / (spaces + 1), 20) / 10,
        float(tag == "p"),
        float(tag in HEADINGS),
        float(tag in ("li", "dt", "dd")),
        float(tag in ("td", "th")),
        float(tag in ("blockquote", "pre", "figcaption")),
        float(_RIGHTS.match(text) is not None),
    ]


class Block:
    __slots__ = ("text", "linked", "node", "parent", "above")

    def __init__(self, text, linked, node):
        while node.tag in INLINE and node.above is not None:
            node = node.above
        self.text, self.linked, self.node = text, linked, node
        self.parent, self.above = node.serial, node.above.serial if node.above else -1


def named_against(names: list[list[str]], whole: frozenset[str] = AGAINST) -> float:
    """Log odds that names, given in parts, add: whole names against weigh most."""
    odds = 0.0
    for parts in names:
        if whole.isdisjoint(parts) or not STATES.isdisjoint(parts) or (len(parts) > 1 and parts[0] in SUBJECTS):
            continue
        odds = min(odds, AGAINST_ODDS if all(p in AGAINST or p in NEUTRAL for p in parts) else PARTLY_ODDS)
    return odds


class Node:
    """An element; ``tells`` is what it alone tells of what is inside, ``hint`` what its name adds."""

    __slots__ = ("tag", "above", "serial", "tells", "hint", "hidden", "chars", "controls", "wrapped")

    def __init__(self, tag, attrs, above, serial):
        self.tag, self.above, self.serial, self.chars, self.controls = tag, above, serial, 0, 0
        keys = ("class", "role", "itemprop") if tag in ANCHORED else ("class", "id", "role", "itemprop")
        values = [t for k, v in attrs if k in keys and v for t in v.split()]
        names = [[w for w in _WORD_PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t).lower()) if w] for t in values]
        self.tells, self.hint = 0.0, 0.0
        if tag in ("article", "main"):
            self.tells = AGAINST_ODDS if named_against(names, OTHER_ARTICLES) <= AGAINST_ODDS else ARTICLE if tag == "article" else MAIN
        elif tag in TELLING and not (tag == "header" and self.inside("article", "main")):
            self.tells = AGAINST_ODDS
        elif tag not in ("html", "body", "form"):
            named = named_against(names)
            if named <= AGAINST_ODDS:
                self.tells = AGAINST_ODDS
            else:
                self.hint = named + (FOR_ODDS if any(not FOR.isdisjoint(parts) for parts in names) else 0.0)
        self.hidden = tag in HIDDEN or (above.hidden if above else False) or any(k == "hidden" for k, _ in attrs)

    def inside(self, *tags: str) -> bool:
        node = self.above
        while node is not None and node.tag not in tags and node.tells >= 0:
            node = node.above
        return node is not None and node.tag in tags

    def against(self) -> bool:
        """Whether the element tells against what is inside; a form does once its text and controls are counted."""
        return self.tells < 0 or (self.tag == "form" and 0 < self.controls and self.chars < FORM_CHARS * self.controls)


class Reader(HTMLParser):
    """Reads html into blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.serial = 0
        self.top = Node("", [], None, 0)
        self.pieces: list[str] = []
        self.linked = 0
        self.links = 0
        self.articles: list[Node] = []

    def _break(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, min(self.linked, len(text)), self.top))
                node = self.top
                while node is not None:
                    if node.tag == "form":
                        node.chars += len(text)
                    node = node.above
            self.pieces, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in CONTROLS and not any(k == "type" and v == "hidden" for k, v in attrs):
            node = self.top
            while node is not None:
                node.controls += node.tag == "form"
                node = node.above
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag not in INLINE and tag not in HIDDEN:
            self._break()
        if tag in VOID:
            return
        ends = ("p",) if tag not in INLINE and tag not in HIDDEN and tag not in CLOSES else CLOSES.get(tag, ())
        if tag in CLOSES and tag != "p":
            ends = (*ends, "p")
        if ends:
            node = self.top
            while node.tag and node.tag not in ends and (node.tag not in SCOPE or node.tag in ends):
                node = node.above
            if node.tag in ends:
                self.top = node.above
        self.serial += 1
        self.top = Node(tag, attrs, self.top, self.serial)
        self.links += tag == "a"
        if self.top.tells > 0:
            self.articles.append(self.top)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.top
        while node.tag and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.above
        if not node.tag:
            return
        if tag not in INLINE and tag not in HIDDEN:
            self._break()
        while True:
            gone, self.top = self.top, self.top.above
            self.links -= gone.tag == "a"
            if gone is node:
                break

    def handle_data(self, data):
        if not self.top.hidden:
            self.pieces.append(data)
            if self.links > 0:
                self.linked += len(" ".join(data.split()))

    def finish(self) -> list[Block]:
        self.close()
        self._break()
        return self.blocks


class Page:
    """The blocks of a page with what the elements around them tell."""

    def __init__(self, html: str | None):
        reader = Reader()
        reader.feed(html or "")
        self.blocks = reader.finish()
        self.known: dict[int, tuple[float, int]] = {}
        clear = [a for a in reader.articles if not self._wrapped(a)]
        self.has_clear, self.marked = bool(clear), bool(reader.articles)
        self.evidence, self.landmark = [], []
        for b in self.blocks:
            told, mark = self._told(b.node)
            self.evidence.append(told)
            self.landmark.append(mark)
        inside = sum(len(b.text) for b, e, mark in zip(self.blocks, self.evidence, self.landmark, strict=True) if mark and e > 0)
        if self.has_clear and inside >= sum(len(b.text) for b, mark in zip(self.blocks, self.landmark, strict=True) if not mark):
            self.evidence = [e if mark else e + OUTSIDE for e, mark in zip(self.evidence, self.landmark, strict=True)]

    @staticmethod
    def _wrapped(node: Node) -> bool:
        node = node.above
        while node is not None:
            if node.against():
                return True
            node = node.above
        return False

    def _told(self, node: Node) -> tuple[float, int]:
        """Evidence of the elements around a block, and the number of the one that tells, 0 if there is none."""
        if node.serial not in self.known:
            if node.against():
                found = (AGAINST_ODDS, node.serial)
            elif node.tells > 0:
                found = (AGAINST_ODDS if self.has_clear and self._wrapped(node) else node.tells, node.serial)
            elif node.above is None:
                found = (0.0 if self.marked else UNMARKED, 0)
            else:
                told, mark = self._told_of(node.above)
                found = (told, mark)
            self.known[node.serial] = found
        told, mark = self.known[node.serial]
        return told + self._hints(node, mark), mark

    def _told_of(self, node: Node) -> tuple[float, int]:
        """As ``_told``, without hints, for deep trees: walks up to what is known."""
        path = []
        while node.serial not in self.known and not node.against() and node.tells <= 0 and node.above is not None:
            path.append(node)
            node = node.above
        if node.serial not in self.known:
            self._told(node)
        for n in path:
            self.known[n.serial] = self.known[node.serial]
        return self.known[node.serial]

    @staticmethod
    def _hints(node: Node, mark: int) -> float:
        """What names say between the block and the element that tells; each way they count once."""
        low = high = 0.0
        while node is not None and node.serial != mark:
            low, high = min(low, node.hint), max(high, node.hint)
            node = node.above
        return low + high


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """Edges between neighbouring blocks and between blocks that follow each other under one parent."""
    edges, last, blocks, mark = [], {}, page.blocks, page.landmark
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            if mark[i - 1] != mark[i]:
                weight = ACROSS
            elif a.parent == b.parent or a.above == b.above:
                weight = NEAR
            else:
                weight = FAR if a.parent == b.above or a.above == b.parent else APART
            edges.append((i - 1, i, weight))
        before = last.get(b.above)
        if before is not None and before < i - 1 and mark[before] == mark[i]:
            edges.append((before, i, SIBLING))
        last[b.above] = i
    return edges


def content_side(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the minimum cut leaves with the source.

    A node whose own capacity is at least what its undecided neighbours could pull
    is decided at once, which changes no minimum cut's value, and pulls its neighbours
    from then on by its capacity to them; the rest is solved by maximum flow.
    """
    n = len(odds)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull, open_weight = list(odds), [sum(w for _, w in x) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(pull[i]) >= open_weight[i]:
            side[i] = pull[i] > 0
            for j, w in near[i]:
                if side[j] is None:
                    pull[j] += w if side[i] else -w
                    open_weight[j] -= w
                    queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        inner = [(at[a], at[b], w) for a, b, w in edges if a in at and b in at]
        for i, s in zip(left, max_flow_side([pull[i] for i in left], inner), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def max_flow_side(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's maximum flow; nodes that the source still reaches in the residual graph."""
    n = len(odds)
    source, sink = n, n + 1
    to, room, start = [], [], [[] for _ in range(n + 2)]

    def edge(a, b, forth, back):
        start[a].append(len(to))
        to.append(b)
        room.append(forth)
        start[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, o in enumerate(odds):
        edge(source, i, o, 0.0) if o > 0 else edge(i, sink, -o, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level, queue = [-1] * (n + 2), deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for e in start[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(start[a]):
                e = start[a][turn[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(start[a]):
                path.append(start[a][turn[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def text_odds(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """The classifier's log odds of each block, bounded."""
    if not blocks:
        return []
    x = np.array([features(b.text, b.linked, b.node.tag) for b in blocks])
    return np.clip(x @ weights, -TEXT_ODDS, TEXT_ODDS).tolist()


def odds_of(page: Page, weights: np.ndarray) -> list[float]:
    """Log odds that each block is content: of its text, and of the elements around it.

    The only block of a page that nothing tells against is its text, however short.
    """
    if len(page.blocks) == 1 and page.evidence[0] >= 0:
        return [TEXT_ODDS]
    return [a + b for a, b in zip(text_odds(page.blocks, weights), page.evidence, strict=True)]


def main_text(html: str | None, weights: np.ndarray = FALLBACK) -> str:
    """The page's main text."""
    page = Page(html)
    side = content_side(odds_of(page, weights), smoothness(page))
    return "\n\n".join(b.text for b, s in zip(page.blocks, side, strict=True) if s)


def labelled(html: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most SAMPLE_BLOCKS of a page's blocks that elements around them tell of, and whether they are content."""
    page = Page(html)
    told = [(b, e > 0) for b, e, mark in zip(page.blocks, page.evidence, page.landmark, strict=True) if mark and abs(e) >= MAIN]
    told = told[:: -(-len(told) // SAMPLE_BLOCKS) or 1]
    return np.array([features(b.text, b.linked, b.node.tag) for b, _ in told], np.float32).reshape(-1, len(FEATURES)), np.array([y for _, y in told], np.int8)


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier, both kinds of blocks weighing alike, by Newton's method.

    A ridge draws them to the fixed weights, which little to learn from leaves as they are.
    """
    if not len(y) or y.min() == y.max():
        return FALLBACK
    x, y = x.astype(float), y.astype(float)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread = 0, np.where(spread < 1e-6, 1, spread)
    z = (x - mean) / spread
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * 1000 * min(1.0, len(y) / ENOUGH_BLOCKS)
    start = FALLBACK * spread
    start[0] += mean @ FALLBACK
    w = start.copy()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (share * (y - p)) - RIDGE * (w - start)
        w += np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), slope)
    w = w / spread
    w[0] -= mean @ w
    return w


def fit(df: DataFrame, html: str = "html") -> np.ndarray:
    """The classifier's weights from a sample of SAMPLE_PAGES pages, those with the least hash of their row."""
    importable(df.sparkSession)
    place = F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))))
    n = df.count()
    rows = df.select(F.col(f"`{html}`").alias("html"), place.alias("place"))
    if n > 4 * SAMPLE_PAGES:  # about twice as many are left to be ordered
        rows = rows.where(F.col("place") < F.lit(int(-(2**63) + 2**64 * 2 * SAMPLE_PAGES / n)))
    rows = rows.orderBy("place").limit(SAMPLE_PAGES)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = labelled(batch.column("html")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    found = rows.select("html").mapInArrow(run, "x binary, y binary").collect()
    x = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *(np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in found)])
    y = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r["y"], np.int8) for r in found)])
    return fit_weights(x, y)


def extract(df: DataFrame, html: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``text`` and its length ``n_chars`` in code points; the classifier is fitted on a sample of ``df`` unless weights are given."""
    weights = fit(df, html) if weights is None else weights

    def make(batch):
        for piece, pages in pieces(batch, html):
            texts = [main_text(p, weights) for p in pages]
            yield piece, [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_columns_from(df, "text string, n_chars long", make)
