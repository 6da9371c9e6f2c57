"""HTML extraction by minimum cut.

A page becomes a tree of block elements with text blocks on them. A classifier prices the two labels (content,
boilerplate) of every block by its text (length, sentences, links, heading, place in the page, what it stands in) and of
every element by its tag, role and the words of its class; the prices are the capacities to the terminals. Smoothness
edges join a block with its element, an element with its parent, and neighbouring blocks. The minimum cut is the
cheapest labelling, so a short paragraph goes with the article around it, and an advert's long sentence with its frame.
Nodes whose price outweighs all their edges keep their label in every minimum cut; the others go through max-flow.

The weights are those that fit() finds on labelled pages: logistic regression whose prior is what the names of HTML and
of site authors say, since a sample never shows all of them. WEIGHTS are its result for the first SAMPLE pages of a
small table whose article texts are known.

Defined cases: null or empty html gives an empty text; scripts, styles, comments, head and markup never reach a block;
unclosed tags and cut-off pages are read as far as they go; stray end tags are ignored; a page without content gives an
empty text. Time grows in proportion to a page's tags, however they are nested. Repeated rows are treated alike, an
empty table gives an empty one; extract() keeps extra columns, and puts a number behind a name of its own that is taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, extended, free, quoted, table, tidy

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCKS = frozenset("address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What stops the search for an element that a start tag closes.
SCOPE = frozenset("ul ol dl table body html div article section main aside nav header footer form blockquote select".split())
#: A block start closes an open paragraph, except inside these.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Names that site authors give to what is not the article, or is; and words that say nothing themselves.
AWAY_TAGS = frozenset("nav footer aside form button select menu dialog fieldset".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navi menu breadcrumb breadcrumbs pagination pager sidebar aside side footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert warning disclaimer copyright legal share sharing social comment comments disqus reply replies discussion respond related recommended teaser newsletter subscribe subscription signup login register form search popup modal overlay widget widgets tags toc skip outbrain taboola paywall".split()
)
#: Of these, what says so before any other word.
CLEAR = frozenset("advert advertisement advertising breadcrumb breadcrumbs consent cookie cookies disqus gdpr navbar newsletter outbrain promo recommended related sidebar sponsor sponsored taboola".split())
#: Of these, alone, what makes an article something else; its or the page's own element may carry others for its layout.
AWAY_ON_ARTICLE = frozenset("ad ads advert sponsored promo comment comments reply replies related teaser".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story text".split())
NEUTRAL = frozenset("area bar block body bottom box btn button buttons center col column container content div entry footer frame group header holder inner item items layout left li link links list main outer panel row right section site slot text title top unit wrap wrapper zone".split())

#: Features of a block and of an element, and the prior means of their weights (positive: content), in units of the
#: smoothness edges' capacities.
BLOCK = {"base": -1.5, "length": 0.5, "sentence": 0.75, "heading": 0.5, "links": -5.0, "edge": -0.5}
ELEMENT = {"away tag": -8.0, "away role": -8.0, "away name": -8.0, "away hint": -1.0, "hidden": -12.0, "article": 4.0, "main name": 1.5, "inside": -0.5}
#: What a block stands in: something set apart; an article; neither, on a page that has no article. In an article no
#: text is boilerplate by itself (see MOST).
AWAY, MAIN, PLAIN = -1.0, 3.0, 2.4
#: How far weights may leave the prior (standard deviation), and labelled pages to fit on.
SPREAD, SAMPLE = 0.5, 500
#: Edges: a block and its element, an element and its parent, an element and the page, neighbouring blocks; and the most
#: that a block's text says.
OWN_EDGE, UP_EDGE, PAGE_EDGE, NEXT_EDGE, MOST = 4.0, 2.5, 0.5, 0.5, 3.0
#: An element that says much about itself is less like its parent: its edge falls by e for so much of a price.
CONTRAST = 4.0
#: Elements with features that stand one in another, as far as they are told apart.
DEEPEST = 32
#: Of what an element says against itself, what is a feature of all that it holds.
LEAST_AWAY = -4.0


@dataclass
class Element:
    name: str
    parent: int
    features: tuple[float, ...]
    away: bool  # it or one around it is set apart
    main: bool  # it or one around it is an article, and nothing in between is set apart


@dataclass
class Block:
    text: str
    element: int
    features: tuple[float, ...]


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


_ARTICLE = list(ELEMENT).index("article")


def _words(value: str) -> tuple[set[str], set[str]]:
    """Of a class or id: the words that say what the element is, and those before them that only hint at it."""
    heads, hints = set(), set()
    for name in value.split():
        parts = [p for p in _PARTS.findall(name)]
        parts = [p.lower() for p in parts]
        while len(parts) > 1 and parts[-1] in NEUTRAL:
            parts.pop()
        if parts:
            heads.add(parts[-1])
            hints.update(parts[:-1])
    return heads, hints - heads


def element_features(name: str, attrs: str, inside_article: bool, away: bool) -> tuple[float, ...]:
    """In the order of ELEMENT."""
    found = dict.fromkeys(ELEMENT, 0.0)
    found["away tag"] = float(name in AWAY_TAGS or (name == "header" and not inside_article))
    found["article"] = float(name in ("article", "main") and not away)
    found["inside"] = float(away)
    if attrs:
        whole = name in ("article", "main", "body", "html")
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                heads, hints = _words(value)
                apart = AWAY_ON_ARTICLE & set(value.lower().split()) if whole else heads & AWAY_NAMES | hints & CLEAR
                found["away name"] = max(found["away name"], float(bool(apart)))
                if not whole:
                    found["away hint"] = min(2.0, found["away hint"] + len(hints & AWAY_NAMES - apart))
                if heads & MAIN_NAMES and not away:
                    found["main name"] = 1.0
            elif key == "role":
                found["away role"] = max(found["away role"], float(value.lower() in AWAY_ROLES))
                if value.lower() in ("main", "article") and not away:
                    found["article"] = 1.0
            elif key == "hidden" or (key == "style" and _HIDDEN.search(value.lower())) or (key == "aria-hidden" and value == "true"):
                found["hidden"] = 1.0
    return tuple(found.values())


def parse(page: str) -> Page:
    """The block elements of a page, and its blocks of text in order."""
    out = Page([Element("", -1, (0.0,) * len(ELEMENT), False, False)])
    # An open element: name, its place among the block elements, inside an article, inside a link.
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    # Places in the stack: of block elements, of what ends a search, of each name. So nothing is ever searched for.
    block_at, scope_at, open_at = [0], [0], {}
    pieces: list[str] = []
    linked = at = 0
    skip_head = False
    found: list[tuple[str, int, int]] = []

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                found.append((text, stack[block_at[-1]][1], linked))
        linked = 0

    def close(k: int) -> None:
        if block_at[-1] >= k:
            flush()
        for i in range(len(stack) - 1, k - 1, -1):
            name = stack.pop()[0]
            open_at[name].pop()
            if block_at[-1] == i:
                block_at.pop()
            if scope_at[-1] == i:
                scope_at.pop()

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not skip_head:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1][3]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "head":
                skip_head = False
            elif name == "br":
                pieces.append(" ")
            elif open_at.get(name):
                close(open_at[name][-1])
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "head":
            skip_head = True
            continue
        if name == "body":
            skip_head = False
        if name in VOID:
            if name == "br":
                pieces.append(" ")
            elif name in BLOCKS:
                flush()
            continue
        _, number, inside, link = stack[-1]
        # Elements that HTML doesn't know stand in their line, but for those with a name of an author's own kind.
        if name in BLOCKS or "-" in name:
            ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            while nearest := max((open_at[e][-1] for e in ends if open_at.get(e)), default=0):
                if nearest <= scope_at[-1]:
                    break
                close(nearest)
                if name not in ("tr", "td", "th"):
                    break
            flush()
            _, number, inside, link = stack[-1]
            around = out.elements[number]
            features = element_features(name, m[3], inside, around.away)
            own = sum(w * x for w, x in zip(list(ELEMENT.values())[:5], features, strict=False))
            away = around.away or own <= LEAST_AWAY
            out.elements.append(Element(name, number, features, away, not away and (around.main or features[_ARTICLE] > 0)))
            number = len(out.elements) - 1
            block_at.append(len(stack))
            if name in SCOPE:
                scope_at.append(len(stack))
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, number, inside or name in ("article", "main"), link or name == "a"))
    flush()
    for i, (text, number, linked) in enumerate(found):
        e = out.elements[number]
        edge = (2 * i / (len(found) - 1) - 1) ** 2 if len(found) > 1 else 0.0
        heading = e.name[:1] == "h" and e.name[1:].isdigit()
        out.blocks.append(Block(text, number, (1.0, math.log2(2 + text.count(" ")), float(bool(_SENTENCE.search(text))), float(heading), min(1.0, linked / len(text)), edge)))
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total price: a block's score if it is positive and labelled boilerplate, its
    negative if it is negative and labelled content, and the capacity of every edge between unlike labels."""
    n = len(scores)
    weight: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        weight[a][b] = weight[a].get(b, 0.0) + c
        weight[b][a] = weight[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    score = list(scores)
    # What outweighs all its open edges is settled; its edges then become part of its neighbours' prices.
    work = deque(range(n))
    while work:
        i = work.popleft()
        if label[i] is None and abs(score[i]) >= sum(weight[i].values()):
            label[i] = score[i] > 0
            for j, c in weight[i].items():
                del weight[j][i]
                score[j] += c if label[i] else -c
                work.append(j)
            weight[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _max_flow([score[i] for i in left], left, weight), strict=True):
            label[i] = content
    return [bool(x) for x in label]


def _max_flow(scores: list[float], left: list[int], weight: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; True for what the source still reaches."""
    place = {i: k for k, i in enumerate(left)}
    s, t = len(left), len(left) + 1
    graph: list[dict[int, float]] = [{} for _ in range(t + 1)]
    for k, i in enumerate(left):
        if scores[k] > 0:
            graph[s][k], graph[k][s] = scores[k], 0.0
        elif scores[k] < 0:
            graph[k][t], graph[t][k] = -scores[k], 0.0
        for j, c in weight[i].items():
            graph[k][place[j]] = c
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c in graph[a].items():
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if t not in level:
            return [k in level for k in range(len(left))]
        nexts = {a: iter(list(graph[a])) for a in level}
        path = [s]
        while path:
            a = path[-1]
            if a == t:
                flow = min(graph[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    graph[x][y] -= flow
                    graph[y][x] = graph[y].get(x, 0.0) + flow
                cut_at = next(k for k, (x, y) in enumerate(zip(path, path[1:], strict=False)) if graph[x][y] <= 1e-12)
                del path[cut_at + 1 :]
                continue
            for b in nexts[a]:
                if graph[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                level[a] = -1


def graph(page: Page, weights: Weights) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Prices and edges. The nodes are the blocks, then the elements that hold text."""
    n = len(page.blocks)
    scores, plain = [], 0.0 if any(e.main for e in page.elements) else PLAIN
    for b in page.blocks:
        e = page.elements[b.element]
        scores.append(max(-MOST, min(MOST, _dot(weights[0], b.features))) + (AWAY if e.away else MAIN if e.main else plain))
    edges = [(i, i + 1, NEXT_EDGE) for i in range(n - 1)]
    place: dict[int, int] = {}
    above = _above(page)
    for i, b in enumerate(page.blocks):
        k, below, capacity = b.element, i, OWN_EDGE
        while k >= 0:
            known = k in place
            if not known:
                place[k] = len(scores)
                scores.append(_dot(weights[1], page.elements[k].features))
            edges.append((below, place[k], capacity))
            if known:
                break
            below, capacity, k = place[k], (UP_EDGE if above[k] > 0 else PAGE_EDGE) * math.exp(-abs(scores[place[k]]) / CONTRAST), above[k]
    return scores, edges


def _above(page: Page) -> list[int]:
    """Of each element the next one around it that has a feature, or the page: elements without any (a paragraph, a plain
    division) only join what they hold. So the graph is as deep as such elements nest, and DEEPEST at most: what nests
    deeper hangs on the one at that depth."""
    out, depth = [], []
    for e in page.elements:
        k = e.parent
        if k >= 0:
            if k and not any(page.elements[k].features):
                k = out[k]
            while depth[k] >= DEEPEST:
                k = out[k]
        out.append(k)
        depth.append(depth[k] + 1 if k >= 0 else 0)
    return out


def labels(page: Page, weights: Weights | None = None) -> list[bool]:
    """Of each block whether it is content."""
    scores, edges = graph(page, weights or WEIGHTS)
    return min_cut(scores, edges)[: len(page.blocks)]


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, one a line."""
    parsed = parse(page or "")
    return "\n".join(b.text for b, keep in zip(parsed.blocks, labels(parsed), strict=True) if keep)


#: Weights of blocks and of elements, in the order of BLOCK and ELEMENT.
Weights = tuple[tuple[float, ...], tuple[float, ...]]


def _dot(weights: tuple[float, ...], features: tuple[float, ...]) -> float:
    return sum(w * x for w, x in zip(weights, features, strict=True) if x)


def fit(pages: Iterable[tuple[str, str]]) -> Weights:
    """The weights that fit pages (html, text that holds the article's): a block is content if the text holds it, an
    element if most characters of its blocks are content. Each page counts once, however many blocks it has. What blocks
    stand in is left to the elements' prices and the edges, or it would outweigh all that texts say."""
    rows: tuple[list, list] = ([], [])
    for page, known in pages:
        parsed, lines = parse(page), {" ".join(x.split()) for x in known.split("\n")}
        known = " ".join(known.split())
        # A few words stand in any long text by chance; they have to be a line of it.
        good = [b.text in (known if b.text.count(" ") >= 4 else lines) for b in parsed.blocks]
        held = [[0, 0] for _ in parsed.elements]
        for b, y in zip(parsed.blocks, good, strict=True):
            rows[0].append((b.features, y, 1 / len(good)))
            k = b.element
            while k >= 0:
                held[k][y] += len(b.text)
                k = parsed.elements[k].parent
        rows[1].extend((e.features, y > n, 1 / len(held)) for e, (n, y) in zip(parsed.elements, held, strict=True) if n + y)
    return _map_fit(rows[0], list(BLOCK.values())), _map_fit(rows[1], list(ELEMENT.values()))


def _map_fit(rows: list[tuple[tuple[float, ...], bool, float]], prior: list[float]) -> tuple[float, ...]:
    """Logistic regression with a Gaussian prior, by Newton's method."""
    mean = np.array(prior)
    if not rows:
        return tuple(prior)
    x, y, share = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    w = mean.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (share * (p - y)) + (w - mean) / SPREAD**2
        hess = (x.T * (share * p * (1 - p))) @ x + np.eye(len(w)) / SPREAD**2
        w -= np.linalg.solve(hess, grad)
    return tuple(round(float(v), 2) for v in w)


WEIGHTS: Weights = ((-1.34, 0.66, 0.58, 1.21, -5.09, -1.49), (-8.0, -8.0, -7.99, -1.0, -12.0, 4.09, 1.5, -2.76))


def extract(pages: DataFrame, html_column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without the html column, with the main text and its length in code points."""
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html_column]
    text = free(text, kept)
    n_chars = free(n_chars, [*kept, text])
    df = pages.select(*quoted(*kept), F.col(quoted(html_column)[0]).cast("string").alias(free("__html", kept)))
    schema = extended(df.select(*quoted(*kept)), (text, "string"), (n_chars, "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return df.mapInArrow(tidy(run), schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
