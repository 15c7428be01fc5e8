"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier over structural and textual features gives every block a log-odds
of being content; these become the capacities to source and sink. Edges join neighbours in page order and neighbours in
the same container, so that a doubtful block follows its surroundings. The minimum cut labels the blocks. Blocks whose own
capacity exceeds all their edges are certain to keep their side and are folded into their neighbours first, which leaves
small cores for the max-flow.

The classifier starts from fixed weights and is trained on blocks of a bounded sample of pages (`SAMPLE` pages, at most
`MAX_CHARS` characters, by a hash of the id) that lie in semantic containers; where there are none the weights stay.
Every page is one row of one task; nothing is shuffled. Defined results: null or empty html gives the empty text; broken
markup is read as far as it goes; repeated rows stay; null ids stay null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, table

SAMPLE, MAX_CHARS = 300, 4_000_000
NEAR, SAME = 0.5, 0.7  # capacities of edges: next block; next block of the same container

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*>", re.S)
TAG, EVENT = re.compile(r"</?[a-zA-Z]"), re.compile(r">|=\s*([\"'])")
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Kinds of elements and the words of classes, ids and roles that hint at content or at its surroundings.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title template textarea iframe select option button canvas audio video noframes".split())
CLOSED = {tag: re.compile(f"</{tag}(?:[\\s/>]|\\Z)", re.I | re.A) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SURROUNDINGS = frozenset("nav aside footer form menu dialog fieldset search".split())
NEGATIVE = frozenset("nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar login signup search contentinfo complementary alert dialog copyright legal disclaimer tags".split())
# words that say nothing inside an article, whose forms and menus are elements of their own; words that only name a box
OUTSIDE = frozenset("search login signup legal tags overlay".split())
PLACES = frozenset("area bar block body bottom box buttons card cards col column container entries fixed float form global group home icons inner inline item items layout left level line link links list lists lower main mobile outer page panel posts articles stories primary region right row secondary section site small sticky text top upper wrap wrapper".split())
COMMENTS = frozenset("comment comments reply replies disqus respond discussion commentlist".split())
POSITIVE = frozenset("article content main post entry story maincontent articlebody".split())
# The classifier's weights before training.
FEATURES = ("bias", "inside", "surroundings", "negative", "comments", "outside", "links", "words", "sentence", "heading", "item")
WEIGHTS = np.array([-0.5, 4.0, -7.0, -7.0, -9.0, -6.0, -3.0, 0.6, 0.6, 0.5, -0.3])


def _beside(words: set[str], article: bool) -> bool:
    """A class, id or role of these words names surroundings: all of them do or only name a place, and it isn't the header of
    the article itself ("related-work" and "article-header" are not, "related-posts" and "site-header" are)."""
    bad = words & NEGATIVE - (OUTSIDE if article else frozenset())
    return bool(bad) and words <= NEGATIVE | PLACES | POSITIVE and not (bad == {"header"} and words & POSITIVE - {"main"})


class Element:
    """An open element; apart from the tag it holds what is true of it or of any element around it."""

    __slots__ = ("tag", "negative", "comments", "positive", "article", "surroundings", "header")

    def __init__(self, tag: str, attrs: str, around: Element | None):
        self.tag, words, tokens = tag, set(), []
        self.negative = tag in SURROUNDINGS
        for name, a, b, c in NAMED.findall(attrs) if attrs else ():
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                for token in value.split():
                    parts = {x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if x}
                    tokens.append(parts)
                    words |= parts
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
                self.negative = True
        self.comments = not words.isdisjoint(COMMENTS)
        self.positive = tag in ("article", "main") or not words.isdisjoint(POSITIVE)
        if tag not in ("html", "body", "article", "main") and any(_beside(x, bool(around and around.article)) for x in tokens):
            self.negative = True
        own = not self.comments
        self.article, self.surroundings, self.header = tag in ("article", "main"), tag in SURROUNDINGS, tag == "header"
        if around:
            self.comments |= around.comments
            self.positive |= around.positive
            self.surroundings |= around.surroundings
            self.header |= around.header
            # what holds the article is not its surroundings, whatever its class says
            self.negative |= around.negative and not (self.article and own and not around.article)
            self.article |= around.article


def _closing(page: str):
    """Function of the place of a '<': False if it begins a tag that never ends by the grammar of TOKEN (quoted '>' do not
    count). Computed once for all places, from the end of the page."""
    events = [(m.start(), m.end(), m[1]) for m in EVENT.finditer(page)]
    firsts = [e[0] for e in events]
    quotes = {q: [m.start() for m in re.finditer(q, page)] for q in "\"'"}
    ends = [False] * (len(events) + 1)
    for k in range(len(events) - 1, -1, -1):
        _, stop, quote = events[k]
        if quote is None:
            ends[k] = True
            continue
        shut = bisect.bisect_left(quotes[quote], stop)
        # a quote that is not shut is a sign like others
        ends[k] = ends[k + 1] if shut == len(quotes[quote]) else ends[bisect.bisect_left(firsts, quotes[quote][shut] + 1)]
    return lambda at: not TAG.match(page, at) or ends[bisect.bisect_left(firsts, at)]


def blocks(page: str | None) -> list[tuple[str, Element | None, int, int]]:
    """(text, innermost open element, characters in links, container) of every block of text. Linear in the page."""
    found: list = []
    stack: list[Element] = []
    held: list[Element] = []  # closed elements stay alive, so that containers keep their numbers
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = anchors = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, stack[-1] if stack else None, linked, id(stack[-2]) if len(stack) > 1 else 0))
            parts.clear()
        linked = 0

    def close(tag: str, barrier: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1 if opened.get(tag) else -1, -1, -1):
            if stack[i].tag == tag:
                for e in stack[i:]:
                    opened[e.tag] -= 1
                held.extend(stack[i:])
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    def text(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if anchors:
            linked += len(piece.strip())

    at, size = 0, len(page)
    open_tags, last = None, page.rfind(">")
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        m = TOKEN.match(page, start) if open_tags is None or open_tags(start) else None
        if m is None:
            if open_tags is None and TAG.match(page, start):  # a tag without an end: later ones are not scanned to the end again
                open_tags = _closing(page)
            text("<")
            at = start + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
                close(tag)
            elif tag == "a":
                anchors = max(0, anchors - 1)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = CLOSED[tag].search(page, at)
                stop = page.find(">", end.end() - 1) if end else -1
                at = size if stop < 0 else stop + 1
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            close("p", frozenset(BLOCKS - {"p"}))
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                close(tag, frozenset(("ul", "ol", "dl", "table", "tbody", "tr") if tag in ("td", "th") else ("ul", "ol", "dl", "table")))
            stack.append(Element(tag, m[3], stack[-1] if stack else None))
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            anchors = 1
    flush()
    return found


def features(found: list) -> np.ndarray:
    whole = any(e is not None and e.article and not e.comments for _, e, _, _ in found)
    out = np.zeros((len(found), len(FEATURES)))
    for i, (text, e, linked, _) in enumerate(found):
        last = e.tag if e else ""
        article, comments = bool(e and e.article), bool(e and e.comments)
        inside, negative = bool(e and e.positive and not comments), bool(e and e.negative)
        around = bool(e and (e.surroundings or (e.header and not article)))
        out[i] = (
            1, inside, around, negative, comments, whole and not article,
            min(1.0, linked / max(1, len(text))), min(4.0, math.log1p(text.count(" "))), text[-1] in ".!?。…\"”", last in ("h1", "h2", "h3", "h4", "h5", "h6"), last == "li",
        )
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the source side of a minimum cut: gain is the capacity from the source (to the sink where it
    is negative), edges are undirected capacities."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        if u != v:
            near[u][v] = near[u].get(v, 0.0) + c
            near[v][u] = near[v].get(u, 0.0) + c
    side: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # a node that outweighs its edges keeps its side in some minimum cut
        u = todo.popleft()
        if side[u] is None and abs(gain[u]) >= weight[u]:
            side[u] = gain[u] > 0
            for v, c in near[u].items():
                if side[v] is None:
                    gain[v] += c if side[u] else -c
                    weight[v] -= c
                    del near[v][u]
                    todo.append(v)
            near[u] = {}
    core = [u for u in range(n) if side[u] is None]
    if not core:
        return [bool(s) for s in side]
    number = {u: k for k, u in enumerate(core)}
    reached = _max_flow([gain[u] for u in core], [(number[u], number[v], c) for u in core for v, c in near[u].items() if u < v])
    for u in core:
        side[u] = reached[number[u]]
    return [bool(s) for s in side]


def _max_flow(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes that the source still reaches after a maximum flow: level graphs and blocking flows, each found with one pass over
    the arcs, along paths kept on a stack."""
    n, tiny = len(gain), 1e-12
    supply, demand = [max(0.0, g) for g in gain], [max(0.0, -g) for g in gain]
    to, room, arcs = [], [], [[] for _ in range(n)]
    for u, v, c in edges:
        arcs[u].append(len(to))
        arcs[v].append(len(to) + 1)
        to += (v, u)
        room += (c, c)
    while True:
        level = [0 if s > tiny else -1 for s in supply]
        wave, deep, goal = [u for u in range(n) if level[u] == 0], 0, False
        while wave and not goal:
            goal = any(demand[u] > tiny for u in wave)
            deep += 1
            ahead = []
            for u in wave:
                for a in arcs[u]:
                    v = to[a]
                    if level[v] < 0 and room[a] > tiny:
                        level[v] = deep
                        ahead.append(v)
            wave = ahead
        if not goal:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            path: list[int] = []
            u = start
            while level[start] == 0 and supply[start] > tiny:
                if demand[u] > tiny:
                    flow = min(supply[start], demand[u], *(room[a] for a in path)) if path else min(supply[start], demand[u])
                    supply[start] -= flow
                    demand[u] -= flow
                    keep = len(path)
                    for k, a in enumerate(path):
                        room[a] -= flow
                        room[a ^ 1] += flow
                        if room[a] <= tiny:
                            keep = min(keep, k)
                    u = to[path[keep] ^ 1] if keep < len(path) else u
                    del path[keep:]
                    continue
                while at[u] < len(arcs[u]):
                    a = arcs[u][at[u]]
                    if room[a] > tiny and level[to[a]] == level[u] + 1:
                        break
                    at[u] += 1
                else:  # nothing leads on from here
                    level[u] = -2
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                    continue
                path.append(a)
                u = to[a]


def main_text(page: str | None, weights: np.ndarray = WEIGHTS) -> str:
    found = blocks(page)
    if not found:
        return ""
    gain = (features(found) @ weights).tolist()
    edges, last = [], {}
    for i, (_, _, _, container) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR))
        if container in last:
            edges.append((last[container], i, SAME))
        last[container] = i
    kept = [f[0] for f, keep in zip(found, minimum_cut(gain, edges), strict=True) if keep]
    if not kept:  # a page is about something: what stands in no surroundings is its text
        kept = [text for text, e, _, _ in found if e is None or not (e.surroundings or e.negative or e.comments or e.header)]
    return "\n".join(kept)


def train(pages: list[str], steps: int = 200, pull: float = 0.02) -> np.ndarray:
    """Weights that fit the blocks inside semantic containers, held near the fixed ones. Each block counts twice: as it is, and
    without the features that say in which container it lies, so that those of its text are learned from the others' labels."""
    x = [features(b) for p in pages if (b := blocks(p))]
    x = np.concatenate(x) if x else np.zeros((0, len(WEIGHTS)))
    inside, around = FEATURES.index("inside"), [FEATURES.index(c) for c in ("surroundings", "negative", "comments", "outside")]
    good, bad = (x[:, inside] > 0) & ~x[:, around].any(1), (x[:, inside] == 0) & x[:, around].any(1)
    if not good.any() or not bad.any():
        return WEIGHTS
    x, y = np.concatenate([x[good], x[bad]]), np.concatenate([np.ones(good.sum()), np.zeros(bad.sum())])
    bare = x.copy()
    bare[:, [inside, *around]] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    n = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = WEIGHTS.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 0.5 * (x.T @ (n * (p - y)) + pull * (w - WEIGHTS))
    return w


def fit(pages: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> np.ndarray:
    spark = pages.sparkSession
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").where("page_id is not null and html is not null")
    ids = keyed.select("page_id", F.length("html").alias("n"), F.lit(0).alias("all")).orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()
    some = [(r["page_id"],) for r in fitting(ids, "all", max_chars)]
    if not some:
        return WEIGHTS
    rows = keyed.join(F.broadcast(spark.createDataFrame(some, "page_id long").distinct()), "page_id").select("page_id", F.substring("html", 1, max_chars).alias("html")).limit(2 * sample).collect()
    return train([r["html"] for r in sorted(rows, key=lambda r: (r["page_id"], r["html"]))][:sample])


def extract(pages: DataFrame, weights: np.ndarray = WEIGHTS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
