"""Main text of web pages by a minimum cut (operator 10).

A page is read into blocks (runs of text between block-level tags), each with its place in the DOM. Every block gets the odds of being
content, and they become the capacities of its edges to the two terminals. Smoothness edges join neighbours in page order, and each
block to the one before it under the same parent, and the same grandparent; an edge between elements of the same tag and class weighs
more than one between unlike ones. The minimum cut (Dinic's maximum flow) is the cheapest labelling of all blocks; blocks on the
content side are the text. No mark decides alone: all evidence is bounded, and the cut weighs it against the neighbours.

The odds have three bounded parts:
* text (length, links, punctuation): logistic regression, within +-`MOST_TEXT`. A tag's kind is no feature, only a likeness of edges;
* marks (class, id and role words, headings that announce comments): weights of the same regression, each within its own bounds;
* structure (article and main against nav, aside, footer, form and so on): fixed evidence, less than text and marks together.

The regression is fitted here on pages that mark their parts by article or main; its labels come from that structure alone: at most
about `most_pages` pages by hash of the id and `most_blocks` blocks of each (documented bound).

Nulls and edges: a null html counts as empty; a page without blocks or without content gives an empty text; unclosed tags are
closed where HTML implies it, text after the last tag counts, an unterminated comment or script runs to the end; tags deeper than
`MOST_DEPTH` belong to the element at that depth; repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored. Reading is linear in the page (times the depth bound, at worst).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spread, table, tidy

_OPEN = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_PIECE = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

MOST_DEPTH = 512
#: These run to the end of the page when they are not closed; any other tag of RAW is then passed over by itself.
TO_THE_END = frozenset("script style".split())
RAW = frozenset("script style noscript template iframe object svg annotation canvas textarea select title head audio video".split())
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article main section nav header footer aside form fieldset blockquote pre figure figcaption address hr details summary dialog center".split()
)
VOID = frozenset("hr br img input meta link wbr area base col embed source track param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes when it is open, up to the tags that shield it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = BLOCK - {"html", "body"}
#: A button inside one of these is a word of its text, elsewhere a block of its own.
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption summary".split())
AGAINST_TAGS = frozenset("nav footer aside form fieldset dialog menu".split())
#: Also against an article inside them; a form or header may well enclose the whole page.
OUTSIDE_TAGS = frozenset("nav footer aside".split())
ROOT_WORDS = frozenset("article content post entry story main body text".split())
AGAINST_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget related recommended footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal subscribe newsletter signup login share sharing social form search copyright legal".split()
)
#: Words that don't change what an AGAINST_WORD says of an element (ad-box, top-menu), unlike others (share-price, search-results).
FILLERS = frozenset("box block bar wrap wrapper container inner outer item items list links icons buttons button top bottom left right area section panel group row col holder unit slot site page header global primary secondary main sticky fixed".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
#: In one class or id with a comment word: the page has comments or not, which says nothing of the text below (has-comments).
STATE_WORDS = frozenset("has with no without open closed enabled disabled layout site".split())
#: Headings that announce comments (whole words of a heading of at most 40 characters).
COMMENT_HEADING = re.compile(r"(?i)(?<!\w)(?:comments?|commentaires?|kommentare?|comentarios?|replies|responses|discussion|leave a reply)(?!\w)")


class Node:
    """An open element, with what it and the elements above it say."""

    __slots__ = ("tag", "number", "up", "like", "hidden", "article", "main", "nested", "strong", "weak", "comments", "root_word", "against", "outside", "header", "announced")

    def __init__(self, tag: str, attributes: str, number: int, up: Node | None):
        self.tag, self.number, self.up = tag, number, up
        classes, self.hidden = [], up.hidden if up else False
        strong = weak = comments = root_word = False
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.hidden = True
                elif name in ("class", "id", "role"):
                    for one in value.split():
                        found = {w.lower() for w in _PIECE.findall(_CAMEL.sub(" ", one))}
                        if name != "id":
                            classes.append(one)
                        if found & STATE_WORDS:
                            continue
                        comments = comments or bool(found & COMMENT_WORDS)
                        if found & AGAINST_WORDS:
                            strong = strong or found <= AGAINST_WORDS | FILLERS
                            weak = True
                        elif found & ROOT_WORDS:
                            root_word = True
        self.like = (tag, tuple(classes))
        page = tag in ("html", "body")
        self.comments = (up.comments if up else False) or comments and not page
        # marks of the element itself, or of one above it and below the innermost article or main
        fresh = tag in ("article", "main")
        self.strong = strong and not page or bool(up and up.strong and not fresh)
        self.weak = weak and not page or bool(up and up.weak and not fresh)
        self.root_word = root_word and not page or bool(up and up.root_word)
        self.outside = bool(up and up.outside) or tag in OUTSIDE_TAGS
        self.against = tag in AGAINST_TAGS or bool(up and up.against and not fresh)
        self.header = tag == "header" or bool(up and up.header and not fresh)
        # an article in an article is a comment on it, or another one's teaser
        self.nested = bool(up and (up.nested or tag == "article" and up.article))
        self.article = tag == "article" or bool(up and up.article)
        self.main = tag == "main" or bool(up and up.main)
        self.announced = False  # a heading under it announced comments


@dataclass
class Block:
    text: str
    node: Node | None
    linked: int
    kind: str
    announced: bool = False


def _tag_end(page: str, at: int) -> int:
    """The place after the > that ends a tag; quoted values may hold one. -1: the page ends inside a value or without >."""
    while (m := _STOP.search(page, at)) is not None:
        if m.group() == ">":
            return m.end()
        at = m.end()
        if page[max(0, m.start() - 40) : m.start()].rstrip()[-1:] == "=":
            end = page.find(m.group(), at)
            if end < 0:
                return -1
            at = end + 1
    return -1


def read_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, empty ones left out."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[Node] = []
    open_: dict[str, int] = {}
    beyond: dict[str, int] = {}  # open tags deeper than MOST_DEPTH
    text: list[str] = []
    unclosed: set[str] = set()
    linked, in_link, number, at, in_button = 0, 0, 0, 0, False
    last_gt = page.rfind(">")
    loose = False  # quotes are no longer looked at

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(entities.unescape("".join(text)).split())
            top = stack[-1] if stack else None
            if body and not (top and top.hidden):
                kind = "button" if in_button else top.tag if top else ""
                node, announced = top, False
                while node is not None and not announced:
                    announced, node = node.announced, node.up
                if kind in HEADINGS and len(body) <= 40 and COMMENT_HEADING.search(body) and top.up is not None:
                    announced = top.up.announced = True
                out.append(Block(body, top, min(linked, len(body)), kind, announced))
            text.clear()
        linked = 0

    def cut(i: int) -> None:
        for n in stack[i:]:
            open_[n.tag] -= 1
        del stack[i:]

    def close(tags: set | frozenset, shields: set | frozenset) -> bool:
        if not any(open_.get(t) for t in tags):
            return False
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                cut(i)
                return True
            if stack[i].tag in shields:
                return False
        return False

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last_gt:
            # an open comment runs to the end
            end = page.find("<!--", lt) if lt >= 0 else -1
            text.append(page[at:] if end < 0 else page[at:end])
            break
        if lt > at:
            piece = page[at:lt]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        m = _OPEN.match(page, lt + 1)
        if m is None:
            if page.startswith("</", lt):
                at = page.find(">", lt) + 1
                continue
            text.append("<")
            at = lt + 1
            continue
        end = -1 if loose else _tag_end(page, m.end())
        if end < 0:
            loose = True
            end = page.find(">", m.end()) + 1
        attributes = page[m.end() : end - 1]
        at = end
        closing, tag = m.group(1), m.group(2).lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = None if tag in unclosed else _closing(tag).search(page, at)
                if stop is not None:
                    at = stop.end()
                elif tag in TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "button":
            if not (stack and stack[-1].tag in TEXT_TAGS):
                flush()
                in_button = not closing
            continue
        if tag not in BLOCK:
            continue
        flush()
        in_button = False
        if closing:
            if beyond.get(tag):
                beyond[tag] -= 1
            else:
                close({tag}, set() if tag in ("html", "body", "article", "main", "div") else {"article", "main"} - {tag})
        else:
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "div", "article", "section", "blockquote", "li"})
            if tag in CLOSES:
                while close(*CLOSES[tag]):
                    pass
            if tag not in VOID:
                if len(stack) < MOST_DEPTH:
                    number += 1
                    stack.append(Node(tag, attributes, number, stack[-1] if stack else None))
                    open_[tag] = open_.get(tag, 0) + 1
                else:
                    beyond[tag] = beyond.get(tag, 0) + 1
    flush()
    return out


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}\\s*>", re.I)


def roots(blocks: list[Block]) -> list[bool | None]:
    """Whether each block is in the page's main part, by article and main alone: None where the page has neither.

    The articles outside nav, aside and footer are that part when they hold half of the unlinked text, else main is.
    """
    free = [(b.node, len(b.text) - b.linked) for b in blocks]
    total = sum(n for _, n in free)
    article = [bool(n and n.article and not n.outside) for n, _ in free]
    main = [bool(n and n.main and not n.outside) for n, _ in free]
    held = sum(n for (_, n), inside in zip(free, article, strict=True) if inside)
    if any(article) and (2 * held >= total or not any(main)):
        return list(article)
    return list(main) if any(main) else [None] * len(blocks)


#: Fixed evidence of structure.
INSIDE, OUTSIDE, AGAINST, HEADER, NESTED = 1.5, -3.0, -3.0, -2.0, -5.0


def structure(block: Block, inside: bool | None) -> float:
    n = block.node
    if n is None:
        return 0.0
    out = 0.0 if inside is None else INSIDE if inside else OUTSIDE
    if n.against or not inside and n.outside:
        out += AGAINST
    if n.header and not n.article and not inside:
        out += HEADER
    return out + NESTED * n.nested


N_TEXT, N_MARKS = 6, 4


def features(block: Block) -> list[float]:
    t, node = block.text, block.node
    n = len(t)
    return [
        1.0,
        min(np.log1p(n), 8.0) / 4 - 1,
        block.linked / n,
        min(1.0, (t.count(",") + t.count(".") + t.count(";")) / n * 10),
        float(t[-1] in ".!?:;\"'”»。"),
        float("©" in t or block.kind == "button"),
        float(bool(node and node.strong)),
        float(bool(node and node.weak and not node.strong)),
        float(bool(node and node.comments) or block.announced),
        float(bool(node and node.root_word and not node.weak)),
    ]


#: Used when no page marks its parts: long unlinked punctuated paragraphs are content.
PRIOR = np.array([0.3, 2.0, -4.0, 0.5, 1.0, -2.0, -6.0, -1.0, -6.0, 1.0])
MOST_TEXT = 2.0
MARK_BOUNDS = np.array([[-7.0, -5.0], [-1.5, 0.0], [-7.0, -5.0], [0.0, 1.5]])


def _newton(rows: np.ndarray, labels: np.ndarray, offset: np.ndarray, prior: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    w = prior.copy()
    # both kinds weigh the same
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w + offset, -30, 30)))
        g = rows.T @ (weight * (labels - p)) - ridge * (w - prior)
        h = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR: text first, by itself, as a page may have no marks; then what marks add."""
    if not len(rows) or labels.min() == labels.max():
        return PRIOR.copy()
    text = _newton(rows[:, :N_TEXT], labels, np.zeros(len(rows)), PRIOR[:N_TEXT], ridge, steps)
    own = np.clip(rows[:, :N_TEXT] @ text, -MOST_TEXT, MOST_TEXT)
    return np.concatenate([text, _newton(rows[:, N_TEXT:], labels, own, PRIOR[N_TEXT:], ridge, steps)])


def train(pages: DataFrame, most_pages: int = 1000, most_blocks: int = 100) -> np.ndarray:
    n = pages.select("page_id").count()
    if n > most_pages:
        pages = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int((1 << 30) * most_pages / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["html"]:
                blocks = read_blocks(page)
                for b, inside in list(zip(blocks, roots(blocks), strict=True))[:most_blocks]:
                    if inside is not None:
                        rows.append((features(b), float(inside and not b.node.against and not b.node.nested)))
            yield pd.DataFrame(rows, columns=["x", "y"])

    found = pages.select("html").mapInPandas(tidy(run), "x array<double>, y double").collect()
    found.sort(key=lambda r: (r[1], r[0]))
    return fit(np.array([r[0] for r in found]).reshape(-1, N_TEXT + N_MARKS), np.array([r[1] for r in found]))


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost of nodes labelled against their gain plus the weights of edges cut; True: the source side.

    gain > 0 is capacity from the source, gain < 0 capacity to the sink.
    """
    n = len(gain)
    graph: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, w in edges:
        graph[a].append(len(to))
        to.append(b)
        cap.append(w)
        graph[b].append(len(to))
        to.append(a)
        cap.append(w)
    supply = [max(g, 0.0) for g in gain]
    demand = [max(-g, 0.0) for g in gain]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i] > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for v in queue:
            reached = reached or demand[v] > tiny
            for e in graph[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for s in range(n):
            while supply[s] > tiny and level[s] == 0:
                path: list[int] = []
                v = s
                while True:
                    if demand[v] > tiny:
                        flow = min(supply[s], demand[v], *(cap[e] for e in path)) if path else min(supply[s], demand[v])
                        supply[s] -= flow
                        demand[v] -= flow
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                        break
                    while place[v] < len(graph[v]):
                        e = graph[v][place[v]]
                        if cap[e] > tiny and level[to[e]] == level[v] + 1:
                            break
                        place[v] += 1
                    else:
                        level[v] = -2
                        if not path:
                            break
                        v = to[path.pop() ^ 1]
                        place[v] += 1
                        continue
                    path.append(e)
                    v = to[e]
                if level[s] == -2:
                    break


def odds(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Log-odds of each block being content, before its neighbours are heard."""
    x = np.array([features(b) for b in blocks])
    text = np.clip(x[:, :N_TEXT] @ weights[:N_TEXT], -MOST_TEXT, MOST_TEXT)
    marks = x[:, N_TEXT:] @ np.clip(weights[N_TEXT:], MARK_BOUNDS[:, 0], MARK_BOUNDS[:, 1])
    return (text + marks + np.array([structure(b, r) for b, r in zip(blocks, roots(blocks), strict=True)])).tolist()


def label_blocks(blocks: list[Block], weights: np.ndarray, adjacent: float = 0.8, parent: float = 1.2, grandparent: float = 0.5, unlike: float = 0.25) -> list[bool]:
    """unlike: what an edge between elements of another tag or class weighs, against one between like ones."""
    if not blocks:
        return []
    edges = []
    last: dict[tuple, int] = {}

    def edge(a: int, b: int, w: float) -> None:
        x, y = blocks[a], blocks[b]
        same = x.kind == y.kind and (x.node and x.node.like) == (y.node and y.node.like) or {x.kind, y.kind} <= HEADINGS | {"p"}
        marked = [bool(z.node and (z.node.strong or z.node.comments or z.node.against)) or z.announced for z in (x, y)]
        edges.append((a, b, w if same and marked[0] == marked[1] else w * unlike))

    for i, b in enumerate(blocks):
        if i:
            edge(i - 1, i, adjacent)
        up = b.node.up if b.node else None
        for level, w in ((1, parent), (2, grandparent)):
            if up is not None:
                if (level, up.number) in last:
                    edge(last[level, up.number], i, w)
                last[level, up.number] = i
                up = up.up
    return minimum_cut(odds(blocks, weights), edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = read_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights), strict=True) if keep)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    small_batches(pages.sparkSession)
    w = train(pages) if weights is None else weights
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [main_text(p, w) for p in batch["html"]]
            yield out

    return spread(pages.select("page_id", "url", "html")).mapInPandas(tidy(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op10_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
