"""Main text of web pages: flat text blocks, classified by a decision tree over their and their neighbours' densities.

A page is cut into blocks of text at block-level tags. Blocks in elements that aren't the article's by their kind or name
(menus, footers, forms, adverts, comments) go first. Every other block is described by its words and the share of them in
links, by the same of the blocks before and behind it, and by whether it has a doubtful name (such as an "alert" inside an
article). The tree over these is grown from the small labelled table below.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import release, without

# Names of HTML elements by their part in a page.
RAW = {"script", "style", "template", "noscript", "iframe", "noframes", "textarea", "title", "svg", "math", "object", "canvas"}
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("html body head div section article main nav header footer aside form ul ol dl table figure dialog menu details fieldset blockquote select button p li".split())
OUTSIDE = set("head nav footer aside form dialog menu button select fieldset search".split())
# Words of class, id and role that mark parts beside the article.
MARKS = set("ad adbox ads adsense adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted promotion related reply replies respond share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar widget widgets alert contentinfo complementary search".split())
# Of these, words that inside an article only make a part doubtful.
DOUBTFUL = set("alert banner notice notices notification search toolbar widget widgets".split())
ABOUT = set("with without has have no wrapper wrap layout container".split())  # such a name speaks of what is inside
OF_ARTICLE = set("article entry post story content page".split())

# Quotes are honoured until a tag's quotes don't close; from there on a tag ends at the next >.
QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
LEGAL = re.compile(r"(?i)©|copyright\s*(?:©|\(c\)|[0-9]{4})")
MARKED = re.compile(r"""(?is)(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# The labelled table: words, link share, words and link share of the block before and of the block behind (0 words: none),
# doubtful name; label 1 main text, 0 not.
LABELLED = [
    # menus, link lists, and what stands between links
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0), (5, 0.8, 4, 1.0, 3, 1.0, 0, 0), (3, 1.0, 2, 1.0, 9, 0.0, 0, 0),
    (6, 0.9, 70, 0.0, 5, 1.0, 0, 0), (11, 1.0, 60, 0.0, 12, 1.0, 0, 0), (12, 1.0, 14, 1.0, 11, 1.0, 0, 0), (13, 1.0, 12, 1.0, 40, 0.0, 0, 0), (12, 1.0, 11, 1.0, 0, 0.0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0), (12, 1.0, 11, 1.0, 80, 0.0, 0, 0),
    (30, 0.9, 20, 0.9, 25, 1.0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0), (4, 0.0, 2, 1.0, 5, 0.9, 0, 0), (9, 0.5, 2, 1.0, 2, 1.0, 0, 0), (7, 0.0, 3, 1.0, 0, 0.0, 0, 0), (4, 0.0, 2, 1.0, 0, 0.0, 0, 0), (9, 0.0, 1, 1.0, 0, 0.0, 0, 0), (12, 0.0, 4, 1.0, 0, 0.0, 0, 0),
    (4, 0.0, 60, 0.0, 12, 1.0, 0, 0), (3, 0.0, 25, 0.0, 3, 1.0, 0, 0), (2, 1.0, 0, 0.0, 8, 0.0, 0, 0), (9, 0.9, 0, 0.0, 40, 0.0, 0, 0), (3, 1.0, 40, 0.0, 0, 0.0, 0, 0),
    # headings and paragraphs
    (8, 0.0, 2, 1.0, 60, 0.0, 0, 1), (8, 0.0, 1, 1.0, 5, 0.0, 0, 1), (1, 0.0, 1, 1.0, 12, 0.0, 0, 1), (6, 0.0, 45, 0.0, 70, 0.0, 0, 1), (55, 0.0, 8, 0.0, 60, 0.0, 0, 1),
    (40, 0.0, 3, 0.0, 60, 0.0, 0, 1), (30, 0.05, 50, 0.0, 45, 0.0, 0, 1), (18, 0.0, 40, 0.1, 35, 0.0, 0, 1), (1, 0.0, 60, 0.0, 70, 0.0, 0, 1), (2, 0.0, 0, 0.0, 1, 0.0, 0, 1),
    (1, 0.0, 3, 0.0, 2, 0.0, 0, 1), (5, 0.0, 3, 0.0, 6, 0.0, 0, 1), (120, 0.05, 40, 0.0, 3, 0.0, 0, 1), (30, 0.2, 90, 0.0, 15, 0.0, 0, 1), (400, 0.01, 9, 0.0, 12, 0.0, 0, 1),
    (4, 0.25, 50, 0.0, 60, 0.0, 0, 1), (10, 1.0, 60, 0.0, 50, 0.0, 0, 1), (2, 1.0, 30, 0.0, 40, 0.1, 0, 1), (5, 0.0, 40, 0.0, 14, 0.0, 0, 1), (5, 0.0, 40, 0.0, 0, 0.0, 0, 1),
    (30, 0.0, 50, 0.0, 0, 0.0, 0, 1), (160, 0.02, 3, 1.0, 4, 1.0, 0, 1), (75, 0.1, 60, 0.0, 2, 1.0, 0, 1), (14, 0.0, 30, 0.0, 3, 1.0, 0, 1), (25, 0.0, 1, 1.0, 2, 1.0, 0, 1),
    (70, 0.0, 2, 1.0, 0, 0.0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1), (6, 0.4, 30, 0.0, 20, 0.0, 0, 1),
    (7, 0.0, 40, 0.0, 0, 0.0, 0, 1), (7, 0.0, 20, 0.0, 30, 0.0, 0, 1), (4, 0.0, 30, 0.0, 12, 0.0, 0, 1), (12, 0.0, 70, 0.0, 0, 0.0, 0, 1), (9, 0.0, 60, 0.0, 8, 0.0, 0, 1), (12, 0.0, 6, 0.0, 30, 0.0, 0, 1), (7, 0.0, 2, 1.0, 45, 0.0, 0, 1),
    # blocks of a doubtful name
    (6, 0.0, 40, 0.0, 30, 0.0, 1, 0), (12, 0.2, 60, 0.0, 50, 0.0, 1, 0), (3, 1.0, 30, 0.0, 40, 0.0, 1, 0), (15, 0.0, 60, 0.0, 0, 0.0, 1, 0), (9, 0.0, 8, 0.0, 12, 0.0, 1, 0),
    (45, 0.0, 50, 0.0, 40, 0.0, 1, 1), (30, 0.05, 40, 0.0, 20, 0.0, 1, 1), (80, 0.0, 8, 0.0, 30, 0.0, 1, 1), (26, 0.0, 35, 0.0, 0, 0.0, 1, 1),
]


@dataclass
class Tree:
    """A grown decision tree: a leaf's label, or a feature, its bound and the trees for values up to it and above."""

    label: int
    feature: int = -1
    bound: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def __call__(self, row: list[float]) -> int:
        node = self
        while node.low and node.high:
            node = node.low if row[node.feature] <= node.bound else node.high
        return node.label


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """The tree that greedily lowers Gini impurity; ties go to the first feature and the lowest bound."""
    node = Tree(int(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node
    best = (1e9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= bound
            cost = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            best = min(best, (round(float(cost), 9), f, float(bound)))
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    return Tree(node.label, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def trained() -> Tree:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


BESIDE, ANYWHERE, IN_ARTICLE, DOUBTFUL_PART = range(4)  # kinds of parts of a page


@dataclass
class Block:
    text: str
    words: int
    links: float
    beside: bool = False
    doubtful: bool = False



def _names(attributes: str) -> list[set[str]]:
    """The words of each class, id and role."""
    names = " ".join(m[1] or m[2] or m[3] or "" for m in MARKED.finditer(attributes)).lower().split()
    return [set(re.split(r"[-_]+", name)) for name in names]


def _part(tag: str, attributes: str, outer: int) -> int:
    """The kind of part that an element opens inside another: BESIDE, ANYWHERE, IN_ARTICLE or DOUBTFUL_PART."""
    if outer == BESIDE or tag in OUTSIDE or tag == "header" and outer == ANYWHERE:
        return BESIDE
    if tag in ("html", "body"):
        return ANYWHERE
    names = _names(attributes)
    marks = [words & MARKS for words in names if not words & ABOUT and not (words & OF_ARTICLE and "header" in words)]
    if any(marks):
        return DOUBTFUL_PART if outer != ANYWHERE and not any(m - DOUBTFUL for m in marks) else BESIDE
    return IN_ARTICLE if outer == ANYWHERE and (tag in ("article", "main") or any(words & (OF_ARTICLE - {"page"}) for words in names)) else outer


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks in page order, character references decoded and white space made single spaces."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []  # open containers and the kind of part inside
    parts: list[str] = []
    linked: list[str] = []
    link_depth, part = 0, ANYWHERE

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = len(text.split(" "))
            links = min(1.0, len(html.unescape(" ".join(linked)).split()) / words)
            found.append(Block(text, words, links, part == BESIDE or bool(LEGAL.match(text)), part == DOUBTFUL_PART))
        parts.clear()
        linked.clear()

    def write(piece: str) -> None:
        parts.append(piece)
        if link_depth:
            linked.append(piece)

    at, size, pattern = 0, len(page), QUOTED
    opened: Counter[str] = Counter()
    while at < size:
        tag_at = page.find("<", at)
        if tag_at != at:
            write(page[at : tag_at if tag_at >= 0 else size])
            at = tag_at if tag_at >= 0 else size
            continue
        follows = page[at + 1 : at + 3]
        if follows[:1] in ("!", "?"):
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + 2)
            at = end + len(mark) if end >= 0 else size
            continue
        if not follows.lstrip("/")[:1].isascii() or not follows.lstrip("/")[:1].isalpha():
            write("<")
            at += 1
            continue
        m = pattern.match(page, at)
        if not m and pattern is QUOTED:
            pattern = PLAIN
            m = pattern.match(page, at)
        if not m:  # no tag ends any more: a page that was cut off
            break
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"(?i)</{tag}\s*>").search(page, at)
                at = end.end() if end else size
            if tag != "title":
                parts.append(" ")
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        link_depth = 0
        if tag in CONTAINERS and tag not in ("p", "li"):
            if closing:
                while opened[tag]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
            else:
                if tag == "body":
                    stack.clear()
                    opened.clear()
                stack.append((tag, _part(tag, m[3], stack[-1][1] if stack else ANYWHERE)))
                opened[tag] += 1
            part = stack[-1][1] if stack else ANYWHERE
    close()
    return found


def main_text(page: str, tree: Tree) -> str:
    """The blocks that the tree takes for main text, one on a line."""
    every = [b for b in blocks(page) if not b.beside]
    edge = Block("", 0, 0.0)
    around = [edge, *every, edge]
    kept = []
    for before, block, behind in zip(around, every, around[2:], strict=False):
        if tree([block.words, block.links, before.words, before.links, behind.words, behind.links, block.doubtful]):
            kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: its columns, then text and n_chars (code points).

    A null or empty page, and one without main text, gives the empty text. The whole page is read, however long, in one task.
    Repeated rows come out each; an empty table gives an empty one; input columns named text or n_chars are replaced. Only the
    html goes to Python.
    """
    tree = trained()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py() or "", tree) for p in pages], pa.string())
            release()

    found = pages.select(*[F.col(f"`{c}`") for c in without(pages, ["text", "n_chars"])], text("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
