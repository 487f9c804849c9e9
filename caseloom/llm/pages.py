"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text, tolerant of missing end tags.  Its
text falls into blocks; every block has the path of block-level tags (with
class and id) from the root to it.  For each path the text length and the
punctuation of all its blocks are added up and divided by their number.  Both
ratios are smoothed over similar paths (a Gaussian of the steps by which two
paths differ beyond what they share) and fused by their product; a path below
an element whose class, id or role names something beside the content, or
beside the article element of a page that has one, counts for a share of it
only.  Paths from LAMBDA of the mean score on, weighted by
text, are content.  Headings, lists, tables and the like go with the content
of their container whatever their score, as does all else in an article, and
an h1 with content close by.  Elements that are by definition menus, footers,
sidebars, forms, dialogs or page headers hold none.

Cases: a null, empty or text-free page gives an empty text; a page without
tags is one block; unclosed comments, tags and scripts run to the end; very
long or deep pages are read in linear time, and all paths are smoothed over
those within NEAR edits by sums at shared ancestors; repeated rows each give theirs; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing, in steps of a path; the share of the mean score that content has; what a score counts below a name of BAD_PARTS, or beside the article element.
SIGMA, LAMBDA, WEAK = 0.8, 0.5, 0.1
#: Steps beyond which a weight (under 1e-16) counts as nothing.
NEAR = 7

#: Elements by their role in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp svg math object select button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that belong to what holds them.
PARTS = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre p figure figcaption".split())
NOT_CONTENT = frozenset("nav footer aside form head menu dialog".split())
#: Elements that a start tag of the first closes, up to the second.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Parts of class names, ids and roles of what is beside the content, and parts that say otherwise of a name.
BAD_PARTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs footer sidebar aside widget notice notices cookie cookies consent gdpr popup modal overlay alert comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar contentinfo complementary dialog masthead logo branding copyright".split()
)
GOOD_PARTS = frozenset("article body content entry main post story text work".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…、。，！？；：]")


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, "") in order; comments and raw elements are left out."""
    at, last = 0, html.rfind(">")
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        sign = html[lt + 1 : lt + 2]
        if sign in ("!", "?"):
            end = html.find(">", lt)
            at = len(html) if end < 0 else end + 1
            continue
        if not (sign.isascii() and sign.isalpha() or sign == "/" and html[lt + 2 : lt + 3].isalpha()):
            yield "text", "<", ""
            at = lt + 1
            continue
        if lt > last:
            return
        tag = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if tag is None:
            return
        name, at = tag[2].lower(), tag.end()
        if tag[1]:
            yield "end", name, ""
            continue
        if name in RAW and not tag[3].endswith("/"):
            end = _RAW_END[name].search(html, at)
            stop = len(html) if end is None else html.find(">", end.end() - 1) + 1 or len(html)
            at = stop
            continue
        yield "start", name, tag[3]
        if tag[3].endswith("/") and name not in EMPTY and name not in BLOCKS:
            yield "end", name, ""


class Node:
    """An open element: its name, the path to it, and whether it can hold content."""

    __slots__ = ("name", "path", "block", "content", "article")

    def __init__(self, name: str, path: int, block: str, content: bool, article: bool):
        self.name, self.path, self.block, self.content, self.article = name, path, block, content, article


class Paths:
    """The distinct paths of a page by number; a parent's number is less than its child's, the empty path is 0."""

    def __init__(self) -> None:
        self.parent, self.name, self.depth, self.article, self.weak = [0], [""], [0], [False], [False]
        self._known: dict[tuple[int, str], int] = {}

    def step(self, parent: int, name: str, marks: list[str], article: bool, weak: bool) -> int:
        key = (parent, ".".join([name, *marks]))
        if key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(parent)
            self.name.append(name)
            self.depth.append(self.depth[parent] + 1)
            self.article.append(article)
            self.weak.append(weak or self.weak[parent])
        return self._known[key]


def _beside(value: str, article: bool) -> bool:
    """Whether a class, id or role names something beside the content."""
    for word in value.split():
        parts = {p.lower() for p in _PART.findall(word)}
        if not parts & GOOD_PARTS and (parts & BAD_PARTS or "header" in parts and not article):
            return True
    return False


def _opened(name: str, attributes: str, parent: Node, paths: Paths) -> Node:
    marks, weak = [], False
    content, article = parent.content, parent.article or name in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value = m[2] or m[3] or m[4] or ""
        weak = weak or name not in ("html", "body", "article", "main") and _beside(value, article)
        if m[1].lower() != "role":
            marks.append(re.sub(r"\d+", "#", value))
    if name in NOT_CONTENT or name == "header" and not article:
        content = False
    if name not in BLOCKS:
        return Node(name, parent.path, parent.block, content, article)
    return Node(name, paths.step(parent.path, name, marks, article, weak), name, content, article)


def blocks(html: str) -> tuple[Paths, list[tuple[int, bool, str, str]]]:
    """The page's paths, and (path, can be content, element, text) of each block with text, in page order."""
    paths = Paths()
    stack = [Node("", 0, "", True, False)]
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack
    held: list[str] = []
    out = []

    def close_block() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((stack[-1].path, stack[-1].content, stack[-1].block, text))
            held.clear()

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def pop_to(index: int) -> None:
        if any(n.name in BLOCKS for n in stack[index:]):
            close_block()
        for n in stack[index:]:
            places[n.name].pop()
        del stack[index:]

    def close(names: str, until: str) -> None:
        """Closes the innermost open element among names, unless one among until is nearer."""
        at = last(names.split())
        if at and at >= last(until.split()):
            pop_to(at)

    for kind, name, attributes in events(html):
        if kind == "text":
            held.append(name)
        elif kind == "end":
            if name == "br":
                held.append(" ")
                continue
            at = last((name,))
            if at and (name in BLOCKS or at > last(("table", "article", "main", "body"))):
                pop_to(at)
        elif name in EMPTY:
            if name == "hr":
                close_block()
            else:
                held.append(" " if name == "br" else "")
        else:
            if name in BLOCKS:
                if name in CLOSES:
                    close(*CLOSES[name])
                close("p", "article main section div td th li body table blockquote")
                close_block()
            places.setdefault(name, []).append(len(stack))
            stack.append(_opened(name, attributes, stack[-1], paths))
    close_block()
    return paths, out


def _smoothed(paths: Paths, ratio: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """The ratios, averaged over all paths by distance: the edits from the first step in which two paths differ."""
    sums: dict[tuple[int, int], list[float]] = {}  # by ancestor and depth: number, both ratios
    for p, (length, marks) in ratio.items():
        at, depth = p, paths.depth[p]
        for _ in range(min(NEAR, depth) + 1):
            s = sums.setdefault((at, depth), [0.0, 0.0, 0.0])
            s[0] += 1
            s[1] += length
            s[2] += marks
            at = paths.parent[at]
    weights = [math.exp(-((d / SIGMA) ** 2) / 2) for d in range(NEAR + 1)]
    none = (0.0, 0.0, 0.0)
    out = {}
    for p in ratio:
        at, under, depth = p, -1, paths.depth[p]
        total = [0.0, 0.0, 0.0]
        for shared in range(depth, max(0, depth - NEAR) - 1, -1):
            for other in range(shared, shared + NEAR + 1):
                if found := sums.get((at, other)):
                    inner = sums.get((under, other), none)
                    w = weights[max(depth, other) - shared]
                    for j in range(3):
                        total[j] += w * (found[j] - inner[j])
            at, under = paths.parent[at], at
        out[p] = (total[1] / total[0], total[2] / total[0])
    return out


def scores(paths: Paths, found: list[tuple[int, bool, str, str]]) -> dict[int, tuple[float, float]]:
    """(fused score, text length) of each path that has blocks which can be content."""
    sums: dict[int, list[float]] = {}
    for path, content, _, text in found:
        if content:
            s = sums.setdefault(path, [0.0, 0.0, 0.0])
            s[0] += len(text)
            s[1] += len(_PUNCTUATION.findall(text))
            s[2] += 1
    ratio = {p: (s[0] / s[2], (1 + s[1]) / s[2]) for p, s in sums.items()}
    marked = any(paths.article[p] for p in sums)
    prior = {p: (WEAK if paths.weak[p] else 1.0) * (WEAK if marked and not paths.article[p] else 1.0) for p in sums}
    return {p: (prior[p] * math.log1p(length) * math.log1p(marks), sums[p][0]) for p, (length, marks) in _smoothed(paths, ratio).items()}


def content_paths(paths: Paths, found: list[tuple[int, bool, str, str]]) -> set[int]:
    """The paths whose blocks are content."""
    score = scores(paths, found)
    if not score:
        return set()
    least = LAMBDA * sum(s * n for s, n in score.values()) / sum(n for _, n in score.values())
    kept = {p for p, (s, _) in score.items() if s >= least}
    inside = {paths.parent[p] for p in kept}
    around = inside | {paths.parent[p] for p in inside}
    part = [False] * len(paths.parent)  # whether a path goes with a container of content
    for p in range(1, len(part)):
        up, name = paths.parent[p], paths.name[p]
        if paths.weak[p] and not paths.weak[up]:
            continue
        part[p] = (up in inside or part[up]) and (name in PARTS or paths.article[up]) or name in HEADINGS and up in inside
        part[p] = part[p] or name == "h1" and not paths.weak[p] and (up in around or paths.parent[up] in around)
    return kept | {p for p in score if part[p]}


def main_text(html: str) -> str:
    """The page's content blocks, joined by empty lines."""
    paths, found = blocks(html)
    kept = content_paths(paths, found)
    return "\n\n".join(text for path, content, _, text in found if content and path in kept)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The key columns, text and n_chars (code points) of each page."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "text", "n_chars"])

    kinds = [f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys]
    return pages.select(*keys, html_col).mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
