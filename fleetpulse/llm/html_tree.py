"""Main-text extraction with a tree-structured graphical model.

Every block element and every run of text of a page is a binary variable: content or not. Node
potentials come from its features, edge potentials tie it to its parent. Both are learned by
counting on labelled pages. As the graph is a tree, one pass of sum-product messages up and
one down give exact marginals; the runs that are more likely content than not are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as, map_rows

#: At most so many pages are learned from, taken by a hash of page_id.
SAMPLE = 1000
#: Added to every count, so that nothing unseen is impossible.
SMOOTH = 0.5
#: Share of every value that a feature is given whatever the counts, so that labelled pages of
#: one make do not decide alone; hints are trusted more.
FLOOR, HINT_FLOOR = 0.05, 1e-4

# Elements of HTML that start a new block of text, that have no content, or whose
# content is not text.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label"
    " legend li main menu nav ol optgroup option p pre search section select summary table tbody"
    " td textarea tfoot th thead title tr ul".split()
)
_BREAKS = frozenset(["hr"])
_SPACES = frozenset(["br", "wbr", "img", "input"])
#: An opening element of the first kind ends an open one of the second kind, within its list.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
_KEEPS = frozenset("ul ol dl table select menu".split())
#: Elements whose content is never text.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in ("script", "style")}
#: Elements in which a ``/>`` ends any element, and which blocks other than a title end.
_FOREIGN = frozenset(["svg", "math"])
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    # A start tag whose quote is never closed ends at the next ``>``.
    r"|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TERMS = re.compile(r"[a-z]+")

#: Words in class, id or role that hint at one side; elements that do so by themselves.
_AWAY = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies disqus footer form header menu modal nav"
    " navbar navigation newsletter notice notices pager pagination popup promo related reply"
    " replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar"
    " widget".split()
)
_AWAY_TAGS = frozenset(
    "aside button dialog footer form head header label menu nav option search select textarea"
    " title".split()
)
_MAIN = frozenset("articlebody article content main post entry story".split())
_MAIN_TAGS = frozenset(["article", "main"])
#: Names with these words tell what a page has or a state, not what the element is.
_STATES = frozenset("active disabled enabled has hidden is no not on show with without".split())
#: Elements that hold whatever the page holds: their names say nothing about one side.
_WHOLE = frozenset(["html", "body"])


@dataclass
class Node:
    parent: int
    tag: str
    hint: str
    text: str = ""
    features: list[str] = field(default_factory=list)


def _hint(tag: str, attributes: str, around: str) -> str:
    """The side that the element itself or else the nearest hint around it stands for; the
    header of a main element holds its title. A main element is away only by a whole name."""
    if tag in _WHOLE:
        return around
    terms: set[str] = set()
    for value in _NAMED.findall(attributes) if attributes else ():
        for name in value.lower().strip("\"'").split():
            words = _TERMS.findall(name)
            if tag in _MAIN_TAGS:
                terms.add(name)
            elif not _STATES.intersection(words):
                terms.update(words)
    if tag == "header" and around == "main":
        return "main"
    if tag in _AWAY_TAGS or terms & _AWAY:
        return "away"
    return "main" if tag in _MAIN_TAGS or terms & _MAIN else around


def _hinted(hint: str) -> list[str]:
    return [] if hint == "none" else [f"hint {hint}"]


def parse(page: str) -> list[Node]:
    """The nodes of a page in document order, the root first; text runs are leaves ``#text``."""
    nodes = [Node(-1, "#root", "none")]
    stack, pieces = [0], []
    is_open: Counter = Counter()
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            leaf = Node(stack[-1], "#text", nodes[stack[-1]].hint, text)
            leaf.features = [
                *_hinted(leaf.hint),
                f"in {nodes[stack[-1]].tag}",
                f"size {min(9, int(math.log2(len(text))))}",
                f"linked {min(4, 5 * linked // max(1, len(text)))}",
                f"stop {text[-1] in '.!?:;'}",
            ]
            nodes.append(leaf)
        pieces.clear()
        linked = 0

    def leave(depth: int) -> None:
        is_open.subtract([nodes[at].tag for at in stack[depth:]])
        del stack[depth:]

    def close(tag: str) -> None:
        """Leave the innermost open ``tag``, and what is open in it."""
        if is_open[tag] > 0:
            depth = len(stack) - 1
            while nodes[stack[depth]].tag != tag:
                depth -= 1
            leave(depth)

    def add_text(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            linked += len(text) * bool(in_link)

    at, foreign = 0, ""
    while match := _TOKEN.search(page, at):
        add_text(page[at : match.start()])
        at = match.end()
        raw = match.group(1)
        if raw is not None:
            if not (foreign and match.group(2).endswith("/")):
                at = _RAW_END[raw.lower()].search(page, at).end()
            continue
        name = match.group(4) or match.group(6)
        if name is None:
            continue
        tag, closing = name.lower(), bool(match.group(3))
        attributes = match.group(5) or match.group(7) or ""
        if tag in _FOREIGN:
            if closing:
                foreign = "" if tag == foreign else foreign
            elif not foreign and not attributes.endswith("/"):
                foreign = tag
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag in _SPACES:
            pieces.append(" ")
        elif tag in _BREAKS:
            flush()
        elif tag in _BLOCKS:
            flush()
            in_link = 0
            if closing:
                close(tag)
                continue
            if tag != "title":
                foreign = ""
            if nodes[stack[-1]].tag == "p" and not foreign:
                leave(len(stack) - 1)
            ends = _ENDS.get(tag, ())
            if any(is_open[end] > 0 for end in ends):
                depth = outer = len(stack)
                while depth > 1 and nodes[stack[depth - 1]].tag not in _KEEPS:
                    depth -= 1
                    outer = depth if nodes[stack[depth]].tag in ends else outer
                leave(outer)
            hint = _hint(tag, attributes, nodes[stack[-1]].hint)
            is_open[tag] += 1
            nodes.append(Node(stack[-1], tag, hint, features=[f"tag {tag}", *_hinted(hint)]))
            stack.append(len(nodes) - 1)
    add_text(page[at:])
    flush()
    return nodes


def labels_of(nodes: list[Node], everything: bool = False) -> list[int] | None:
    """Labels that a page's own markup states: inside a main element and outside what is not
    part of it. None if it states none (with ``everything``, the whole page is inside)."""
    labels, inside = [], False
    for node in nodes:
        if node.parent < 0:
            labels.append(int(everything))
        elif node.hint == "away":
            labels.append(0)
        else:
            main = node.tag in _MAIN_TAGS
            inside |= main
            labels.append(1 if main else labels[node.parent])
    return labels if inside or everything else None


def _kind(node: Node) -> str:
    return "top" if node.tag in ("#root", "html", "body") else node.hint


@dataclass
class Model:
    """Shares of features by label, and of child labels by kind and label of the parent."""

    feature: dict[str, tuple[float, float]]
    child: dict[tuple[str, int], tuple[float, float]]

    def _edge(self, kind: str, label: int) -> tuple[float, float]:
        return self.child.get((kind, label), (0.9, 0.1) if label == 0 else (0.1, 0.9))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is content, by messages up and down the tree."""
        up: list[list[float]] = []
        for node in nodes:
            zero = one = 1.0
            for name in node.features:
                shares = self.feature.get(name)
                if shares:
                    zero *= shares[0]
                    one *= shares[1]
            total = zero + one
            up.append([zero / total, one / total])
        kinds = [_kind(node) for node in nodes]
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            parent = nodes[i].parent
            own = up[i]
            message = []
            for label in (0, 1):
                edge = self._edge(kinds[parent], label)
                message.append(edge[0] * own[0] + edge[1] * own[1])
            sent[i] = message[0], message[1]
            above = up[parent]
            zero, one = above[0] * message[0], above[1] * message[1]
            above[0], above[1] = zero / (zero + one), one / (zero + one)
        down: list[tuple[float, float]] = [(0.5, 0.5)] * len(nodes)
        result = []
        for i, node in enumerate(nodes):
            if i:
                parent = node.parent
                rest = [down[parent][s] * up[parent][s] / sent[i][s] for s in (0, 1)]
                total = rest[0] + rest[1]
                no, yes = (self._edge(kinds[parent], s) for s in (0, 1))
                down[i] = tuple(
                    (rest[0] * no[t] + rest[1] * yes[t]) / total for t in (0, 1)
                )
            zero, one = down[i][0] * up[i][0], down[i][1] * up[i][1]
            result.append(one / (zero + one))
        return result

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        likely = self.marginals(nodes)
        kept = [n.text for n, p in zip(nodes, likely, strict=True) if n.text and p >= 0.5]
        return "\n\n".join(kept)


def fit(pages: list[str]) -> Model:
    """Count features and parent-child labels on the pages whose markup labels them; if none
    does, everything that is not marked as beside the text counts as content."""
    parsed = [parse(page) for page in pages]
    labelled = [(n, y) for n in parsed if (y := labels_of(n))]
    labelled = labelled or [(n, labels_of(n, True)) for n in parsed]
    seen: Counter = Counter()
    edges: Counter = Counter()
    totals: Counter = Counter()
    for nodes, labels in labelled:
        for node, label in zip(nodes, labels, strict=True):
            for name in node.features:
                seen[name, label] += 1
                totals[name.split(" ")[0], label] += 1
            if node.parent >= 0:
                edges[_kind(nodes[node.parent]), labels[node.parent], label] += 1
    names = {name for name, _ in seen}
    width = Counter(name.split(" ")[0] for name in names)
    feature = {}
    for name in names:
        group = name.split(" ")[0]
        floor = HINT_FLOOR if group == "hint" else FLOOR
        feature[name] = tuple(
            (1 - floor)
            * (seen[name, label] + SMOOTH)
            / (totals[group, label] + SMOOTH * (width[group] + 1))
            + floor / width[group]
            for label in (0, 1)
        )
    child = {}
    for kind, label in {(kind, label) for kind, label, _ in edges}:
        counts = [edges[kind, label, own] + SMOOTH for own in (0, 1)]
        child[kind, label] = tuple(count / sum(counts) for count in counts)
    return Model(feature, child)


def train(pages: DataFrame) -> Model:
    """Learn from at most ``SAMPLE`` pages; null pages teach nothing, and of rows that share an
    id the first page in order teaches."""
    pages = columns_as(pages, page_id="page_id", html="html").where(F.col("html").isNotNull())
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id")
    found = pages.join(chosen.limit(SAMPLE), "page_id").groupBy("page_id")
    rows = found.agg(F.min("html").alias("html")).collect()
    rows.sort(key=lambda row: (row.page_id, row.html))
    return fit([row.html for row in rows])


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """One row per page: page_id, url, text and its length in code points.

    Null and empty pages have an empty text. Each page is read whole in the task that scans it;
    repeated rows and null ids are kept; other columns are ignored.
    """

    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        texts = [model.text(page) for page in batch.pop("html")]
        return {**batch, "text": texts, "n_chars": [len(text) for text in texts]}

    rows = columns_as(pages, page_id="page_id", url="url", html="html")
    rows = rows.withColumn("page_id", F.col("page_id").cast("long"))
    return map_rows(rows, "page_id long, url string, text string, n_chars long", rows_of)
