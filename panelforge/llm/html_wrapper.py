"""Main text of web pages by wrapper induction over pages of the same host.

Pages of a host are dealt into groups of about `GROUP` pages and `GROUP_BYTES` bytes, so a host
with a third of all pages spreads over many tasks. In a group every page's block tree is aligned
with one reference page by simple tree matching (the heaviest order-preserving matching of
children, equal tags only). A reference node whose content is the same on nearly all different
pages belongs to the template; one whose content varies is a content slot. The text of a page is
what stands in slots or in nodes the reference lacks, inside the article if the page marks one.

Copied pages must not make their text a template. Outside articles, pages of equal content count
once. Inside articles only pages count whose articles differ elsewhere: an article counts if it
shares less than half of its different word pairs with each one counted before.

Elements that hold no article text by their tag (menus, footers, sidebars, forms, scripts,
styles, pop-ups), role or name go in any case, since their text may vary: adverts and reader
comments do. A name counts only if the whole class or id is made of words for boilerplate
(`cookie-notice`, `site-footer`), so `entry-header`, `ad-hoc` or `share-prices` stay.

The matching is exact at every size. A tree's weight against another depends on their shapes
(tags only), so equal shapes are numbered once and each pair of different shapes is weighed once;
equal shapes at the ends of two child lists are matched at once (no matching weighs more), and
the rest by rows of the usual table in linear memory, split in halves to find the pairs.

White space inside a block becomes one space, blocks are joined by a line feed in page order.
Null and empty pages give an empty text. Broken markup is closed where a browser would close
it. Repeated pages are extracted each, and count once as evidence. A page alone in its group
has no template. Rows without a URL form a host of their own. Input columns named like the
results (text, n_chars) are replaced; all others pass through.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.url_filter import host_and_path
from panelforge.sources.staging import stage

GROUP = 128
#: Share of different pages with equal text that makes a template node, and pages needed.
CONSTANT = 0.8
LEAST_PAGES = 5
GROUP_BYTES = 8 << 20
#: An article that shares this much of its word pairs with another is no further evidence.
ALIKE = 0.5
#: Weights of pairs of shapes that are kept between pages.
KEPT_WEIGHTS = 1_000_000

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = frozenset(
    "head title script style noscript template svg iframe object embed canvas audio video nav "
    "footer aside form button select textarea input option datalist dialog menu".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
#: A class or id marks boilerplate if it has one of these words and else only neutral ones.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead "
    "footer sidebar share sharing social comment comments disqus respond".split()
)
#: The same outside an article only.
_OUTER_NAMES = frozenset("header related widget".split())
_NEUTRAL = frozenset(
    "area bar block blog body bottom box buttons col column container content form global google "
    "group icons inner item items label left links list main middle page pages panel post posts "
    "primary reader right row secondary section site slot text thread top unit user users "
    "wrap wrapper".split()
)
#: A start tag closes an open element of these.
_CLOSES = {
    "p": {"p"},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
}
_CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()
)
#: An implied end tag does not reach beyond these.
_SCOPE = frozenset(
    "html body article section div main table td th ul ol dl nav aside header footer form "
    "blockquote".split()
)


class Node:
    """An element; content holds strings and nodes in page order."""

    __slots__ = ("tag", "names", "role", "hidden", "content", "parent", "below", "shape", "same")

    def __init__(self, tag: str, attributes, parent: Node | None) -> None:
        given = {k: v or "" for k, v in attributes}
        self.tag = tag
        self.names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
        self.role = given.get("role", "").lower()
        self.hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "")
        self.content: list[Node | str] = []
        self.parent = parent

    def parts(self) -> list[Node | str]:
        """Block elements right below and the text between them, seen through inline elements."""
        found, todo = [], list(reversed(self.content))
        while todo:
            part = todo.pop()
            if isinstance(part, Node) and part.tag in _INLINE:
                if part.tag in ("br", "wbr"):
                    found.append(" ")
                todo.extend(reversed(part.content))
            elif isinstance(part, str) and found and isinstance(found[-1], str):
                found[-1] += part
            else:
                found.append(part)
        return found


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", (), None)
        self.open = self.root

    def _close(self, tags, scope=frozenset()) -> None:
        node = self.open
        while node.parent is not None:
            if node.tag in tags:
                self.open = node.parent
                return
            if node.tag in scope:
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _SCOPE - _CLOSES[tag])
        elif tag in _CLOSES_P:
            self._close({"p"}, _SCOPE)
        node = Node(tag, attrs, self.open)
        self.open.content.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in _VOID:
            self._close({tag})

    def handle_data(self, data):
        self.open.content.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _named(name: str, in_article: bool) -> bool:
    """Whether a class or id is made of words for boilerplate."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    marks = [w for w in words if w in _NAMES or (w in _OUTER_NAMES and not in_article)]
    return bool(marks) and all(w in _NEUTRAL or w in _NAMES or w in _OUTER_NAMES for w in words)


def _boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in _DROPPED or node.hidden or node.role in _ROLES:
        return True
    if node.tag == "header":
        return not in_article
    if node.tag in ("html", "body", "article", "main"):
        return False
    return any(_named(n, in_article) for n in node.names)


class Forest:
    """Trees of a group, their block nodes numbered by shape (tags) and by content.

    Equal shapes, and equal contents (tags and text), have equal numbers; comparison is of the
    things themselves, not of hashes.
    """

    def __init__(self) -> None:
        self._shapes: dict[tuple, int] = {}
        self._contents: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.has_text: list[bool] = []
        self._weights: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> list[Node]:
        """Number the block nodes of a tree; they are returned in page order, root first."""
        nodes, contents, todo = [], [], [root]
        while todo:
            node = todo.pop()
            found = [] if node.tag in ("script", "style") else node.parts()
            node.below = [p for p in found if isinstance(p, Node)]
            nodes.append(node)
            contents.append(found)
            todo.extend(reversed(node.below))
        for node, found in zip(reversed(nodes), reversed(contents), strict=True):
            below = tuple(n.shape for n in node.below)
            node.shape = self._shapes.setdefault((node.tag, below), len(self._shapes))
            if node.shape == len(self.tags):
                self.tags.append(node.tag)
                self.children.append(below)
                self.sizes.append(1 + sum(self.sizes[k] for k in below))
            lines = (p.same if isinstance(p, Node) else " ".join(p.split()) for p in found)
            parts = tuple(p for p in lines if p != "")
            node.same = self._contents.setdefault((node.tag, parts), len(self._contents))
            if node.same == len(self.has_text):
                self.has_text.append(
                    any(isinstance(p, str) or self.has_text[p] for p in parts)
                )
        return nodes

    def forget(self) -> None:
        """Free the weights when there are many; they are found again when needed."""
        if len(self._weights) > KEPT_WEIGHTS:
            self._weights.clear()

    def _known(self, x: int, y: int) -> int:
        if self.tags[x] != self.tags[y]:
            return 0
        return self.sizes[x] if x == y else self._weights[x, y]

    def weight(self, a: int, b: int) -> int:
        """Size of the heaviest matching of two shapes, 0 if their roots differ."""
        if self.tags[a] == self.tags[b] and a != b:
            todo = [(a, b)]  # pairs below come first, on a stack: depth is not bounded
            while todo:
                x, y = todo[-1]
                if (x, y) in self._weights:
                    todo.pop()
                    continue
                left, right, ends = self._trimmed(self.children[x], self.children[y])
                missing = [
                    (v, w)
                    for v in set(left)
                    for w in set(right)
                    if v != w and self.tags[v] == self.tags[w] and (v, w) not in self._weights
                ]
                if missing:
                    todo.extend(missing)
                    continue
                rest = int(self._row(left, right)[-1]) if left and right else 0
                self._weights[x, y] = 1 + ends + rest
        return self._known(a, b)

    def _trimmed(self, left, right):
        """Lists without equal shapes at both ends, and the size of these."""
        first, last = _equal_ends(left, right)
        ends = sum(self.sizes[k] for k in (*left[:first], *left[len(left) - last :]))
        return left[first : len(left) - last], right[first : len(right) - last], ends

    def _row(self, left, right) -> np.ndarray:
        """Weights of the heaviest matching of left with each prefix of right."""
        kinds, at = np.unique(np.array(right, dtype=np.int64), return_inverse=True)
        gains: dict[int, np.ndarray] = {}
        row = np.zeros(len(right) + 1, dtype=np.int64)
        for x in left:
            if x not in gains:
                gains[x] = np.array([self._known(x, int(y)) for y in kinds])[at]
            best = np.maximum(row[1:], row[:-1] + gains[x])
            np.maximum.accumulate(best, out=row[1:])
        return row

    def _matching(self, left, right) -> list[tuple[int, int]]:
        """Places of a heaviest matching of two lists of shapes."""
        matched, todo = [], [(0, len(left), 0, len(right))]
        while todo:
            i, k, j, m = todo.pop()
            first, last = _equal_ends(left[i:k], right[j:m])
            matched += [(i + d, j + d) for d in range(first)]
            matched += [(k - d, m - d) for d in range(1, last + 1)]
            i, k, j, m = i + first, k - last, j + first, m - last
            if i == k or j == m:
                continue
            if k - i == 1:
                gains = [self.weight(left[i], y) for y in right[j:m]]
                if max(gains):
                    matched.append((i, j + gains.index(max(gains))))
                continue
            half = (i + k) // 2
            before = self._row(left[i:half], right[j:m])
            after = self._row(left[half:k][::-1], right[j:m][::-1])[::-1]
            cut = j + int(np.argmax(before + after))
            todo += [(i, half, j, cut), (half, k, cut, m)]
        return matched

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Matched (node of a, node of b) of two numbered trees, roots included."""
        matched, todo = [], [(a, b)] if a.tag == b.tag else []
        while todo:
            x, y = todo.pop()
            matched.append((x, y))
            self.weight(x.shape, y.shape)
            left, right = [n.shape for n in x.below], [n.shape for n in y.below]
            if x.shape == y.shape:
                todo += zip(x.below, y.below, strict=True)
                continue
            todo += [(x.below[i], y.below[j]) for i, j in self._matching(left, right)]
        return matched


def _equal_ends(left, right) -> tuple[int, int]:
    """How many shapes are equal at the start, and then at the end, of two lists."""
    short = min(len(left), len(right))
    first = 0
    while first < short and left[first] == right[first]:
        first += 1
    last = 0
    while last < short - first and left[-1 - last] == right[-1 - last]:
        last += 1
    return first, last


def _word_pairs(nodes: list[Node]) -> set[tuple[str, ...]]:
    """Different pairs of neighbouring words in the blocks' own text."""
    words = " ".join(p for n in nodes for p in n.parts() if isinstance(p, str)).split()
    return set(zip(words, words[1:], strict=False)) or {tuple(words)} - {()}


def _different(articles: dict[int, set[tuple[str, ...]]]) -> set[int]:
    """Pages with an article (given by its word pairs) unlike all those before."""
    counted: set[int] = set()
    holders: dict[tuple[str, ...], list[int]] = {}
    for k, pairs in sorted(articles.items()):
        shared: dict[int, int] = {}
        for pair in pairs:
            for other in holders.get(pair, ()):
                shared[other] = shared.get(other, 0) + 1
        if pairs and max(shared.values(), default=0) < ALIKE * len(pairs):
            counted.add(k)
            for pair in pairs:
                holders.setdefault(pair, []).append(k)
    return counted


def template_nodes(trees: list[Node], constant: float, least_pages: int) -> list[set[int]]:
    """For each tree the ids of its nodes that belong to the template of all."""
    forest = Forest()
    nodes = [forest.add(tree) for tree in trees]
    distinct: dict[int, int] = {}
    for k, tree in enumerate(trees):
        distinct.setdefault(tree.same, k)
    if len(distinct) < least_pages:
        return [set() for _ in trees]
    pages = set(distinct.values())
    inside = [_inside_articles(tree) for tree in trees]
    articles = _different(
        {k: _word_pairs([n for n in nodes[k] if id(n) in inside[k]]) for k in pages}
    )
    reference = _reference(forest, nodes, pages)
    alignments = []
    for tree in trees:
        alignments.append(forest.pairs(trees[reference], tree))
        forest.forget()
    seen: dict[int, int] = {}
    same: dict[int, int] = {}
    for k in pages:
        for a, b in alignments[k]:
            if id(a) in inside[reference] and k not in articles:
                continue
            seen[id(a)] = seen.get(id(a), 0) + 1
            same[id(a)] = same.get(id(a), 0) + (a.same == b.same)
    fixed = {k for k, n in seen.items() if n >= least_pages and same[k] >= constant * n}
    return [
        {id(b) for a, b in pairs if id(a) in fixed and a.same == b.same and forest.has_text[a.same]}
        for pairs in alignments
    ]


def _reference(forest: Forest, nodes: list[list[Node]], pages: set[int]) -> int:
    """The page whose contents stand on most other pages; the first of equals."""
    spread: dict[int, int] = {}
    found = {k: {n.same for n in nodes[k] if forest.has_text[n.same]} for k in pages}
    for contents in found.values():
        for content in contents:
            spread[content] = spread.get(content, 0) + 1
    return max(sorted(pages), key=lambda k: sum(spread[c] - 1 for c in found[k]))


def _inside_articles(tree: Node) -> set[int]:
    """Ids of the block nodes in articles that are not boilerplate by tag, role or name."""
    found: set[int] = set()
    todo = _articles(tree)
    while todo:
        node = todo.pop()
        found.add(id(node))
        todo += [n for n in node.below if not _boilerplate(n, True)]
    return found


def _articles(root: Node) -> list[Node]:
    """Outermost article and main elements outside boilerplate, in page order."""
    found, todo = [], list(reversed(root.content))
    while todo:
        part = todo.pop()
        if isinstance(part, Node) and not _boilerplate(part, False):
            if part.tag in ("article", "main"):
                found.append(part)
            else:
                todo.extend(reversed(part.content))
    return found


def _read(node: Node, template: set[int], in_article: bool, blocks: list[list[str]]) -> None:
    # None on the stack ends a block
    todo: list[Node | str | None] = list(reversed(node.content))
    while todo:
        part = todo.pop()
        if part is None:
            blocks.append([])
        elif isinstance(part, str):
            blocks[-1].append(part)
        elif _boilerplate(part, in_article) or id(part) in template:
            if part.tag not in _INLINE:
                blocks.append([])
        elif part.tag in _INLINE:
            if part.tag in ("br", "wbr"):
                blocks[-1].append(" ")
            todo.extend(reversed(part.content))
        else:
            blocks.append([])
            todo.append(None)
            todo.extend(reversed(part.content))


def main_text(tree: Node, template: set[int]) -> str:
    articles = _articles(tree)
    blocks: list[list[str]] = [[]]
    for root in articles or [tree]:
        blocks.append([])
        _read(root, template, bool(articles), blocks)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_group(
    pages: list[str | None], constant: float = CONSTANT, least_pages: int = LEAST_PAGES
) -> list[str]:
    """Main texts of pages of one host."""
    trees = [parse(p) for p in pages]
    templates = template_nodes(trees, constant, least_pages)
    return [main_text(t, found) for t, found in zip(trees, templates, strict=True)]


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    group: int = GROUP,
    group_bytes: int = GROUP_BYTES,
    constant: float = CONSTANT,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """pages without html, with text and n_chars."""
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html)]
    host = host_and_path(F.col(url))[0]
    sizes = pages.groupBy(host.alias("__host")).agg(
        F.count("*").alias("__count"), F.sum(F.octet_length(html)).alias("__bytes")
    )
    parts = F.greatest(
        F.ceil(F.col("__count") / group), F.ceil(F.coalesce("__bytes", F.lit(0)) / group_bytes)
    )
    hot = stage(
        sizes.select("__host", parts.cast("int").alias("__parts")).where("__parts > 1"), "hosts"
    )
    dealt = (
        pages.select(*[f.name for f in kept], F.col(html).alias("__html"))
        .withColumn("__host", host)
        .join(hot, "__host", "left")
        .withColumn(
            "__part",
            F.pmod(F.xxhash64(F.col(page_id).cast("string")), F.coalesce("__parts", F.lit(1))),
        )
        .drop("__parts")
    )
    schema = T.StructType(
        [*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    names = [f.name for f in kept]

    def induce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([page_id, "__html"], kind="stable", na_position="last")
        texts = extract_group(
            [h if isinstance(h, str) else None for h in rows["__html"]], constant, least_pages
        )
        out = rows[names].copy()
        out["text"] = texts
        out["n_chars"] = [len(t) for t in texts]
        return out

    return dealt.groupBy("__host", "__part").applyInPandas(induce, schema)
