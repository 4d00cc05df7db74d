"""Main text of web pages by wrapper induction per host.

A wrapper is learnt from all pages of a host, copies left out, in two steps:

* Structure. The trees of blocks of all pages, each different tree once, are merged in groups of ``FAN``, the results again,
  until a host has one. Simple tree matching aligns the children of matched nodes, in order and so that the most nodes
  match; what finds no partner is inserted. Left out before are blocks that neither can become template nor stand beside
  such: only where the same labels from the root down bear the same text on ``SUPPORT`` pages there may be template.
* Counts. Every tree is aligned with the merged one, and Spark counts the pages of each node and of each text in it. A text that
  ``SAME`` of a node's pages have is template, if the node is on ``SUPPORT`` pages and on ``SHARE`` of those with its parent; other
  text is a slot.

Every page is aligned with the wrapper of its host in the same way. Its content is where the slots are: the <article>s or
<main>s that hold some, else the node that holds most of the slots' text. Template is left out there, if the page
has that very text; headings always stay, and what stands in an <article> or
<main> stays unless pages of the host have the same text outside of these. Menus, headers, footers, sidebars, notices,
adverts, forms and comments are known by element, or by names that say nothing else.
"""

from __future__ import annotations

import html as html_lib
import math
import pickle
import re
import sys
from collections import Counter
from collections.abc import Container, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import exact_id
from spanloom.llm.urls import url_host
from spanloom.plans.scale import fits_broadcast, keyed_join, lookup_join
from spanloom.session import as_table

#: Pages that must bear a text to make it template; its least share of the pages of its node, and the node's of those of its parent.
SUPPORT, SAME, SHARE = 3, 0.9, 0.375
#: Trees merged in one group, on average.
FAN = 32
#: Wrappers, and alignments of trees with them, that a task keeps at once.
HELD_HOSTS, HELD_TREES = 200, 5000
#: Pairs of children up to which the table that aligns them is held whole; beyond, some of its rows at a time, and weights of so many pairs.
TABLE, WEIGHTS = 1 << 16, 1 << 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr data".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never content; a <header> inside an article is part of it.
SKIP_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg button select textarea title menu dialog object canvas audio video input label fieldset".split())
#: Words of class, id and role that mark such parts, if all other words beside them are neutral ones.
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments reply replies disqus respond "
    "related recommended share sharing social footer masthead topbar toolbar widget pagination pager copyright".split())
NEUTRAL = SKIP_WORDS | frozenset(
    "box wrapper wrap container list block area section bar post posts form inner outer group item items panel text top bottom left right center centre "
    "row col column main site page header side search legal links link buttons button icons message".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored".split())
CONTENT = frozenset(["article", "main"])
ROOTS = frozenset(["html", "body", "article", "main", "#root"])
#: A start tag on the left closes open elements on the right, up to the nearest of ``SCOPE``.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article main section body html nav aside header footer form blockquote".split())

#: A comment, a tag (attributes may hold ">" in quotes), a tag with a stray quote, or a declaration.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element; ``items`` holds its text pieces and child elements in page order."""

    __slots__ = ("tag", "names", "items", "mark")

    def __init__(self, tag: str, names: frozenset = frozenset()):
        self.tag, self.names, self.items, self.mark = tag, names, [], None

    @property
    def label(self) -> str:
        """Tag and names; words with digits are left out, as those of ids like post-123 differ from page to page."""
        return " ".join([self.tag, *sorted(w for w in self.names if w.isalpha())])

    @property
    def skipped(self) -> bool:
        if self.tag in SKIP_TAGS:
            return True
        words = {w for w in self.names if w.isalpha()}
        if not words or self.tag in HEADINGS or self.tag in ROOTS and self.tag not in CONTENT or SKIP_WORDS.isdisjoint(words):
            return False
        return words <= (ADVERTS if self.tag in INLINE else NEUTRAL)


def parse(page: str) -> Node:
    """A tree of any text: unclosed elements are closed where their parent ends, stray end tags are passed over."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at:m.start()])
        at = m.end()
        shift = 3 if m.group(2) is None else 0
        tag = m.group(2 + shift)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1 + shift):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag == "p" and stack[k].tag in SCOPE or tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        rest = m.group(3 + shift)
        names = frozenset(w for n in _NAMES.finditer(rest) for w in _WORD.findall((n.group(2) or n.group(3) or n.group(4) or "").lower())) if rest else frozenset()
        if tag not in INLINE and tag not in RAW:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                elif stack[k].tag in SCOPE:
                    break
        node = Node(tag, names)
        stack[-1].items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.items.append(page[at:close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)
    return root


# ---- trees of blocks ----

def _digest(text: str) -> int:
    """A hash in the range of BIGINT."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def own_text(node: Node) -> str:
    """Text of a node with that of its inline children, but for skipped ones."""
    out: list[str] = []
    stack = node.items[::-1]
    while stack:
        i = stack.pop()
        if isinstance(i, str):
            out.append(i)
        elif i.tag in INLINE:
            if not i.skipped:
                stack.extend(reversed(i.items))
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def _blocks(node: Node) -> Iterator[Node]:
    """Block children, also those inside inline children that are not skipped."""
    stack = node.items[::-1]
    while stack:
        i = stack.pop()
        if not isinstance(i, str):
            if i.tag not in INLINE:
                yield i
            elif not i.skipped:
                stack.extend(reversed(i.items))


class Part:
    """A block of a page, or a node of a wrapper; ``text`` is the hash of its own text, 0 without any, None if it varies."""

    __slots__ = ("label", "text", "kids", "size", "shape", "support", "node", "place")

    def __init__(self, label: str, text: int | None, node: Node | None = None, support: int = 0, place: int = -1):
        self.label, self.text, self.kids, self.node, self.support, self.place = label, text, [], node, support, place

    def in_order(self) -> list[Part]:
        """This and all below, parents first."""
        out, stack = [], [self]
        while stack:
            part = stack.pop()
            out.append(part)
            stack.extend(reversed(part.kids))
        return out

    def measure(self) -> Part:
        """Size and shape (equal for trees of equal labels) of all parts."""
        for part in reversed(self.in_order()):
            part.size = 1 + sum(k.size for k in part.kids)
            part.shape = hash((part.label, *[k.shape for k in part.kids]))
        return self


def blocks_of(root: Node) -> Part:
    """The blocks of a page outside skipped parts."""
    def part(node):
        text = own_text(node)
        return Part(node.label, _digest(text) if text else 0, node)

    top = part(root)
    stack = [top]
    while stack:
        at = stack.pop()
        at.kids = [part(c) for c in _blocks(at.node) if not c.skipped]
        stack.extend(at.kids)
    return top.measure()


# ---- simple tree matching ----

def matching(a: Part, b: Part, memo: dict) -> int:
    """Size of the largest matching of two trees: labels agree, parents match, and children keep their order."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    if (key := (id(a), id(b))) not in memo:
        memo[key] = 1 + sum(matching(a.kids[i], b.kids[j], memo) for i, j in aligned(a.kids, b.kids, memo))
    return memo[key]


def aligned(x: Sequence[Part], y: Sequence[Part], memo: dict) -> list[tuple[int, int]]:
    """The pairs (places in x and y) of the best order-keeping alignment of two lists of children."""
    head = 0
    while head < min(len(x), len(y)) and x[head].shape == y[head].shape:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    both = {k.label for k in x[head:len(x) - tail]} & {k.label for k in y[head:len(y) - tail]}  # others match nothing
    left = [i for i in range(head, len(x) - tail) if x[i].label in both]
    right = [j for j in range(head, len(y) - tail) if y[j].label in both]
    m, n = len(left), len(right)
    if m * n > TABLE:
        pairs += [(left[i], right[j]) for i, j in _by_rows([x[i] for i in left], [y[j] for j in right])]
    elif m and n:
        weight = [[matching(x[i], y[j], memo) for j in right] for i in left]
        best = [[0] * (n + 1)]
        for i in range(m):
            above, row = best[-1], [0]
            for j in range(n):
                row.append(max(above[j + 1], row[j], above[j] + weight[i][j]))
            best.append(row)
        middle, i, j = [], m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                middle.append((left[i], right[j]))
        pairs += reversed(middle)
    return pairs + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def _by_rows(x: Sequence[Part], y: Sequence[Part]) -> list[tuple[int, int]]:
    """As the table of ``aligned``, for long lists: the same pairs, with the square root of its rows held at once.

    Rows at even distances are kept on the way down, those between two of them are made again on the way back. Children of one
    shape have one weight, which is kept for ``WEIGHTS`` pairs of shapes at most and else worked out again.
    """
    kinds: dict[int, int] = {}
    of_y = np.array([kinds.setdefault(k.shape, len(kinds)) for k in y])
    first = [y[j] for j in np.unique(of_y, return_index=True)[1]]
    known: dict[int, np.ndarray] = {}

    def below(above: np.ndarray, part: Part) -> np.ndarray:
        weight = known.get(part.shape)
        if weight is None:
            memo: dict = {}
            weight = np.array([matching(part, k, memo) for k in first], np.int32)
            if len(known) * len(first) < WEIGHTS:
                known[part.shape] = weight
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weight[of_y]), out=row[1:])
        return row

    step = math.isqrt(len(x)) + 1
    row, kept = np.zeros(len(y) + 1, np.int32), []
    for i, part in enumerate(x):
        if i % step == 0:
            kept.append(row)
        row = below(row, part)
    found, j = [], len(y)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept.pop()]
        for part in x[k * step:(k + 1) * step]:
            rows.append(below(rows[-1], part))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((k * step + i, j))
    return found[::-1]


def matched(page: Part, wrapper: Part) -> Iterator[tuple[Part, Part]]:
    """Pairs of matched parts of two trees whose roots match."""
    memo: dict = {}
    stack = [(page, wrapper)]
    while stack:
        a, b = stack.pop()
        yield a, b
        stack.extend((a.kids[i], b.kids[j]) for i, j in aligned(a.kids, b.kids, memo))


def merge(wrapper: Part, page: Part) -> Part:
    """The wrapper with one tree more: nodes without a partner are inserted between their neighbours' partners."""
    for b, a in list(matched(page, wrapper)):
        partners = {id(b.kids[i]): a.kids[j] for i, j in aligned(b.kids, a.kids, {})} if b.kids else {}
        kids, j = [], 0
        for kid in b.kids:
            partner = partners.get(id(kid))
            if partner is None:
                kids.append(kid)
                continue
            while a.kids[j] is not partner:
                kids.append(a.kids[j])
                j += 1
            kids.append(partner)
            j += 1
        a.kids = kids + a.kids[j:]
    return wrapper.measure()


def outside_texts(root: Node) -> set[int]:
    """Hashes of the texts of blocks that are not part of an article or main, skipped parts included."""
    inside = {id(n) for n in _content(root)}
    out, stack = set(), [root]
    while stack:
        node = stack.pop()
        if id(node) not in inside:
            if node.tag not in RAW:
                text = own_text(node)
                if text:
                    out.add(_digest(text))
            stack.extend(i for i in node.items if not isinstance(i, str))
    return out


# ---- trees as text, and wrappers from them ----

def structure_of(root: Part) -> str:
    """Depth and label of every part, one a line, parents first."""
    lines, stack = [], [(root, 0)]
    while stack:
        part, depth = stack.pop()
        lines.append(f"{depth} {part.label}")
        stack.extend((k, depth + 1) for k in reversed(part.kids))
    return "\n".join(lines)


def _lines(structure: str) -> Iterator[tuple[int, str]]:
    for line in structure.split("\n"):
        depth, _, label = line.partition(" ")
        yield int(depth), label


def tree_of(structure: str) -> Part:
    """The tree of ``structure_of``; ``place`` is a part's line."""
    spine: list[Part] = []
    for place, (depth, label) in enumerate(_lines(structure)):
        part = Part(label, 0, place=place)
        del spine[depth:]
        if spine:
            spine[-1].kids.append(part)
        spine.append(part)
    return spine[0].measure()


def label_paths(structure: str) -> list[tuple[int, int]]:
    """For every line a hash of the labels from the root down to it, and that of its parent (0 for the root)."""
    out, spine = [], []
    for depth, label in _lines(structure):
        del spine[depth:]
        above = spine[-1] if spine else 0
        spine.append(_digest(f"{above} {label}"))
        out.append((spine[-1], above))
    return out


def useful_paths(paths: Iterable[tuple[int, int]], recurring: Iterable[int]) -> list[int]:
    """The root and all children of nodes above ``recurring`` paths, of (path, parent) of a host."""
    parent = dict(paths)
    above = {0}
    for path in recurring:
        at = parent.get(path, 0)
        while at not in above:
            above.add(at)
            at = parent.get(at, 0)
    return [path for path, at in parent.items() if at in above]


def pruned(structure: str, paths: Container[int]) -> str:
    """Without the lines of other label paths. With a path all those above it are in ``paths``, so depths stay right."""
    return "\n".join(line for line, path in zip(structure.split("\n"), label_paths(structure)) if path[0] in paths)


def merged(structures: Iterable[str]) -> str:
    """One wrapper's structure from several, merged two by two, so that none meets all others one by one."""
    level = [tree_of(x) for x in structures]
    while len(level) > 1:
        level = [merge(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return structure_of(level[0])


def partners(page: Part, wrapper: Part) -> list[Part | None]:
    """The wrapper's node for every block of a page in order; None for a block without one."""
    found = {id(a): b for a, b in matched(page, wrapper)}
    return [found.get(id(part)) for part in page.in_order()]


def outline(page: str) -> tuple[str, list[int], list[int]]:
    """Structure of a page, the texts of its blocks by line, and those outside articles."""
    root = parse(page)
    blocks = blocks_of(root)
    return structure_of(blocks), [x.text for x in blocks.in_order()], sorted(outside_texts(root))


def packed(structure: str, counts: Iterable[tuple[int, int, int, int]], outside: Iterable[int]) -> bytes:
    """A wrapper as bytes: nodes in order (parent, label, text, support) and texts that stand outside articles.

    ``counts``: node, its pages, pages with the text most of them have, and this text. Nodes that are not
    listed are on less than SUPPORT pages.
    """
    known = {node: (pages, same, text) for node, pages, same, text in counts}
    nodes, spine = [], []
    for place, (depth, label) in enumerate(_lines(structure)):
        del spine[depth:]
        parent = spine[-1] if spine else -1
        pages, same, text = known.get(place, (0, 0, 0))
        above = known.get(parent, (0, 0, 0))[0]
        nodes.append((parent, label, text if same >= SAME * pages and pages >= SHARE * above else None, pages))
        spine.append(place)
    return pickle.dumps((nodes, set(outside)))


def induced(pages: Sequence[str]) -> bytes:
    """The wrapper of a few pages in this process, as ``induce`` makes it from the tables of all."""
    outlines = [outline(p) for p in pages]
    paths = Counter(x for structure, _, _ in outlines for x in set(label_paths(structure)))
    borne = Counter(x for structure, found, _ in outlines for x in {(path, t) for (path, _), t in zip(label_paths(structure), found) if t})
    known = set(useful_paths([x for x, n in paths.items() if n >= SUPPORT], [x for (x, _), n in borne.items() if n >= SUPPORT]))
    structure = merged(sorted({pruned(x, known) for x, _, _ in outlines}, key=_digest))
    wrapper, texts = tree_of(structure), {}
    for tree, found, _ in outlines:
        for part, text in zip(partners(tree_of(tree), wrapper), found):
            if part is not None:
                texts.setdefault(part.place, Counter())[text] += 1
    seen = Counter(t for _, _, outside in outlines for t in outside)
    counts = [(node, n.total(), *max((k, t) for t, k in n.items())) for node, n in texts.items() if n.total() >= SUPPORT]
    return packed(structure, counts, [t for t, n in seen.items() if n >= SUPPORT])


def loaded(data: bytes) -> tuple[Part, Container[int]]:
    nodes, outside = pickle.loads(data)
    parts = [Part(label, text, None, support) for _, label, text, support in nodes]
    for part, (parent, *_) in zip(parts, nodes):
        if parent >= 0:
            parts[parent].kids.append(part)
    return parts[0].measure(), outside


# ---- extraction ----

def _mark(page: Part, wrapper: Part | None, held: dict[int, list]) -> dict[Node, int]:
    """Mark the page's template blocks; characters of other text of every block with what is below it.

    ``held`` keeps the alignments of trees with this wrapper, which depend on labels only.
    """
    if wrapper is not None:
        if page.shape not in held:
            if len(held) >= HELD_TREES:
                held.clear()
            held[page.shape] = partners(page, wrapper)
        for part, known in zip(page.in_order(), held[page.shape]):
            part.node.mark = bool(known is not None and part.text and part.text == known.text and known.support >= SUPPORT)
    size: dict[Node, int] = {}
    for part in reversed(page.in_order()):
        size[part.node] = (0 if part.node.mark else len(own_text(part.node))) + sum(size[k.node] for k in part.kids)
    return size


def text_of(node: Node) -> str:
    """Blocks below a content node, one a line; white space inside a block is one blank."""
    blocks: list[str] = []
    part: list[str] = []

    def flush():
        line = " ".join("".join(part).split())
        part.clear()
        if line:
            blocks.append(line)

    stack: list = [node]
    while stack:
        i = stack.pop()
        if isinstance(i, str):
            part.append(html_lib.unescape(i) if "&" in i else i)
        elif i is None:
            flush()
        elif i.tag == "br":
            part.append(" ")
        elif i.skipped and i is not node and i.tag != "header":
            if i.tag not in INLINE:
                flush()
        elif i.tag in INLINE:
            stack.extend(reversed(i.items))
        else:
            flush()
            stack.append(None)
            stack.extend(reversed([x for x in i.items if not (i.mark and (isinstance(x, str) or x.tag in INLINE))]))
    flush()
    return "\n".join(blocks)


def _content(root: Node) -> list[Node]:
    """Outermost articles and mains outside skipped parts; a main with articles gives these."""
    found: list[Node] = []
    stack = [(root, None)]
    while stack:
        node, inside = stack.pop()
        if node.skipped:
            continue
        if node.tag == "article" or node.tag == "main" and inside is None:
            if inside is not None and inside in found:
                found.remove(inside)
            found.append(node)
            if node.tag == "article":
                continue
            inside = node
        stack.extend((c, inside) for c in reversed(node.items) if not isinstance(c, str))
    return found


def _regions(root: Node, size: dict[Node, int]) -> list[Node]:
    """Where the varying text is: articles and mains that hold some, else as deep as 80 % of it stays together."""
    named = [n for n in _content(root) if size.get(n)]
    if named:
        return named
    at = [root]
    while True:
        kinds: dict[str, list[Node]] = {}
        for c in (c for n in at for c in _blocks(n) if c in size):
            kinds.setdefault(c.label, []).append(c)
        best = max(kinds.values(), key=lambda k: sum(size[c] for c in k), default=[])
        # a block that holds text only is content itself, its parent is the region
        if sum(size[c] for c in best) < 0.8 * sum(size[n] for n in at) or not any(True for c in best for _ in _blocks(c)):
            return at
        at = best


def extract(page: str, wrapper: tuple[Part, Container[int]] | None = None, held: dict[int, list] | None = None) -> str:
    """Main text of a page, given the wrapper of its host and the texts that stand outside articles there."""
    root = parse(page)
    blocks = blocks_of(root)
    size = _mark(blocks, wrapper and wrapper[0], {} if held is None else held)
    if not size[root]:  # nothing varies, so nothing tells content from template
        found = _content(root) or [root]
    else:
        found = _regions(root, size)
    named = all(n.tag in CONTENT for n in found)
    for part in blocks.in_order():
        if part.node.mark and (not size[root] or part.node.tag in HEADINGS or named and part.text not in wrapper[1]):
            part.node.mark = False
    return "\n".join(t for t in map(text_of, found) if t)


# ---- wrappers of all hosts in Spark ----

def _outline(batches):
    sys.setrecursionlimit(1 << 20)  # trees may be deep; these calls need no C stack
    for batch in batches:
        found = [outline(p) for p in batch["html"]]
        yield pd.DataFrame({"host": batch["host"].array, "hash": batch["hash"].array, "tree": [_digest(x[0]) for x in found], "structure": [x[0] for x in found],
                            "texts": [x[1] for x in found], "outside": [x[2] for x in found]})


def outlines(pages: DataFrame) -> DataFrame:
    """(host, tree, structure, texts, outside) from (host, html): one row per different page of a host, ``tree`` a hash of its structure."""
    hashed = pages.select("host", F.xxhash64("html").alias("hash"), "html")
    read = hashed.mapInPandas(_outline, "host string, hash bigint, tree bigint, structure string, texts array<bigint>, outside array<bigint>")
    once = read.groupBy("host", "hash").agg(F.first(F.struct("tree", "structure", "texts", "outside")).alias("page"))
    return as_table(once.select("host", "page.*"), "page-outlines")


def _paths(batches):
    for batch in batches:
        found = [label_paths(x) for x in batch["structure"]]
        yield pd.DataFrame({"host": batch["host"].array, "tree": batch["tree"].array, "n": batch["n"].array,
                            "paths": [[x for x, _ in f] for f in found], "parents": [[x for _, x in f] for f in found]})


def _useful(batches):
    for batch in batches:
        found = [useful_paths(((x["path"], x["parent"]) for x in paths), map(int, recurring)) for paths, recurring in zip(batch["paths"], batch["recurring"])]
        yield pd.DataFrame({"host": batch["host"].array, "paths": found})


def useful_of_hosts(read: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, paths): the useful label paths of hosts on whose pages a text recurs."""
    paths = as_table(trees.mapInPandas(_paths, "host string, tree bigint, n bigint, paths array<bigint>, parents array<bigint>"), "tree-paths")
    lists = paths.select("host", "tree", "paths")
    borne = lookup_join(read.select("host", "tree", "texts"), lists, ["host", "tree"], "inner", small_fits=fits_broadcast(lists))
    borne = borne.select("host", F.explode(F.array_distinct(F.arrays_zip("paths", "texts"))).alias("x")).select("host", "x.paths", "x.texts").where("texts <> 0")
    borne = borne.groupBy("host", "paths", "texts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    borne = borne.groupBy("host").agg(F.collect_set("paths").alias("recurring"))
    often = paths.select("host", "n", F.explode(F.array_distinct(F.arrays_zip("paths", "parents"))).alias("x"))
    often = often.groupBy("host", F.col("x.paths").alias("path"), F.col("x.parents").alias("parent")).agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    often = often.groupBy("host").agg(F.collect_list(F.struct("path", "parent")).alias("paths"))
    return as_table(often.join(borne, "host").mapInPandas(_useful, "host string, paths array<bigint>"), "wrapper-paths")


def _prune(batches):
    known: dict[str, frozenset] = {}
    for batch in batches:
        out = []
        for host, structure, paths in zip(batch["host"], batch["structure"], batch["paths"]):
            if host not in known:
                if len(known) >= HELD_HOSTS:
                    known.clear()
                known[host] = frozenset(map(int, paths))
            out.append(pruned(structure, known[host]))
        yield pd.DataFrame({"host": batch["host"].array, "key": [_digest(x) for x in out], "structure": out})


def _merge(batches):
    """Rows (host, part, key, structure, n) sorted by the first three to one row (host, key, structure, n) for each host and part."""
    sys.setrecursionlimit(1 << 20)
    at, held = None, []

    def out():
        rows = [(at[0], at[1], merged(held), at[2])] if held else []
        return pd.DataFrame(rows, columns=["host", "key", "structure", "n"])

    for batch in batches:
        for host, part, n, structure in zip(batch["host"], batch["part"], batch["n"], batch["structure"]):
            if (host, part, n) != at:
                yield out()
                at, held = (host, part, n), []
            held.append(structure)
    yield out()


def merged_trees(trees: DataFrame, paths: DataFrame) -> DataFrame:
    """(host, structure) from (host, tree, structure), the different trees, and (host, paths), the paths of use.

    A host's trees are dealt by hash to parts of about FAN, each part is merged in a task, and so on with the
    results: no task reads all trees of a host, and rows' order and partitions change nothing.
    """
    met = keyed_join(trees, paths, ["host"], "inner", small_fits=fits_broadcast(paths), spread=["tree"])
    level = as_table(met.select("host", "structure", "paths").mapInPandas(_prune, "host string, key bigint, structure string")
                     .groupBy("host", "key").agg(F.first("structure").alias("structure")), "wrapper-trees")
    counts = as_table(level.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "wrapper-counts")
    most = counts.agg(F.max("n").alias("n")).first()["n"] or 0
    level = keyed_join(level, counts, ["host"], "inner", small_fits=fits_broadcast(counts), spread=["key"])
    while most > 1:
        parts = F.ceil(F.col("n") / FAN)
        dealt = level.withColumn("n", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("n")))
        sorted_ = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "key")
        level = as_table(sorted_.select("host", "part", "n", "structure").mapInPandas(_merge, "host string, key bigint, structure string, n bigint"), "wrapper-level")
        most = -(-most // FAN)
    return level.select("host", "structure")


def _align(batches):
    sys.setrecursionlimit(1 << 20)
    known: dict[str, Part] = {}
    for batch in batches:
        nodes = []
        for host, tree, wrapper in zip(batch["host"], batch["structure"], batch["wrapper"]):
            if host not in known:
                if len(known) >= HELD_HOSTS:
                    known.clear()
                known[host] = tree_of(wrapper)
            nodes.append([-1 if part is None else part.place for part in partners(tree_of(tree), known[host])])
        yield pd.DataFrame({"host": batch["host"].array, "tree": batch["tree"].array, "nodes": nodes})


def _pack(batches):
    for batch in batches:
        rows = [(host, packed(structure, [(x["node"], x["pages"], x["same"], x["text"]) for x in counts], [] if outside is None else map(int, outside)))
                for host, structure, counts, outside in zip(batch["host"], batch["structure"], batch["counts"], batch["outside"])]
        # without template a wrapper marks nothing
        rows = [(host, data) for host, data in rows if any(part.text and part.support >= SUPPORT for part in loaded(data)[0].in_order())]
        yield pd.DataFrame(rows, columns=["host", "wrapper"])


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html) of hosts whose pages have template."""
    read = outlines(pages)
    trees = as_table(read.groupBy("host", "tree").agg(F.first("structure").alias("structure"), F.count(F.lit(1)).alias("n")), "page-trees")
    merged_ = as_table(merged_trees(trees, useful_of_hosts(read, trees)), "wrapper-structures")
    met = keyed_join(trees, merged_.withColumnRenamed("structure", "wrapper"), ["host"], "inner", small_fits=fits_broadcast(merged_), spread=["tree"])
    aligned_ = as_table(met.select("host", "tree", "structure", "wrapper").mapInPandas(_align, "host string, tree bigint, nodes array<int>"), "wrapper-alignments")

    texts = lookup_join(read.select("host", "tree", "texts"), aligned_, ["host", "tree"], "inner", small_fits=fits_broadcast(aligned_))
    texts = texts.select("host", F.explode(F.arrays_zip("nodes", "texts")).alias("x")).select("host", "x.nodes", "x.texts").where("nodes >= 0")
    texts = texts.groupBy("host", F.col("nodes").alias("node"), F.col("texts").alias("text")).agg(F.count(F.lit(1)).alias("same"))
    counts = texts.groupBy("host", "node").agg(F.sum("same").alias("pages"), F.max(F.struct("same", "text")).alias("most"))
    counts = as_table(counts.where(F.col("pages") >= SUPPORT).select("host", "node", "pages", "most.*"), "wrapper-counts")

    # outside articles, only texts that may be template somewhere on the host are asked for
    asked = as_table(counts.where((F.col("same") >= SUPPORT) & (F.col("text") != 0)).select("host", "text").distinct(), "wrapper-texts")
    seen = read.select("host", F.explode("outside").alias("text"))
    seen = seen.join(F.broadcast(asked) if fits_broadcast(asked) else asked, ["host", "text"], "left_semi")
    seen = seen.groupBy("host", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    whole = merged_.join(counts.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "same", "text")).alias("counts")), "host")
    whole = whole.join(seen.groupBy("host").agg(F.collect_list("text").alias("outside")), "host", "left")
    return whole.select("host", "structure", "counts", "outside").mapInPandas(_pack, "host string, wrapper binary")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null and empty pages, and pages without content, have the empty text. Pages of null or host-less URLs share
    one wrapper; hosts with less than SUPPORT different pages have none, and no template is taken from their pages. Null ids and repeated rows stay; further columns are ignored; an empty table gives an empty
    result. Wrappers are broadcast if their measured size allows, else joined with salt.
    """
    rows = pages.select(pages[id_col].cast("bigint").cast("string").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"),
                        url_host(pages[url_col]).alias("host"))
    wrappers = as_table(induce(rows), "wrappers")
    joined = keyed_join(rows, wrappers, ["host"], "left", small_fits=fits_broadcast(wrappers), spread=["page_id", "url"])

    def run(batches):
        sys.setrecursionlimit(1 << 20)  # trees may be deep; these calls need no C stack
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for host, page, data in zip(batch["host"], batch["html"], batch["wrapper"]):
                if host not in known:
                    if len(known) >= HELD_HOSTS:
                        known = {}
                    known[host] = None if data is None else loaded(data), {}
                texts.append(extract(page, *known[host]))
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    return exact_id(joined.mapInPandas(run, "page_id string, url string, text string, n_chars bigint"), "page_id")
