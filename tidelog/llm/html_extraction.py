"""Main text of web pages by wrapper induction.

Pages of one host come from few templates. Each page is parsed into a tree and
folded into the wrapper of its layout: simple tree matching aligns the children
of matched nodes in order, so that as many nodes of the subtrees as possible
pair up, and a node remembers on how many pages it stood and with which texts.
A text that most pages with the node's parent have there, on two distinct pages
at least, is template; other nodes are slots. Wrappers of parts of a host merge
by the same alignment, so every page of a host takes part, each task yields one
row a host, and the merging task reads wrappers, never pages.

A page is then aligned with the wrapper of its layout. The wrapper decides: the
main text is what stands in varying slots, inside and outside of <article>.
Markup that declares itself something else (navigation, page headers and
footers, asides, adverts, notices, forms, reader comments, scripts, styles,
hidden parts) is left out in addition. Pages with one and the same article count
as one page, so copies of an article do not make it template. Only pages of a
layout that no second distinct page of the host has go by markup alone: there
text outside of <article> (or the main part) is left out.

Null html or url: empty text, or a host of its own without a wrapper. Repeated
rows give equal texts. Empty tables give empty tables. Extra columns are ignored.
Broken markup never fails: end tags without a start are skipped, missing end
tags are closed by their parents. Nesting may have any depth.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import shared_table, tasks_for

#: A text of a node is template if it stood on so many distinct pages
LEAST_PAGES = 2
#: and on more than such a share of the pages on which the node's parent stood.
LEAST_SHARE = 0.5
#: Pages are of one layout if their sets of label paths agree to this share.
ALIKE = 0.6
#: Lossy counting forgets what falls behind one page in so many.
LOSSY = 64
#: Texts counted at a node of a wrapper.
TEXTS = 8
#: Cells of an alignment kept whole; larger ones are halved first.
WHOLE_CELLS = 1 << 20

# Element names by role, and words in class, id or role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body br canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "caption", "legend", "option", "body", "html", "head", "title", "tbody", "thead", "tfoot"}
NOT_TEXT = set("nav footer aside form script style noscript template iframe svg math button select textarea input dialog head title object embed canvas audio video menu".split())
HINTS = set("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond share sharing social related recommended pagination pager toolbar widget search login skip".split())
HEADS = set("header masthead topbar".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption b i em strong a span code u s q cite small sub sup mark".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("attrs", "kids", "label", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.label = tag + ("." + attrs["class"] if attrs.get("class") else "") + ("#" + attrs["id"] if attrs.get("id") else "")

    def own_text(self) -> str:
        return " ".join(" ".join(x.split()) for x in self.kids if isinstance(x, str)).strip()


def parse(text: str) -> Node:
    root = Node("#root", {})
    stack, at, end = [root], 0, len(text)
    opened: Counter[str] = Counter()  # so that an end tag without a start need not search the stack
    while at < end:
        m = _TOKEN.search(text, at)
        if not m:
            stack[-1].kids.append(html.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if name := m[1]:
            name = name.lower()
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].tag == name:
                    _close(stack, k, opened)
                    break
            continue
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        rest = m[3]
        attrs = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(rest)} if len(rest) > 1 else {}
        _imply(stack, name, opened)
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(text, at)
            if name == "title" or name == "textarea":
                node.kids.append(html.unescape(text[at : close.start() if close else end]))
            at = close.end() if close else end
        elif name not in VOID and not rest.endswith("/>"):
            stack.append(node)
            opened[name] += 1
    return root


_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "nav", "aside", "footer", "header", "form", "body", "select", "#root"}


def _close(stack: list[Node], k: int, opened: Counter[str]) -> None:
    for x in stack[k:]:
        opened[x.tag] -= 1
    del stack[k:]


def _imply(stack: list[Node], name: str, opened: Counter[str]) -> None:
    """Close what a start tag closes without an end tag."""
    shut = _SAME.get(name, set()) | ({"p"} if name in CLOSES_P else set())
    if not any(opened[x] for x in shut):
        return
    for k in range(len(stack) - 1, 0, -1):
        tag = stack[k].tag
        if tag in shut:
            _close(stack, k, opened)
            return
        if tag in _WALLS:
            return


def _hints(node: Node) -> set[str]:
    a = node.attrs
    if not a:
        return set()
    return {w.lower() for w in _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}


def declared_other(node: Node, in_article: bool) -> bool:
    """Whether markup says that an element is not part of the main text."""
    if node.tag in NOT_TEXT or node.tag == "header" and not in_article:
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return bool(_hints(node) & {"comment", "comments", "reply", "related", "promo", "ad"})
    words = _hints(node)
    return bool(words & HINTS) or not in_article and bool(words & HEADS)


# ---------------------------------------------------------------- the wrapper


def _mark(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest() if text else ""


class Twig:
    """A node of a wrapper: on how many pages it stood and with which texts.

    ``texts`` counts texts by the Misra-Gries method with TEXTS counters: each
    is [pages, prints of up to LEAST_PAGES distinct pages], too low by ``off``
    at most. ``shape`` is the hash of the subtree's labels, ``size`` its nodes.
    """

    __slots__ = ("kids", "label", "late", "node", "off", "pages", "shape", "size", "texts")

    def __init__(self, label: str, pages: int, texts: dict[str, list], off: int = 0, late: int = 0, node: Node | None = None):
        self.label, self.pages, self.texts, self.off, self.late, self.node = label, pages, texts, off, late, node
        self.kids: list[Twig] = []
        self.shape, self.size = 0, 1


def measure(tree: Twig) -> Twig:
    """Set shapes and sizes."""
    order = [tree]
    for x in order:
        order += x.kids
    for x in reversed(order):
        x.shape = hash((x.label, *[k.shape for k in x.kids]))
        x.size = 1 + sum([k.size for k in x.kids])
    return tree


def tree_of(node: Node, seen: str = "") -> Twig:
    """The tree of a page whose print is ``seen``."""
    out: list[Twig] = []
    todo = [(node, out)]
    while todo:
        x, into = todo.pop()
        text = _mark(x.own_text())
        t = Twig(x.label, 1, {text: [1, [seen]]} if text else {}, node=x)
        into.append(t)
        todo += [(k, t.kids) for k in reversed(x.kids) if isinstance(k, Node)]
    for t in out:
        measure(t)
    return out[0]


def flat(tree: Twig) -> list:
    """A tree as its nodes in preorder with the numbers of their children."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        out.append([x.label, x.pages, x.texts, x.off, x.late, len(x.kids)])
        todo += reversed(x.kids)
    return out


def unflat(nodes: list) -> Twig:
    top: list[Twig] = []
    todo = [(top, 1)]
    for *x, n in nodes:
        while not todo[-1][1]:
            todo.pop()
        into, left = todo[-1]
        todo[-1] = (into, left - 1)
        into.append(Twig(*x))
        todo.append((into[-1].kids, n))
    return measure(top[0])


#: Matching scores of subtrees by their shapes; only a cache.
_weights: dict[tuple[int, int], int] = {}


def _known(x: Twig, y: Twig) -> int | None:
    if x.label != y.label:
        return 0
    if x.shape == y.shape:
        return x.size
    if not x.kids or not y.kids:
        return 1
    return _weights.get((x.shape, y.shape))


def weight(a: Twig, b: Twig) -> int:
    """Simple tree matching: the most nodes that pair up, parents first, in order."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if _known(x, y) is not None:
            todo.pop()
            continue
        xs, ys = ({k.shape: k for k in t.kids}.values() for t in (x, y))
        missing = [(p, q) for p in xs for q in ys if _known(p, q) is None]
        if missing:
            todo += missing
            continue
        head, tail = _ends(x.kids, y.kids)
        i, j = x.kids[head : len(x.kids) - tail], y.kids[head : len(y.kids) - tail]
        ends = sum([k.size for k in x.kids[:head]]) + sum([k.size for k in x.kids[len(x.kids) - tail :]])
        got = int(_rows_of(*_coded(i, j))[-1]) if i and j else 0
        if len(_weights) > 1_000_000:
            _weights.clear()  # what is missing again is computed again
            todo = [(a, b)]
        _weights[x.shape, y.shape] = 1 + ends + got
    return _known(a, b)


def _ends(a: list[Twig], b: list[Twig]) -> tuple[int, int]:
    """How many equal subtrees two lists begin and end with; some best alignment pairs them."""
    n, m, head, tail = len(a), len(b), 0, 0
    while head < n and head < m and a[head].shape == b[head].shape:
        head += 1
    while tail < n - head and tail < m - head and a[n - 1 - tail].shape == b[m - 1 - tail].shape:
        tail += 1
    return head, tail


def _coded(a: list[Twig], b: list[Twig]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of kinds of subtrees, and the kinds in both lists."""
    kinds_a, kinds_b = {k.shape: k for k in a}, {k.shape: k for k in b}
    table = np.array([[weight(x, y) if x.label == y.label else 0 for y in kinds_b.values()] for x in kinds_a.values()], np.int64)
    at_a, at_b = ({k: i for i, k in enumerate(kinds)} for kinds in (kinds_a, kinds_b))
    return table, np.array([at_a[k.shape] for k in a]), np.array([at_b[k.shape] for k in b])


def _rows_of(table: np.ndarray, a: np.ndarray, b: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Best scores of all of ``a`` with each beginning of ``b``; ``keep`` takes all rows."""
    row = np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a):
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[x][b]), out=row[1:])
        if keep is not None:
            keep[i + 1] = row
    return row


def _best(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A best alignment; long lists are halved (Hirschberg), so memory stays small."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        x, y = a[i0:i1], b[j0:j1]
        if (i1 - i0) * (j1 - j0) > WHOLE_CELLS and i1 - i0 > 1:
            half = len(x) // 2
            both = _rows_of(table, x[:half], y) + _rows_of(table, x[half:][::-1], y[::-1])[::-1]
            at = j0 + int(both.argmax())
            todo += [(i0 + half, i1, at, j1), (i0, i0 + half, j0, at)]
            continue
        w = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        _rows_of(table, x, y, w)
        w, i, j, part = w.tolist(), len(x), len(y), []
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                part.append((i0 + i, j0 + j))
        out += reversed(part)
    return out


def pairs_of(a: list[Twig], b: list[Twig]) -> list[tuple[int, int]]:
    """Aligned indices of two lists of children, in order, of the greatest matching score."""
    head, tail = _ends(a, b)
    n, m = len(a), len(b)
    mid = _best(*_coded(a[head : n - tail], b[head : m - tail])) if n - tail > head and m - tail > head else []
    return [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in mid] + [(n - k, m - k) for k in range(tail, 0, -1)]


def _add_texts(w: Twig, t: Twig) -> None:
    for text, (n, seen) in t.texts.items():
        if text in w.texts:
            have = w.texts[text]
            have[0] += n
            have[1] = sorted({*have[1], *seen})[:LEAST_PAGES]
        else:
            w.texts[text] = [n, list(seen)]
    w.off += t.off
    if len(w.texts) > TEXTS:
        least = sorted((n for n, _ in w.texts.values()), reverse=True)[TEXTS]
        w.off += least
        w.texts = {k: [n - least, seen] for k, (n, seen) in w.texts.items() if n > least}


def _late(w: Twig, pages: int) -> None:
    todo = [w]
    while todo:
        x = todo.pop()
        x.late += pages
        todo += x.kids


def merge(w: Twig, t: Twig) -> None:
    """Fold tree or wrapper ``t`` into ``w``; nodes of ``t`` may be kept in it.

    A node that only one side has may have been forgotten by the other.
    """
    top, grown, todo = w, False, [(w, t)]
    behind, theirs = w.pages // LOSSY, t.pages // LOSSY
    while todo:
        w, t = todo.pop()
        w.pages += t.pages
        w.late += t.late
        _add_texts(w, t)
        pairs = pairs_of(w.kids, t.kids)
        todo += [(w.kids[i], t.kids[j]) for i, j in pairs]
        if behind:
            both = {j for _, j in pairs}
            for k in [k for j, k in enumerate(t.kids) if j not in both]:
                _late(k, behind)
        if theirs:
            both = {i for i, _ in pairs}
            for k in [k for i, k in enumerate(w.kids) if i not in both]:
                _late(k, theirs)
        if len(pairs) < len(t.kids):
            kids, i, j, grown = [], 0, 0, True
            for pi, pj in [*pairs, (len(w.kids), len(t.kids))]:
                kids += w.kids[i:pi]
                kids += t.kids[j:pj]
                if pi < len(w.kids):
                    kids.append(w.kids[pi])
                i, j = pi + 1, pj + 1
            w.kids = kids
    if grown:
        measure(top)


def prune(w: Twig, least) -> None:
    """Forget nodes for which ``least(node, parent)`` is false."""
    todo = [w]
    while todo:
        x = todo.pop()
        x.kids = [k for k in x.kids if least(k, x)]
        todo += x.kids
    measure(w)


def template_texts(w: Twig, parent: Twig) -> dict[str, list]:
    """The texts of a node that are template, by the pages of its parent."""
    return {k: x for k, x in w.texts.items() if len(x[1]) >= LEAST_PAGES and x[0] + w.off > LEAST_SHARE * parent.pages}


def paths_of(tree: Twig) -> frozenset[int]:
    """What a layout is known by: the labels of structural nodes with those of their parents."""
    out, todo = set(), [tree]
    while todo:
        x = todo.pop()
        for k in x.kids:
            tag = k.node.tag
            if tag not in PROSE and tag not in VOID or k.node.attrs.get("class"):
                out.add(int.from_bytes(blake2b(f"{x.label}>{k.label}".encode("utf-8", "surrogatepass"), digest_size=6).digest()))
        todo += x.kids
    return frozenset(out)


class Layout:
    """The wrapper of the pages of one layout; ``paths`` are those of its first page."""

    def __init__(self, paths: frozenset[int], tree: Twig):
        self.paths, self.tree = paths, tree

    def likeness(self, paths: frozenset[int]) -> float:
        return len(self.paths & paths) / (len(self.paths | paths) or 1) if self.paths or paths else 1.0


class HostWrapper:
    """The layouts of a host. Nodes and layouts that are rare so far are forgotten by lossy counting.

    ``late`` of a node or layout is the number of pages it may have stood on
    before it was (last) entered; it goes once pages + late is no more than
    the pages of all, divided by LOSSY. So what stands on more than that share
    of the pages is never lost, however late it begins.
    """

    def __init__(self, layouts: list[Layout], pages: int):
        self.layouts, self.pages = layouts, pages

    @classmethod
    def of(cls, page: Node) -> HostWrapper:
        """One page. Its print is that of its text by markup alone: copies of an article count once."""
        tree = tree_of(page, _mark(main_text(page, None)))
        return cls([Layout(paths_of(tree), tree)], 1)

    def nearest(self, paths: frozenset[int]) -> Layout | None:
        """The layout of a page; none if no layout is alike."""
        best = max(self.layouts, key=lambda x: x.likeness(paths), default=None)
        return best if best and best.likeness(paths) >= ALIKE else None

    def add(self, other: HostWrapper) -> None:
        behind, theirs = self.pages // LOSSY, other.pages // LOSSY
        before, known, met = self.pages, len(self.layouts), set()
        self.pages += other.pages
        for x in other.layouts:
            mine = self.nearest(x.paths)
            if mine:
                merge(mine.tree, x.tree)
            else:
                x.tree.late += behind
                self.layouts.append(x)
                continue
            met.add(id(mine))
        for x in self.layouts[:known]:
            x.tree.late += 0 if id(x) in met else theirs
        if before // LOSSY < self.pages // LOSSY:
            now = self.pages // LOSSY
            self.layouts = [x for x in self.layouts if x.tree.pages + x.tree.late > now]
            for x in self.layouts:
                prune(x.tree, lambda k, _, all_=x.tree.pages // LOSSY: k.pages + k.late > all_)

    def finish(self) -> HostWrapper:
        """What can be template, and nodes near it in number, which keep the alignment true."""
        self.layouts = [x for x in self.layouts if x.tree.pages >= LEAST_PAGES]
        for x in self.layouts:
            todo = [(x.tree, x.tree)]
            while todo:
                w, parent = todo.pop()
                todo += [(k, w) for k in w.kids]
                w.texts = template_texts(w, parent)
            prune(x.tree, lambda k, parent: k.pages > LEAST_SHARE / 2 * parent.pages)
        return self

    def dumps(self) -> bytes:
        return json.dumps([self.pages, [[sorted(x.paths), flat(x.tree)] for x in self.layouts]], separators=(",", ":")).encode()

    @classmethod
    def loads(cls, raw: bytes) -> HostWrapper:
        pages, layouts = json.loads(raw)
        return cls([Layout(frozenset(paths), unflat(nodes)) for paths, nodes in layouts], pages)

    def template_of(self, page: Node) -> set[int] | None:
        """ids of the page's nodes whose text is template; none if its layout is unknown.

        A constant word in bold within a varying line belongs to the line.
        """
        tree = tree_of(page)
        layout = self.nearest(paths_of(tree))
        if layout is None:
            return None
        found: set[int] = set()
        todo = [(layout.tree, layout.tree, tree, False)]
        while todo:
            w, parent, t, in_slot = todo.pop()
            in_slot = in_slot and t.node.tag not in BLOCK
            text = next(iter(t.texts), "")
            constant = text in template_texts(w, parent)
            if constant and not in_slot:
                found.add(id(t.node))
            in_slot = in_slot or bool(text) and not constant
            todo += [(w.kids[i], w, t.kids[j], in_slot) for i, j in pairs_of(w.kids, t.kids)]
        return found


def main_text(page: Node, wrapper: HostWrapper | None) -> str:
    """Text outside template and declared parts; by markup alone if the layout is unknown."""
    template = wrapper.template_of(page) if wrapper else None
    parts: list[str] = []
    for area in [page] if template is not None else _areas(page):
        # an explicit stack, as nesting may be deep
        todo: list = [(area, area is not page)]
        while todo:
            x, in_article = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            in_article = in_article or x.tag in ("article", "main")
            if declared_other(x, in_article):
                continue
            skip_own = template is not None and id(x) in template
            gap = (" " if x.tag in BLOCK else "", in_article)
            todo.append(gap)
            todo += [(k, in_article) for k in reversed(x.kids) if not (skip_own and isinstance(k, str))]
            todo.append(gap)
        parts.append(" ")
    return " ".join("".join(parts).split())


def _areas(page: Node) -> list[Node]:
    """The page's articles, or its main parts, or the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(page, frozenset())]
    while todo:
        x, inside = todo.pop()
        if x is not page and declared_other(x, bool(inside)):
            continue
        kind = None
        if x.tag == "article" or x.attrs.get("itemprop", "").lower() == "articlebody":
            kind = "article"
        elif x.tag == "main" or x.attrs.get("role", "").lower() == "main":
            kind = "main"
        if kind and kind not in inside:
            found[kind].append(x)
            inside = inside | {kind}
        todo += [(k, inside) for k in reversed(x.kids) if isinstance(k, Node)]
    return found["article"] or found["main"] or [page]


# ------------------------------------------------------------------ on Spark


def host_of(url):
    """Lower-case host of a url, as a Spark column; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, HostWrapper] = {}
    for batch in batches:
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not host:
                continue
            one = HostWrapper.of(parse(text))
            if host in found:
                found[host].add(one)
            else:
                found[host] = one
            if len(found) >= 2000:  # a task may meet any number of hosts
                yield _wrappers(found)
                found = {}
    if found:
        yield _wrappers(found)


def _wrappers(found: dict[str, HostWrapper]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([w.dumps() for w in found.values()], pa.binary())], names=["host", "wrapper"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the wrappers of each host; rows arrive sorted by host."""
    host, held = None, None
    for batch in batches:
        for h, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = HostWrapper.loads(raw.as_buffer().to_pybytes())
            if h == host:
                held.add(w)
            else:
                if held:
                    yield _wrappers({host: held.finish()})
                host, held = h, w
    if held:
        yield _wrappers({host: held.finish()})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages with ``host`` and ``html``."""
    parts = pages.select("host", "html").mapInArrow(_induce, "host string, wrapper binary")
    laid = parts.repartition(tasks_for(pages.sparkSession), "host").sortWithinPartitions("host", "wrapper")
    return laid.mapInArrow(_combine, "host string, wrapper binary")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, wrapper = None, None
    for batch in batches:
        texts = []
        for text, raw in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            raw = raw.as_buffer().to_pybytes() if raw.is_valid else None
            if raw != last:
                last, wrapper = raw, HostWrapper.loads(raw) if raw else None
            texts.append(main_text(parse(text), wrapper))
        sizes = pa.array([len(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its number of code points, for every page."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("host", host_of(F.col("url")))
    known = shared_table(wrappers(p), "wrappers").withColumnRenamed("host", "_host")
    joined = p.join(known, p["host"] == known["_host"], "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
