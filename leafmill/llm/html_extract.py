"""HTML extraction by wrapper induction.

1. Every page is parsed and reduced to a skeleton: its element tree, in which runs of like
   siblings (same tag and marks, alike below) and repeated groups of up to three of them are
   one node, and per node a hash and the length of its text and of its link text.
2. Per host the ``references`` most frequent skeletons are references.  Each distinct page is
   aligned by simple tree matching (order-preserving dynamic programming over children) with
   the reference that it matches best, and the text hashes of aligned nodes are summarised
   with partial aggregates: a node is template if one hash holds at least ``_SAME_SHARE`` of
   the pages that have it, and at least ``_ENOUGH`` of them; the others are varying slots.
3. The content of a reference is the deepest node that still holds all of its varying text
   outside links and landmarks, and no deeper than a varying heading stands.  Only in the
   page's own frame (its body, or an element with landmarks as children) a child that has a
   heading of its own and ``_HOLDS`` of the text is the content without what stands beside it,
   such as advertisements that no mark tells.  Where an article or main element stands around it, or holds at least
   ``_SEMANTIC`` of it, that element is the content (semantic tags break ties between slots).
4. Each page is aligned again.  Its text is that of the nodes in the content slot, without
   template nodes and without landmarks: navigation, footers, forms, scripts and the like by
   tag, and elements whose role is, or one of whose class tokens or id is made up of, words
   such as ``comments`` or ``share-links`` (``related-work`` or ``has-sidebar`` are not).
   A page without a node in that slot, or without text there, is its own reference.

Nothing is ever gathered by host: what is grouped are (host, reference, node) sums, and joins
by host are salted.  Wrappers are broadcast when they take less than ``broadcast_bytes`` in
all, otherwise joined by salted host.

Defined cases: null or empty html, and pages without content, give an empty text; urls that
name no host share the host ""; repeated rows are separate pages but count once in a wrapper;
among equally frequent skeletons the larger one comes first, then the greater as text; a page
that matches two references equally goes with the first; broken, cut off or very deep markup
is read to its end, at every depth; whole pages are used, and child lists of any length are
matched by the same rule.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, small_batches, texts_in

_ENOUGH = 4
_SAME_SHARE = 0.8
_HOLDS = 0.8
_SEMANTIC = 0.3
_TABLE = 1 << 18
_SALTS = 32
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_OUT = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "iframe", "button", "select", "textarea", "title", "head", "template", "svg", "object", "dialog", "menu", "input", "canvas", "audio", "video", "option", "noframes"}
#: Words of class, id, role or label that mark something other than the article.
_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adverting", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies",
    "consent", "disqus", "footer", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "pager", "pagination",
    "popup", "promo", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar", "widget",
}
#: Words that say what shape a marked element has, as in comment-list.
_SHAPE_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "icons", "inner", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "right", "section", "site",
    "slot", "thread", "title", "top", "wrap", "wrapper",
}
_LANDMARKS = {"nav", "header", "footer", "aside"}
_UNMARKED = {"html", "body", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are part of a text and never the container of all of it.
_TEXTUAL = _HEADINGS | {"p", "ul", "ol", "dl", "li", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "br", "hr"}
#: A start tag closes open elements of these kinds, up to the nearest of the second set.
_P_CLOSERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "words", "hidden", "marked", "main", "parts")

    def __init__(self, tag: str, words: tuple[str, ...] = (), hidden: bool = False, marked: bool = False, main: bool = False):
        self.tag, self.words, self.hidden, self.marked, self.main = tag, words, hidden, marked, main or tag in ("article", "main")
        self.parts: list = []  # text pieces and child nodes in page order

    @property
    def key(self) -> str:
        """Tag, ``~`` if hidden, ``!`` if marked, ``+`` if an article or main element, and the words of its attributes."""
        return ".".join((self.tag + "~" * self.hidden + "!" * self.marked + "+" * self.main, *self.words))


def _says_out(token: str) -> bool:
    """Whether a class token or id marks something other than the article: all its words do, or say a shape."""
    parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    return any(w in _OUT_WORDS for w in parts) and all(w in _OUT_WORDS or w in _SHAPE_WORDS for w in parts)


def _marks(tag: str, attributes: str) -> tuple[tuple[str, ...], bool, bool, bool]:
    """Words of the attributes, and whether they hide the element, mark it, or make it the main one."""
    words: list[str] = []
    hidden = marked = main = False
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            words += [w for w in re.split(r"[^a-z0-9]+", value) if w]
            main |= (name, value) in (("role", "main"), ("itemprop", "articlebody"))
            if name == "class" or name == "id" and tag not in _HEADINGS:
                marked |= any(map(_says_out, value.split()))
            elif name == "role":
                marked |= not _OUT_WORDS.isdisjoint(value.split())
            elif name == "aria-label":
                marked |= value.strip() in _OUT_WORDS
    return tuple(dict.fromkeys(words)), hidden, marked and tag not in _UNMARKED, main


def parse(source: str | None) -> Node:
    """The element tree of a page, forgiving about unclosed and misplaced tags."""
    root = Node("#page")
    stack = [root]
    opened: Counter = Counter()  # tags on the stack

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    at, text = 0, source or ""
    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append("\n")
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag in _P_CLOSERS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        elif tag in _SAME:
            kinds, walls = _SAME[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in walls:
                    break
                if stack[i].tag in kinds:
                    close(i)
                    break
        node = Node(tag, *_marks(tag, m[3])) if m[3] else Node(tag)
        stack[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            node.parts.append(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(text):
        stack[-1].parts.append(text[at:])
    return root


class Slot:
    """A skeleton node: like siblings share one, so it stands for a list of page nodes."""

    __slots__ = ("key", "children", "nodes")

    def __init__(self, key: str):
        self.key, self.children, self.nodes = key, [], []

    @property
    def tag(self) -> str:
        return re.match(r"[^~!+.]*", self.key)[0]

    def says(self, mark: str) -> bool:
        return mark in self.key.partition(".")[0]


def skeleton(node: Node) -> Slot:
    """Inline elements belong to their block; runs of like siblings, and groups of up to three that repeat, are folded."""
    top = Slot(node.key)
    top.nodes = [node]
    todo = [top]
    while todo:
        slot = todo.pop()
        run: list[Slot] = []
        inner: list[frozenset] = []  # keys below each, for likeness
        for parent in slot.nodes:
            for child in _blocks(parent):
                one = Slot(child.key)
                one.nodes = [child]
                run.append(one)
                inner.append(frozenset(c.key for c in _blocks(child)))
                for n in (1, 2, 3):
                    if len(run) >= 2 * n and all(_alike(run[-i].key, run[-n - i].key, inner[-i], inner[-n - i]) for i in range(1, n + 1)):
                        for i in range(1, n + 1):
                            run[-n - i].nodes += run[-i].nodes
                            inner[-n - i] |= inner[-i]
                        del run[-n:], inner[-n:]
                        break
        slot.children = run
        todo.extend(run)
    return top


def _alike(key_a: str, key_b: str, inner_a: frozenset, inner_b: frozenset) -> bool:
    return key_a == key_b and (2 * len(inner_a & inner_b) > max(len(inner_a), len(inner_b)) or not inner_a and not inner_b)


def _blocks(node: Node):
    todo = node.parts[::-1]
    while todo:
        part = todo.pop()
        if isinstance(part, Node):
            if part.tag in _INLINE and not part.words:
                todo.extend(reversed(part.parts))
            else:
                yield part


def _own_text(node: Node, out: list[str], links: list[int], inside_link: bool) -> None:
    todo = [(part, inside_link) for part in reversed(node.parts)]
    while todo:
        part, inside = todo.pop()
        if isinstance(part, str):
            out.append(part)
            if inside:
                links[0] += len(part)
        elif part.tag in _INLINE and not part.words:
            todo.extend((p, inside or part.tag == "a") for p in reversed(part.parts))


def preorder(slot: Slot) -> list[Slot]:
    out, todo = [], [slot]
    while todo:
        s = todo.pop()
        out.append(s)
        todo.extend(reversed(s.children))
    return out


def _dump(top: Slot) -> str:
    """Keys and numbers of children in preorder, as flat JSON: nesting would bound the depth."""
    slots = preorder(top)
    return json.dumps([[s.key for s in slots], [len(s.children) for s in slots]], separators=(",", ":"), ensure_ascii=False)


def _read(shape: str) -> Slot:
    keys, sizes = json.loads(shape)
    top, parents = None, []
    for key, size in zip(keys, sizes, strict=True):
        data = [key, []]
        if parents:
            parents[-1][0].append(data)
            parents[-1][1] -= 1
        else:
            top = data
        parents.append([data[1], size])
        while parents and not parents[-1][1]:
            parents.pop()
    return _load(top)


def _load(data: list) -> Slot:
    top = Slot(data[0])
    todo = [(top, data[1])]
    while todo:
        slot, inner = todo.pop()
        slot.children = [Slot(d[0]) for d in inner]
        todo.extend((child, d[1]) for child, d in zip(slot.children, inner, strict=True))
    return top


class _Shapes:
    """Distinct subtrees of both sides of an alignment; what two of them match is worked out once, however often they occur."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.key: list[str] = []
        self.size: list[int] = []
        self.below: list[np.ndarray] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.paths: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def number(self, top: Slot) -> dict[int, int]:
        """Shape of every slot, by its id."""
        of: dict[int, int] = {}
        for slot in reversed(preorder(top)):
            shape = slot.key, tuple(of[id(c)] for c in slot.children)
            if shape not in self.known:
                self.known[shape] = len(self.key)
                self.key.append(slot.key)
                self.below.append(np.array(shape[1], dtype=np.int64))
                self.size.append(1 + sum(self.size[c] for c in shape[1]))
            of[id(slot)] = self.known[shape]
        return of

    def _worth(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of every two children of p and q: a small matrix of distinct shapes, and the row or column of each child."""
        (rows, of_row), (columns, of_column) = (np.unique(self.below[s], return_inverse=True) for s in (p, q))
        return np.array([[self.weights.get((x, y), 0) for y in columns.tolist()] for x in rows.tolist()], dtype=np.int64), of_row, of_column

    def weigh(self, p: int, q: int) -> int:
        todo = [(p, q, False)]
        while todo:
            x, y, ready = todo.pop()
            if (x, y) in self.weights:
                continue
            if x == y or not len(self.below[x]) or not len(self.below[y]):
                self.weights[x, y] = self.size[x] if x == y else 1
            elif not ready:
                todo.append((x, y, True))
                at: dict[str, list[int]] = {}
                for c in set(self.below[y].tolist()):
                    at.setdefault(self.key[c], []).append(c)
                todo += [(c, d, False) for c in set(self.below[x].tolist()) for d in at.get(self.key[c], ()) if (c, d) not in self.weights]
            else:
                self.weights[x, y] = 1 + int(_last_row(*self._worth(x, y))[-1])
        return self.weights[p, q]

    def path(self, p: int, q: int) -> list[tuple[int, int]]:
        """Places of the children of p and q that a best match pairs, in order."""
        if (p, q) not in self.paths:
            if p == q:
                self.paths[p, q] = [(i, i) for i in range(len(self.below[p]))]
            elif not len(self.below[p]) or not len(self.below[q]):
                self.paths[p, q] = []
            else:
                self.paths[p, q] = _best_path(*self._worth(p, q))
        return self.paths[p, q]


def _last_row(worth: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Best sum of an order-preserving pairing of all rows with the first 0, 1, ... columns."""
    best = np.zeros(len(columns) + 1, dtype=np.int64)
    for r in rows.tolist():
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + worth[r][columns]), out=best[1:])
    return best


def _best_path(worth: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a best order-preserving pairing.

    Lists whose table would be large are halved where a best pairing of the halves meets, so
    memory follows the longer list and not the product.
    """
    out, todo = [], [(0, len(rows), 0, len(columns))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > _TABLE and b - a > 1:
            middle = (a + b) // 2
            before = _last_row(worth, rows[a:middle], columns[c:d])
            after = _last_row(worth, rows[middle:b][::-1], columns[c:d][::-1])[::-1]
            cut = c + int((before + after).argmax())
            todo += [(a, middle, c, cut), (middle, b, cut, d)]
            continue
        table = [np.zeros(d - c + 1, dtype=np.int64)]
        for r in rows[a:b].tolist():
            row = table[-1].copy()
            np.maximum.accumulate(np.maximum(row[1:], table[-1][:-1] + worth[r][columns[c:d]]), out=row[1:])
            table.append(row)
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return sorted(out)


def match(a: Slot, b: Slot, pairs: list | None = None) -> int:
    """Simple tree matching: size of the largest order-preserving match of equal keys; collects (a, b) pairs."""
    if a.key != b.key:
        return 0
    shapes = _Shapes()
    of_a, of_b = shapes.number(a), shapes.number(b)
    found = shapes.weigh(of_a[id(a)], of_b[id(b)])
    if pairs is not None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            pairs.append((x, y))
            todo.extend((x.children[i], y.children[j]) for i, j in shapes.path(of_a[id(x)], of_b[id(y)]))
    return found


def _measured(top: Slot) -> list[tuple[int, int, int]]:
    """(text hash, text length, link length) of the own text of every slot in preorder."""
    stats = []
    for slot in preorder(top):
        pieces: list[str] = []
        links = [0]
        for node in slot.nodes:
            _own_text(node, pieces, links, node.tag == "a")
        text = " ".join("".join(pieces).split())
        stats.append((xxhash.xxh3_64_intdigest(text) - (1 << 63), len(text), min(links[0], len(text))))
    return stats


def profile(source: str | None) -> tuple[str, list[tuple[int, int, int]]]:
    """Skeleton as JSON, and (text hash, text length, link length) of its nodes in preorder."""
    top = skeleton(parse(source))
    return _dump(top), _measured(top)


def _align(shape: str, reference: str) -> list[tuple[int, int]]:
    """(node, reference node) pairs, as preorder numbers."""
    if shape == reference:
        return [(i, i) for i in range(len(json.loads(shape)[0]))]
    a, b = _read(shape), _read(reference)
    number_a, number_b = ({id(s): i for i, s in enumerate(preorder(t))} for t in (a, b))
    pairs: list = []
    match(a, b, pairs)
    return [(number_a[id(x)], number_b[id(y)]) for x, y in pairs]


def _best(shape: str, references: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Number of the reference that a skeleton matches best, and the pairs."""
    if shape in references:
        return references.index(shape), _align(shape, shape)
    found = [_align(shape, r) for r in references]
    k = max(range(len(found)), key=lambda i: (len(found[i]), -i))
    return k, found[k]


_STATS = pa.list_(pa.struct([("hash", pa.int64()), ("len", pa.int64()), ("links", pa.int64())]))


def _profiles(batches):
    for batch in batches:
        shapes, stats, pages = [], [], []
        for source in texts_in(batch.column("html")):
            shape, own = profile(source)
            shapes.append(shape)
            stats.append([{"hash": h, "len": n, "links": k} for h, n, k in own])
            pages.append(xxhash.xxh3_64_intdigest(f"{shape} {[h for h, _, _ in own]}") - (1 << 63))
        yield pa.record_batch([batch.column("host"), pa.array(pages, pa.int64()), pa.array(shapes, pa.string()), pa.array(stats, _STATS)], names=["host", "page", "shape", "stats"])


def _aligned(batches):
    known: dict[tuple, tuple[int, list[tuple[int, int]]]] = {}
    names, kinds = ["host", "ref", "node", "hash", "len", "links"], (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        out = []
        for host, shape, references, stats in zip(*(texts_in(batch.column(c)) for c in ("host", "shape", "references", "stats")), strict=True):
            key = shape, tuple(references)
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                known[key] = _best(shape, references)
            ref, pairs = known[key]
            out += [(host, ref, r, stats[i]["hash"], stats[i]["len"], stats[i]["links"]) for i, r in pairs]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _by_host(rows: DataFrame, few: DataFrame, salt: Column) -> DataFrame:
    """Join by host with one row a host; a host's ``rows`` are dealt over ``_SALTS`` keys."""
    many = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(_SALTS)).cast("int")).join(many, ["host", "_salt"]).drop("_salt")


def wrappers(pages: DataFrame, references: int = 4) -> DataFrame:
    """host, and wrappers: for each of its references (skeletons) the template nodes and each node's mean text and link length."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(_profiles, "host string, page long, shape string, stats array<struct<hash:long,len:long,links:long>>")
    shapes = materialize(rows, "page-shapes").dropDuplicates(["host", "page"])
    ranked = Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("size"), F.desc("shape"))
    counted = shapes.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.max(F.size("stats")).alias("size"))
    first = counted.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= references)
    first = materialize(first.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "shape"))), lambda x: x["shape"]).alias("references")), "references")  # at most ``references`` of a host
    joined = _by_host(shapes, first, F.col("page")).select("host", "shape", "references", "stats")
    nodes = joined.mapInArrow(_aligned, "host string, ref int, node int, hash long, len long, links long")
    per_hash = nodes.groupBy("host", "ref", "node", "hash").agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.sum("links").alias("links"))
    per_node = per_hash.groupBy("host", "ref", "node").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("len").alias("len"), F.sum("links").alias("links"))
    fixed = (F.col("most") >= _ENOUGH) & (F.col("most") >= _SAME_SHARE * F.col("n")) & (F.col("len") > 0)
    node = F.struct("node", fixed.alias("fixed"), (F.col("len") / F.col("n")).alias("len"), (F.col("links") / F.col("n")).alias("links"), F.col("n").alias("n"))
    per_ref = per_node.groupBy("host", "ref").agg(F.collect_list(node).alias("nodes"))  # bounded by the reference
    per_host = per_ref.groupBy("host").agg(F.collect_list(F.struct("ref", "nodes")).alias("refs"))
    return materialize(per_host.join(first, "host").select("host", "references", "refs"), "wrappers")


def _is_out(node: Node, marks: bool = True) -> bool:
    return node.tag in _OUT or node.hidden or marks and node.marked


def _collect(node: Node, template: set[int], out: list[str], marks: bool = True) -> None:
    """Text of a node without what is left out; of a template node only its own text goes, its varying blocks stay.

    Marks do not apply to an article element that is not inside another one.
    """
    todo: list[tuple] = [(part, id(node) in template, node.tag == "article") for part in reversed(node.parts)]
    while todo:
        part, mute, within = todo.pop()
        if isinstance(part, str):
            if not mute:
                out.append(part)
        elif part.tag in ("br", "hr"):
            out.append("\n")
        elif not _is_out(part, marks and (within or part.tag != "article")):
            inline = part.tag in _INLINE
            if not inline:
                out.append("\n")
                todo.append(("\n", False, within))
            mute = mute and inline and not part.words or id(part) in template
            within = within or part.tag == "article"
            todo.extend((p, mute, within) for p in reversed(part.parts))


def content_slots(top: Slot, varying: dict[int, float]) -> tuple[list[Slot], bool]:
    """The slots that hold the content, by the varying text outside links of each slot (by its id), and whether marks count.

    Marks count unless nothing is left with them.
    """
    order: list[tuple[Slot, Slot | None, bool]] = [(top, None, False)]
    for slot, _, within in order:  # grows
        order.extend((c, slot, within or slot.tag == "article") for c in slot.children)
    above = {id(s): parent for s, parent, _ in order}
    for marks in (True, False):
        total: dict[int, float] = {}
        for slot, _, within in reversed(order):
            out = slot.tag in _OUT or slot.says("~") or marks and slot.says("!") and (within or slot.tag != "article")
            total[id(slot)] = 0.0 if out else varying.get(id(slot), 0.0) + sum(total[id(c)] for c in slot.children)
        if total[id(top)] > 0:
            break
    else:
        return [], False
    def has_heading(slot: Slot) -> bool:
        return any(s.tag in _HEADINGS and total[id(s)] > 0 for s in preorder(slot))

    node = top
    while True:
        best = max((c for c in node.children if c.tag not in _TEXTUAL), key=lambda c: total[id(c)], default=None)
        headed = any(c.tag in _HEADINGS and total[id(c)] > 0 for c in node.children)  # its text belongs to the heading
        if best is None or headed:
            break
        whole = varying.get(id(node), 0.0) == 0 and not any(total[id(c)] > 0 for c in node.children if c is not best)
        if not whole and not (_of_the_page(node) and total[id(best)] >= _HOLDS * total[id(node)] and has_heading(best)):
            break
        node = best
    around, up = None, node
    while up is not None:
        if up.says("+") and not (around is not None and around.tag == "article" and up.tag != "article"):
            around = up
        up = above[id(up)]
    if around is not None and around.tag == "article":
        return [around], marks
    inside = _outermost(node, total, {"article"}) or ([around] if around is not None else _outermost(node, total, None))
    if inside and sum(total[id(s)] for s in inside) >= _SEMANTIC * total[id(node)]:
        return inside, marks
    return [node], marks


def _of_the_page(slot: Slot) -> bool:
    """Whether a slot is the page's own frame, where landmarks stand beside the article, and no part of the article."""
    return slot.tag in ("#page", "html", "body") or any(c.tag in _LANDMARKS or c.says("!") for c in slot.children)


def _outermost(node: Slot, total: dict[int, float], tags: set[str] | None) -> list[Slot]:
    """Outermost slots below ``node`` with content that are articles, or main elements of any kind."""
    found, todo = [], node.children[::-1]
    while todo:
        slot = todo.pop()
        if total[id(slot)] > 0:
            if slot.says("+") and (tags is None or slot.tag in tags):
                found.append(slot)
            else:
                todo.extend(slot.children[::-1])
    return found


class Wrapper:
    """References of a host, with their template, link and content slots as preorder numbers."""

    def __init__(self, references: list[str], refs: list[dict]):
        self.references, self.slots, self.parts = references, [_read(r) for r in references], []
        nodes = {r["ref"]: r["nodes"] for r in refs}
        for k, top in enumerate(self.slots):
            slots = preorder(top)
            number = {id(s): i for i, s in enumerate(slots)}
            own = nodes.get(k, [])
            template = {x["node"] for x in own if x["fixed"]}
            linked = {x["node"] for x in own if x["len"] and x["links"] > 0.6 * x["len"]}
            content, marks = content_slots(top, {id(slots[x["node"]]): x["n"] * max(0.0, x["len"] - x["links"]) for x in own if not x["fixed"]})
            self.parts.append((number, template, linked, {number[id(s)] for s in content}, marks))

    def align(self, top: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
        shape = _dump(top)
        if shape in self.references:
            k = self.references.index(shape)
            return k, list(zip(preorder(top), preorder(self.slots[k]), strict=True))
        found: list[list] = [[] for _ in self.slots]
        for pairs, reference in zip(found, self.slots, strict=True):
            match(top, reference, pairs)
        k = max(range(len(found)), key=lambda i: (len(found[i]), -i))
        return k, found[k]


def extract(source: str | None, wrapper: Wrapper | None) -> str:
    """Main text of a page under its host's wrapper; without one the page is its own reference."""
    if not source:
        return ""
    root = parse(source)
    top = skeleton(root)
    template: set[int] = set()
    linked: set[int] = set()
    content: list[Node] = []
    marks = True
    if wrapper:
        k, pairs = wrapper.align(top)
        number, fixed, links, chosen, marks = wrapper.parts[k]
        for mine, reference in pairs:
            at = number[id(reference)]
            if at in fixed and mine.tag not in ("html", "body", "#page"):
                template.update(id(n) for n in mine.nodes)
            if at in links:
                linked.update(id(n) for n in mine.nodes)
            if at in chosen:
                content += mine.nodes
    text = _joined(content, template, linked, marks)
    if not text:
        own = {id(s): float(max(0, n - k)) for s, (_, n, k) in zip(preorder(top), _measured(top), strict=True) if id(s.nodes[0]) not in template}
        slots, marks = content_slots(top, own)
        text = _joined([n for s in slots for n in s.nodes], template, linked, marks)
    return text


def _joined(nodes: list[Node], template: set[int], linked: set[int], marks: bool = True) -> str:
    """Text of the nodes; outside article and main elements, blocks that are links on the host's pages go."""
    out: list[str] = []
    for node in nodes:
        out.append("\n")
        _collect(node, template if node.main else template | linked, out, marks)
    return " ".join(html.unescape("".join(out)).split())


def main_text(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    small_batches(pages.sparkSession)
    found = wrappers(pages)
    size = found.agg(F.sum(F.length(F.array_join("references", "")) + 64 * F.size(F.flatten("refs.nodes")))).first()[0] or 0
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    if size <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r.asDict(recursive=True) for r in found.collect()})

        def run(htmls: pa.Array, hosts: pa.Array) -> pa.Array:
            loaded: dict[str, Wrapper] = {}
            out = []
            for source, host in zip(texts_in(htmls), texts_in(hosts), strict=True):
                if host not in loaded and host in known.value:
                    if len(loaded) > 500:
                        loaded.clear()
                    loaded[host] = Wrapper(known.value[host]["references"], known.value[host]["refs"])
                out.append(extract(source, loaded.get(host)))
            return pa.array(out, pa.string())

        texts = rows.select("page_id", "url", F.arrow_udf(run, "string")("html", "host").alias("text"))
    else:

        def run_joined(htmls: pa.Array, hosts: pa.Array, references: pa.Array, refs: pa.Array) -> pa.Array:
            last, loaded, out = None, None, []
            for source, host, *own in zip(*(texts_in(c, 16) for c in (htmls, hosts, references, refs)), strict=True):
                if loaded is None or host != last:
                    last, loaded = host, Wrapper(*own)
                out.append(extract(source, loaded))
            return pa.array(out, pa.string())

        met = _by_host(rows, found, F.xxhash64("page_id", "html"))
        texts = met.select("page_id", "url", F.arrow_udf(run_joined, "string")("html", "host", "references", "refs").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
