"""Hard negatives from cover trees over norm-augmented vectors.

Every vector gets one more entry, sqrt(M^2 - |x|^2), so that all have the length M of the
longest; a larger inner product with an anchor is then a smaller angle to it.  Rows are dealt
to blocks of a bounded size by their nearest pivot, and every block becomes a cover tree: the
points of a node are covered by children of at most half its radius, chosen farthest first.
The covering radius of a node, as an angle, bounds the inner product of an anchor with
everything below it from both sides.

An anchor descends a tree best first.  Nodes whose bounds lie outside all of its score windows,
or below what it has found already, are skipped; points that are reached are verified by their
exact inner product.  Anchors first search their own block, which gives every one a lower bound
for its positives; then the blocks whose root can beat that bound; then, for the windows that
the positives set, the blocks whose root overlaps a window.  Blocks are met by groups of anchors
of a bounded size, roots are looked at in slices of a bounded number, and the k best of every
task are cut before they are shuffled.

The pivots come from a sample of at most ``pivots`` rows; they decide which rows share a block
and nothing else.  Every row is indexed and the result is exact.

Defined cases: vectors are taken as ``vectors.whole_numbers`` says, shorter ones padded with
zeros; a null label takes no part; repeated rows are different rows, so a copy of the anchor
can be its positive; a null id is the largest one in ties and never an anchor's; scores beyond
a long are held at its ends; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import discard, materialize
from leafmill.llm.vectors import exact, matrix, padded, whole_numbers

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Share of the largest possible score that rounding of a bound may come to.
_SLACK = 1e-6
_LOOSE = 16
_SLICE_BYTES = 4 << 20


def _smallest(x: np.ndarray) -> np.ndarray:
    peak = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if 0 <= peak < 1 << 15 else np.int32 if 0 <= peak < 1 << 31 else np.int64)


class Tree:
    """A cover tree over the rows of one block; node 0 is the root.

    Children of a node are contiguous, and so are its loose points, those that no child of more
    than ``_LOOSE`` points covers.
    """

    ARRAYS = ("x", "row", "id", "has_id", "label", "centre", "angle", "children", "loose", "only")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, x: np.ndarray, length: float, **rows: np.ndarray) -> Tree:
        """``length`` is M, the length that all vectors are augmented to."""
        n = len(x)
        unit = np.empty((n, x.shape[1] + 1))
        unit[:, :-1] = x.astype(np.float64) / (length or 1.0)
        unit[:, -1] = np.sqrt(np.maximum(0.0, 1.0 - (unit[:, :-1] ** 2).sum(axis=1)))
        centre, angle, children, loose, order, labels = [], [], [], [], [], rows["label"]
        only: list[int | None] = []
        middle = int((unit @ unit.mean(axis=0)).argmax())
        waiting: list[tuple[np.ndarray, int]] = [(np.arange(n), middle)]
        at = 0
        while at < len(waiting):  # breadth first, so that siblings are neighbours
            points, c = waiting[at]
            away = np.arccos(np.clip(unit[points] @ unit[c], -1.0, 1.0))
            reach = float(away.max())
            centre.append(c)
            angle.append(reach)
            kinds = labels[points]
            only.append(int(kinds[0]) if (kinds == kinds[0]).all() else None)
            first = len(waiting)
            bare = [points] if reach < 1e-7 or len(points) <= _LOOSE else []
            if not bare:
                for group, mid in cls._covers(unit, points, c, away, reach / 2):
                    if len(group) > _LOOSE:
                        waiting.append((group, mid))
                    else:
                        bare.append(group)
            children.append((first, len(waiting)))
            start = sum(map(len, order))
            order += bare
            loose.append((start, start + sum(map(len, bare))))
            at += 1
        turn = np.concatenate(order)
        back = np.empty(n, dtype=np.int64)
        back[turn] = np.arange(n)
        known = np.array([o is not None for o in only])
        return cls(
            x=_smallest(x[turn]), **{k: v[turn] for k, v in rows.items()}, centre=back[np.array(centre)], angle=np.array(angle), children=np.array(children), loose=np.array(loose),
            only=np.stack([known, [o or 0 for o in only]], axis=1).astype(np.int64),
        )

    @staticmethod
    def _covers(unit: np.ndarray, points: np.ndarray, c: int, away: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, int]]:
        """Groups of ``points`` within ``radius`` of a centre: the node's own first, then always the point farthest from all."""
        near, of, centres = away.copy(), np.zeros(len(points), dtype=np.int64), [c]
        mine = unit[points]
        while near.max() > radius:
            far = int(near.argmax())
            to = np.arccos(np.clip(mine @ mine[far], -1.0, 1.0))
            to[far] = 0.0
            closer = to < near
            near[closer], of[closer] = to[closer], len(centres)
            centres.append(int(points[far]))
        by = np.argsort(of, kind="stable")
        for group in np.split(points[by], np.flatnonzero(np.diff(of[by])) + 1):
            yield group, centres[int(of[np.searchsorted(points, group[0])])]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> Tree:
        with np.load(io.BytesIO(packed), allow_pickle=False) as stored:
            return cls(**{k: stored[k] for k in cls.ARRAYS})


def bounds(score: np.ndarray, angle: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product below nodes whose centres score ``score``; ``most`` is |anchor| M."""
    if most <= 0:
        return np.zeros(len(score)), np.zeros(len(score))
    to = np.arccos(np.clip(score.astype(np.float64) / most, -1.0, 1.0))
    slack = most * _SLACK + 1e-6
    return most * np.cos(np.minimum(np.pi, to + angle)) - slack, most * np.cos(np.maximum(0.0, to - angle)) + slack


class Found:
    """The ``k`` best scores in each of an anchor's windows, ties by id."""

    def __init__(self, low: list[int], high: list[int], k: int):
        self.low, self.high, self.k = low, high, k
        self.best: list[list[tuple]] = [[] for _ in low]
        self.floor = list(low)

    def wants(self, lowest: float, highest: float) -> bool:
        return any(highest >= f and lowest <= h for f, h in zip(self.floor, self.high, strict=True))

    def wanted(self, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lowest), dtype=bool)
        for f, h in zip(self.floor, self.high, strict=True):
            out |= (highest >= f) & (lowest <= h)
        return out

    def add(self, scores: np.ndarray, tree: Tree, at: np.ndarray) -> None:
        for j, high in enumerate(self.high):
            hit = np.flatnonzero((scores >= self.floor[j]) & (scores <= high))
            if len(hit) > 4 * self.k:  # what the k-th of them beats can be left at once
                cut = np.partition(scores[hit].astype(np.float64), len(hit) - self.k)[len(hit) - self.k]
                hit = hit[scores[hit].astype(np.float64) >= cut]
            if len(hit):
                rows = at[hit]
                new = [(-int(s), not h, int(i), int(r)) for s, h, i, r in zip(scores[hit], tree.has_id[rows], tree.id[rows], tree.row[rows], strict=True)]
                self.best[j] = heapq.nsmallest(self.k, self.best[j] + new)
                if len(self.best[j]) == self.k:
                    self.floor[j] = max(self.floor[j], -self.best[j][-1][0])


def descend(tree: Tree, x: np.ndarray, q: np.ndarray, most: float, row: int, label: int, same: bool, found: Found) -> None:
    """Best-first descent of one anchor; ``x`` are the tree's vectors in the kind of number that keeps products exact."""

    def fits(only: np.ndarray) -> np.ndarray:
        return (only[:, 0] == 0) | ((only[:, 1] == label) == same)

    root = x[tree.centre[:1]] @ q
    lowest, highest = bounds(root, tree.angle[:1], most)
    heap = [(-float(highest[0]), 0, float(lowest[0]))] if fits(tree.only[:1])[0] else []
    while heap:
        highest_, node, lowest_ = heapq.heappop(heap)
        if not found.wants(lowest_, -highest_):
            continue
        a, b = tree.loose[node]
        if b > a:
            at = np.arange(a, b)
            at = at[((tree.label[a:b] == label) == same) & (tree.row[a:b] != row)]
            if len(at):
                scores = x[at] @ q
                found.add(np.clip(scores, _LOW, _HIGH) if scores.dtype == object else scores.astype(np.int64), tree, at)
        a, b = tree.children[node]
        if b > a:
            lowest, highest = bounds(x[tree.centre[a:b]] @ q, tree.angle[a:b], most)
            for k in np.flatnonzero(found.wanted(lowest, highest) & fits(tree.only[a:b])).tolist():
                heapq.heappush(heap, (-float(highest[k]), int(a) + k, float(lowest[k])))


def windows_of(positives: list[int] | None, floor: int | None, low_percent: int) -> tuple[list[int], list[int]]:
    """Score windows: [low_percent % of a positive's score, that score] for each, or everything from ``floor`` on."""
    if positives is None:
        return [_LOW if floor is None else floor], [_HIGH]
    return [-((-low_percent * p) // 100) for p in positives], list(positives)


_TASK = "block long, part int, arow long, q array<long>, label long, floor long, positives array<long>"
_HIT = "arow long, j int, score long, id long, row long"


def _search(_, trees: pa.Table, anchors: pa.Table, length: float, k: int, low_percent: int) -> pa.Table:
    """The ``k`` best rows of one block in each window of each anchor; anchors with windows look for other labels."""
    out: list[list] = [[], [], [], [], []]
    if len(trees) and len(anchors):
        tree = Tree.unpack(trees.column("tree")[0].as_py())
        qs = matrix(anchors.column("q"), tree.x.shape[1])
        peak = float(max(np.abs(tree.x.astype(np.float64)).max(initial=0), np.abs(qs.astype(np.float64)).max(initial=0)))
        peak = peak * peak * max(1, qs.shape[1])
        x, queries = exact(tree.x, peak), exact(qs, peak)
        lengths = np.sqrt((qs.astype(np.float64) ** 2).sum(axis=1))
        given = zip(*(anchors.column(c).to_pylist() for c in ("arow", "label", "floor", "positives")), strict=True)
        for q, norm, (arow, label, floor, positives) in zip(queries, lengths, given, strict=True):
            found = Found(*windows_of(positives, floor, low_percent), k)
            descend(tree, x, q, float(norm) * length, arow, label, positives is None, found)
            for j, best in enumerate(found.best):
                for score, no_id, id_, row in best:
                    for column, value in zip(out, (arow, j, -score, None if no_id else id_, row), strict=True):
                        column.append(value)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["arow", "j", "score", "id", "row"])


def _grown(key: tuple, rows: pa.Table, length: float) -> pa.Table:
    """One block's tree, and its root for the directory."""
    rows = rows.sort_by("row")
    ids = rows.column("id")
    tree = Tree.build(
        matrix(rows.column("x")), length, row=np.asarray(rows.column("row")), id=np.asarray(ids.fill_null(0)), has_id=np.asarray(ids.is_valid()), label=np.asarray(rows.column("label"))
    )
    root = tree.x[tree.centre[0]].astype(np.int64).tolist()
    cells = {"block": pa.array([key[0].as_py()], pa.int64()), "centre": pa.array([root], pa.list_(pa.int64())), "angle": pa.array([float(tree.angle[0])]), "one_label": pa.array([bool(tree.only[0, 0])]), "label": pa.array([int(tree.only[0, 1])], pa.int64()), "tree": pa.array([tree.pack()], pa.binary())}
    return pa.table(cells)


def _dealt(batches, pivots: np.ndarray, chunks: np.ndarray | None, first: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows with their nearest pivot, or with the block that they belong to where the pivots' chunks are known."""
    half = (pivots.astype(np.float64) ** 2).sum(axis=1) / 2
    for batch in batches:
        x = matrix(batch.column("x"), pivots.shape[1]).astype(np.float64)
        near = np.concatenate([np.zeros(0, dtype=np.int64), *((x[a : a + 1024] @ pivots.T - half).argmax(axis=1) for a in range(0, len(x), 1024))])
        if chunks is None:
            yield pa.record_batch([pa.array(near)], names=["pivot"])
        else:
            salt = (np.asarray(batch.column("row")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = first[near] + (salt % chunks[near].astype(np.uint64)).astype(np.int64)
            yield pa.record_batch([pa.array(block), *batch.columns], names=["block", *batch.schema.names])


def _reached(batches, roots: dict[str, np.ndarray], length: float, low_percent: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(block, anchor) of a slice of blocks wherever the root's bounds overlap a window of the anchor."""
    centres = roots["centre"].astype(np.float64)
    for batch in batches:
        qs = matrix(batch.column("q"), centres.shape[1]).astype(np.float64)
        for i in range(len(batch)):
            floor, positives, label, home = (batch.column(c)[i].as_py() for c in ("floor", "positives", "label", "home"))
            found = Found(*windows_of(positives, floor, low_percent), 1)
            most = float(np.sqrt(qs[i] @ qs[i])) * length
            hit = found.wanted(*bounds(centres @ qs[i], roots["angle"], most)) & (~roots["one_label"] | ((roots["label"] == label) == (positives is None)))
            if positives is None:
                hit &= roots["block"] != home
            blocks = roots["block"][hit]
            if len(blocks):
                row = pa.array(np.full(len(blocks), i))
                part = pa.array(np.full(len(blocks), batch.column("arow")[i].as_py() % parts, dtype=np.int32))
                yield pa.record_batch([pa.array(blocks), part, *(batch.column(c).take(row) for c in ("arow", "q", "label", "floor", "positives"))], names=["block", "part", "arow", "q", "label", "floor", "positives"])


class Forest:
    """Stored cover trees of all rows, and the searches over them."""

    def __init__(self, rows: DataFrame, block_rows: int = 2048, pivots: int = 1024):
        self.spark = rows.sparkSession
        facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("m"), F.max(F.size("x")).alias("dims")).first()
        self.length, self.dims, self.parts = float(np.sqrt(facts.m or 0.0)) * (1 + 1e-12), facts.dims, 1
        wanted = min(pivots, max(1, facts.n // block_rows), max(1, _SLICE_BYTES // (8 * max(1, facts.dims))))
        sample = rows.select("x", F.xxhash64("row").alias("h")).orderBy("h").limit(wanted).collect()
        at = np.array([r.x for r in sample], dtype=np.int64).reshape(len(sample), facts.dims)
        held = {r.pivot: r["count"] for r in rows.select("x").mapInArrow(lambda b: _dealt(b, at, None, None), "pivot long").groupBy("pivot").count().collect()}
        chunks = np.array([-(-held.get(p, 0) // block_rows) or 1 for p in range(len(at))], dtype=np.int64)
        first = np.cumsum(chunks) - chunks
        self.blocks = int(chunks.sum())
        self.rows = materialize(rows.mapInArrow(lambda b: _dealt(b, at, chunks, first), "block long, row long, id long, label long, x array<long>"), "mine-rows")
        length = self.length
        self.trees = materialize(self.rows.groupBy("block").applyInArrow(lambda key, t: _grown(key, t, length), "block long, centre array<long>, angle double, one_label boolean, label long, tree binary"), "mine-trees")

    def _best(self, tasks: DataFrame, k: int, low_percent: int) -> DataFrame:
        length = self.length
        trees = self.trees.select("block", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), "tree")
        hits = trees.groupBy("block", "part").cogroup(tasks.groupBy("block", "part")).applyInArrow(lambda key, a, b: _search(key, a, b, length, k, low_percent), _HIT)
        return top(hits, k)

    def home(self, anchors: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of the same label in each anchor's own block."""
        own = anchors.select(F.col("home").alias("block"), (F.col("arow") % self.parts).cast("int").alias("part"), "arow", "q", "label", F.lit(None).cast("long").alias("floor"), F.lit(None).cast("array<long>").alias("positives"))
        return self._best(own, k, 0)

    def everywhere(self, anchors: DataFrame, k: int, low_percent: int = 0) -> DataFrame:
        """The ``k`` best in each window over all blocks whose root can hold one; looks at the roots slice by slice."""
        length, parts, per = self.length, self.parts, max(1, _SLICE_BYTES // (8 * (self.dims + 4)))
        tasks = None
        for a in range(0, self.blocks, per):
            roots = self.trees.where(F.col("block").between(a, a + per - 1)).select("block", "centre", "angle", "one_label", "label").toArrow()
            held = {c: np.asarray(roots.column(c)) for c in ("block", "angle", "one_label", "label")} | {"centre": matrix(roots.column("centre"), self.dims)}
            reached = anchors.mapInArrow(lambda b, held=held: _reached(b, held, length, low_percent, parts), _TASK)
            tasks = reached if tasks is None else tasks.unionByName(reached)
        return self._best(tasks, k, low_percent)


def top(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("arow", "j").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, anchors_a_part: int = 4096) -> DataFrame:
    """Hard negatives of every anchor and each of its first ``positives`` positives.

    ``rows`` has id, label (longs) and ``x``; ``anchor`` picks the anchors by those.  A negative
    has another label and a score from ``low_percent`` % of the positive's up to the positive's.
    """
    numbered = materialize(padded(rows).select(F.monotonically_increasing_id().alias("row"), "id", "label", "x").where("label IS NOT NULL"), "mine-numbered")
    if numbered.where(anchor).isEmpty():
        discard(numbered)
        return rows.sparkSession.createDataFrame([], _OUT)
    forest = Forest(numbered)
    anchors = forest.rows.where(anchor).select(F.col("row").alias("arow"), F.col("id").alias("anchor_id"), F.col("label"), F.col("x").alias("q"), F.col("block").alias("home"))
    forest.parts = max(1, -(-anchors.count() // anchors_a_part))
    home = materialize(forest.home(anchors, positives).select("arow", "j", "score", "id", "row"), "mine-home")
    floors = home.groupBy("arow").agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor"))
    first = anchors.join(floors, "arow", "left").withColumn("positives", F.lit(None).cast("array<long>"))
    far = forest.everywhere(first, positives).select("arow", "j", "score", "id", "row")
    best = materialize(top(home.unionByName(far), positives), "mine-positives")
    windows = best.groupBy("arow").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("positives"))
    second = anchors.join(windows, "arow").withColumn("floor", F.lit(None).cast("long"))
    hits = forest.everywhere(second, negatives, low_percent)
    named = hits.select("arow", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), (F.col("j") + 1).alias("p"))
    pairs = best.select("arow", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = materialize(named.join(pairs, ["arow", "p"]).join(anchors.select("arow", "anchor_id"), "arow").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")
    discard(numbered, forest.rows, forest.trees, home, best)
    return out


def labelled(vectors: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, x) of the rows that take part."""
    return whole_numbers(vectors, vec_col, scale, id=F.col(id_col).cast("long"), label=label.cast("long")).where("label IS NOT NULL")
