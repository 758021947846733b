from collections import defaultdict

import numpy as np
import pytest
from leafmill.llm import hard_negatives as hn
from leafmill.llm import queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block string, x string, id string, part string"


def by_hand(rows, anchors, positives=5, negatives=5, low=80):
    """Every anchor against every row; ``rows`` are (id, label, x)."""
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (aid, alabel, ax) in enumerate(rows):
        if not anchors(aid):
            continue
        scored = [(order(sum(p * q for p, q in zip(ax, x, strict=False)), i), i, label) for b, (i, label, x) in enumerate(rows) if b != a]
        for (ps, *_), pid, _ in sorted([s for s in scored if s[2] == alabel], key=lambda s: s[0])[:positives]:
            good = sorted([s for s in scored if s[2] != alabel and low * -ps <= 100 * -s[0][0] <= 100 * -ps], key=lambda s: s[0])[:negatives]
            out += [(aid, pid, rank, nid, -ps, -key[0]) for rank, (key, nid, _) in enumerate(good, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, *"yyyyy") for i, v, lab in rows], SCHEMA)


def tie_rows(seed=3, n=700):
    """Clusters, copies and small whole numbers, so that scores tie; a third of the rows are one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-6, 7, (5, 6))
    x = centres[rng.integers(0, 5, n)] + rng.integers(-1, 2, (n, 6))
    x[: n // 3] = centres[0]
    rng.shuffle(x)
    return [(i, [float(c) for c in v], int(lab)) for i, (v, lab) in enumerate(zip(x, rng.integers(0, 4, n), strict=True))]


@pytest.mark.parametrize("block_rows", [64, 100_000])
def test_equal_to_brute_force(spark, block_rows, monkeypatch):
    rows = tie_rows()
    plain = [(i, lab, [int(np.floor(4 * c)) for c in v]) for i, v, lab in rows]
    monkeypatch.setattr(hn, "_SLICE_BYTES", 400)  # several slices of roots, few pivots
    monkeypatch.setattr(hn.Forest.__init__, "__defaults__", (block_rows, 1024))
    df = hn.mine(hn.labelled(frame(spark, rows).repartition(5), F.col("label"), scale=4), F.col("id") % 50 == 0, anchors_a_part=4)
    assert got(df) == by_hand(plain, lambda i: i % 50 == 0)


def test_query_on_given_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    plain = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(c))) for c in r.embedding]) for r in rows]
    found = got(queries.op11_negatives(spark, sf))
    assert found and found == by_hand(plain, lambda i: i % 100 == 0)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [1.0, None], 2), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 2),
        (100, [0.0, 0.0], 2), (200, [-1.0, -2.0], 3), (300, [], 1), (400, [1.0], 2), (8, [1.0, 1.9, 0.5], 2), (9, [1.0, 1.9], 2), (500, [-1.0, -1.9], 3),
    ]
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, lab in rows if i not in (3, 4, 5, 6, 7)]
    df = frame(spark, rows)
    assert got(hn.mine(hn.labelled(df, F.col("label")), F.col("id") % 100 == 0)) == by_hand(kept, lambda i: i is not None and i % 100 == 0)
    assert hn.mine(hn.labelled(df.limit(0), F.col("label")), F.col("id") % 100 == 0).count() == 0
    assert hn.mine(hn.labelled(df.where("vec_id = 1"), F.col("label")), F.col("id") % 100 == 0).count() == 0
    assert hn.mine(hn.labelled(df.where("vec_id = 100"), F.col("label")), F.col("id") % 100 == 0).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [3e6, 1.5], 2), (3, [3e6, 1.75], 2), (4, [1e30, 1.0], 2)]
    found = got(hn.mine(hn.labelled(frame(spark, rows), F.col("label")), F.col("id") % 100 == 0))
    x = lambda v: [int(np.floor(256 * float(np.float32(c)))) for c in v]
    score = lambda a, b: sum(p * q for p, q in zip(x(rows[a][1]), x(rows[b][1]), strict=True))
    assert found == [(0, 1, 1, 3, score(0, 1), score(0, 3)), (0, 1, 2, 2, score(0, 1), score(0, 2))]


def test_tree_covers_and_bounds():
    """Every point lies within its nodes' radii, a child's radius is at most half its parent's, and bounds hold."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-90, 91, (7, 8))
    x = centres[rng.integers(0, 7, 900)] + rng.integers(-9, 10, (900, 8))
    length = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max()))
    tree = hn.Tree.unpack(hn.Tree.build(x, length, row=np.arange(900), id=np.arange(900), has_id=np.ones(900, dtype=bool), label=x[:, 0] % 3).pack())
    below: dict[int, list[int]] = defaultdict(list)
    parents = {}
    for node in range(len(tree.centre) - 1, -1, -1):
        below[node] += range(*tree.loose[node])
        for child in range(*tree.children[node]):
            below[node] += below[child]
            parents[child] = node
    assert sorted(below[0]) == list(range(900)) and len(tree.centre) > 20
    assert all(tree.angle[c] <= tree.angle[p] / 2 + 1e-9 for c, p in parents.items())
    for q in rng.integers(-90, 91, (20, 8)):
        scores = tree.x.astype(int) @ q
        low, high = hn.bounds(scores[tree.centre], tree.angle, float(np.linalg.norm(q)) * length)
        for node, points in below.items():
            assert low[node] <= scores[points].min() and scores[points].max() <= high[node]
