import numpy as np
from leafmill.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, row_id string, n string, component string, x string, k string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, *"yyyyy") for i, v in rows], SCHEMA)


def check(rows, found, components=4):
    """Against numpy on the whole list: ``rows`` are (id, x)."""
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    ids = [i for i, _ in rows]
    assert len(found) == len(rows) * min(components, fit.shape[1])
    for c in range(min(components, fit.shape[1])):
        want = (np.array([x for _, x in rows]) - sums / n) @ vectors[:, c] / np.sqrt(values[c])
        got = np.array([sorted(by[i, c + 1], key=lambda r: r.whitened)[0].whitened for i in ids])
        sign = np.sign(got @ want)
        assert np.allclose(got, sign * want, atol=1e-9)
        for (i, x), _ in zip(rows, want, strict=True):
            r = by[i, c + 1][0]
            assert r.n == n and abs(r.explained - values[c] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, sums, strict=True)) == int(r.deviation_text)


def test_query_on_given_rows(spark, sf):
    rows = [(r.vec_id, [int(np.floor(256 * float(c))) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.op12_whitening(spark, sf).collect())


def test_distinct_vectors_and_dropped_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (120, 5))
    x[:50] = x[0]  # one vector has nearly half of the rows
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("-inf")] * 5)]
    found = whitening.whiten(frame(spark, rows + bad).repartition(7), scale=1).collect()
    check([(i, list(map(int, v))) for i, v in rows], found)


def test_edge_cases(spark):
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [4.0])])).collect()  # the last one is padded
    assert len(flat) == 6 and all(r.whitened is not None for r in flat)
    line = {r.component: r for r in whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])).where("vec_id = 1").collect()}
    assert abs(line[1].explained - 1) < 1e-12 and line[2].whitened is None and line[2].explained == 0.0 and line[1].identity_error < 1e-12
    assert {(r.vec_id, r.n) for r in whitening.whiten(frame(spark, [(7, [])])).collect()} == set()


def test_huge_entries_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [2.0**41, 3.0]), (3, [-(2.0**40), 2.0])]
    x = {i: [int(256 * c) for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    for r in whitening.whiten(frame(spark, rows)).collect():
        exact = sum((3 * a - b) ** 2 for a, b in zip(x[r.vec_id], sums, strict=True))
        assert int(r.deviation_text) == exact and r.deviation is None and r.identity_error < 1e-9


def test_covariance_by_polarisation_is_exact():
    rng = np.random.default_rng(9)
    x = rng.integers(-1000, 1000, (300, 6))
    sums = [int(s) for s in x.sum(axis=0)]
    middle = np.array([(2 * s + 300) // 600 for s in sums])
    cov = whitening.covariance(whitening._pairs(x, middle), sums, middle.tolist(), 300)
    for i in range(6):
        for j in range(6):
            assert cov[i][j] * 300 * 300 == 300 * sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) - sums[i] * sums[j]
