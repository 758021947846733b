import random
import re

import pyarrow as pa
import pytest
from conftest import SCHEMA, edge_rows, prose
from leafmill.llm import jaccard
from pyspark.sql import functions as F


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    links = set()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links.add((i, j))
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return [(d, len(s), low.get(g)) for (d, _), s, g in zip(rows, sets, group, strict=True)], links, sets


def mutated(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    rows, k = [], 0
    passage = prose(99, 60)
    for g in range(14):
        base = prose(200 + g, rng.choice([4, 6, 20, 80, 150]))
        for c in range(rng.randint(1, 6)):
            rows.append((1000 - k, mutated(rng, base, rng.randint(0, 1 + len(base.split()) // 40))))
            k += 1
    rows += [(k + i, passage + " " + prose(500 + i, rng.choice([5, 12, 70]))) for i in range(12)]
    rows += [(2000 + i, mutated(rng, prose(77, 100), i % 3)) for i in range(25)]
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("common", [255, 3, 0])
def test_components_equal_brute_force(spark, common):
    rows = corpus()
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in jaccard.components(df, common).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=key) == sorted(brute(rows)[0], key=key)


def batches_of(rows, names, size):
    """Arrow batches of ``size`` rows each, the first one empty."""
    for part in ([], *(rows[at : at + size] for at in range(0, len(rows), size))):
        yield pa.record_batch([pa.array([r[i] for r in part], pa.int64()) for i in range(len(names))], names=names)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("top", [2, 5, 4096])
def test_frequencies_equal_brute_force(monkeypatch, size, top):
    monkeypatch.setattr(jaccard, "_TOP", top)
    rng = random.Random(size)
    rows = sorted({(rng.randrange(6) + (rng.randrange(3) << 56), rng.randrange(-9, 9), 0) for _ in range(60)} | {(-5, -5, 7 << 32), (3, 8, 9 << 32)})
    rows = sorted(rows + rng.sample(rows, 10))
    df = {k: len({s for q, s, i in rows if q == k and not i}) for k, _, _ in rows}
    want = sorted([(s, -1, k, i) for k, s, i in rows if i] + [(s, min(df[k], top) if k >> 56 == 0 else top + (k >> 56), k, 0) for k, s in {(k, s) for k, s, i in rows if not i} if df[k] > 1])
    found = [tuple(r.values()) for b in jaccard._frequencies(batches_of(rows, ["key", "sid", "info"], size)) for r in b.to_pylist()]
    assert sorted(found) == want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_shared_keys_keep_border_keys_and_every_shared_row(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(12), rng.randrange(5, 30), rng.randrange(40), 0) for _ in range(40))
    sets = [(k, s, n, p) for k, n, s, p in rows]
    found = {(r["key"], r["sid"]) for b in jaccard._shared_keys(batches_of(sets, ["key", "sid", "n", "pos"], size)) for r in b.to_pylist()}
    many = {k for k in range(12) if len({(s, n) for q, s, n, _ in sets if q == k}) > 1} | {sets[0][0], sets[-1][0]}
    assert found == {(k, s) for k, s, _, _ in sets if k in many}


def test_join_returns_every_link_between_different_sets(spark):
    rows = corpus()
    _, links, sets = brute(rows)
    name = {}
    for (d, _), s in zip(rows, sets, strict=True):
        name[frozenset(s)] = min(name.get(frozenset(s), d), d)
    wanted = {frozenset((name[frozenset(sets[i])], name[frozenset(sets[j])])): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, j in links if sets[i] != sets[j]}
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    found = jaccard.join(df).collect()
    assert {frozenset((r.a, r.b)): (r.intersection, r.union) for r in found} == wanted and len(found) == len(wanted)


def test_pairs_of_near_copies_meet_once_and_none_is_lost(spark):
    """Sets that share nearly all keys but are of one label each: every pair that a plain join of the keys finds meets, hardly any twice."""
    rng = random.Random(11)
    base = prose(300, 400)
    rows = [(i, mutated(rng, base, 3)) for i in range(40)] + [(100 + i, prose(600, 30) + " " + prose(700 + i, 60)) for i in range(9)]
    found = jaccard.Shingles(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3))
    labels = found.shared.select("sid", F.col("sid").alias("label")).distinct()
    mixed = found.mixed(labels)
    met = [(r.a, r.b) for r in found.meetings(mixed).collect()]
    keys, sets = {}, {}
    for r in found.texts.collect():
        sets[r.sid] = shingles(r.text)
    for r in mixed.collect():
        keys.setdefault(r.key, []).append(r)
    plain = {(max(x.sid, y.sid), min(x.sid, y.sid)) for rs in keys.values() for x in rs for y in rs if x.label != y.label}
    linked = {(a, b) for a, b in plain if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(linked) > 300 and linked <= set(met) <= plain
    assert len(met) <= 1.2 * len(set(met))
    found.close()


def test_edge_cases(edge_docs, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows()]
    found = [tuple(r) for r in jaccard.components(edge_docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=key) == sorted(brute(rows)[0], key=key)
    assert jaccard.components(no_docs).count() == 0


def test_keep_one_keeps_whole_rows(edge_docs, no_docs):
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in {(r[0], r[1]) for r in edge_rows()} if d not in (5, 6))
    assert jaccard.keep_one(no_docs).count() == 0


def test_bounds():
    for a in range(1, 60):
        assert jaccard.prefix_length(a) >= 1
        for b in range(1, a + 1):
            need = jaccard.least_common(a, b)
            assert 100 * need >= 80 * (a + b - need) and 100 * (need - 1) < 80 * (a + b - need + 1)
