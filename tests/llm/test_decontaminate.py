import hashlib
import random
import re

from conftest import SCHEMA, edge_rows, prose
from leafmill.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= names
        listed = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    rng = random.Random(3)
    items = [(i, prose(300 + i, rng.choice([3, 9, 10, 14, 30]))) for i in range(12)] + [(3, prose(303, 14)), (None, prose(400, 12)), (90, None), (91, "..."), (92, "Ka")]
    rows = []
    for k in range(40):
        parts = [prose(600 + k, rng.randint(0, 60))]
        if k % 3 == 0:
            w = (items[k % 13][1] or "").split()
            cut = rng.randint(0, max(0, len(w) - 10))
            parts += [" ".join(w[cut:]).upper() if k % 2 else " ".join(w), prose(700 + k, 5)]
        rows.append((k, " -- ".join(parts)))
    return rows + [(40, rows[3][1]), (None, rows[6][1]), (41, "ka " * 500)], items


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' AS item", "0 AS n", "'q' AS words")


def test_report_equals_brute_force(spark):
    rows, items = corpus()
    for block_words in (1_000_000, 60):
        found = [tuple(r) for r in decontaminate.report(frame(spark, rows).repartition(3), bench(spark, items), block_words=block_words).collect()]
        assert sorted(found, key=key) == sorted(brute(rows, items), key=key)


def test_phrases_and_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"so {item} end"), (2, "alpha beta gamma delta epsilon zeta eta theta extra iota kappa lambda"), (3, "nothing here")]
    docs, items = frame(spark, rows), bench(spark, [(7, item)])
    assert [tuple(r) for r in decontaminate.phrase_matches(docs, items).collect()] == [(1, "7", 1, 11)]
    near = decontaminate.proximity_matches(docs, items, slop=2).collect()
    assert {(r.doc_id, r.item_id) for r in near} <= {(2, "7")}


def near_brute(rows, items, slop):
    out = set()
    for d, t in rows:
        for item, text in items:
            w, terms = words(t), words(text)
            size = min(10, len(terms))
            if not size or any(terms[s : s + size] == w[i : i + size] for s in range(len(terms) - size + 1) for i in range(len(w) - size + 1)):
                continue
            ranks = []
            for base in range(-len(terms) - slop, len(w) + 1):
                spot = [next((x for x in range(slop + 1) if 0 <= base + q + x < len(w) and w[base + q + x] == term), None) for q, term in enumerate(terms)]
                for s in range(len(terms) - size + 1):
                    met = [(q, spot[q]) for q in range(s, s + size) if spot[q] is not None]
                    if len(met) >= size - size * slop // 10:
                        slips = [x for _, x in met]
                        ranks.append((-len(met), max(slips) - min(slips), min(base + q + x for q, x in met)))
            if ranks:
                out.add((d, None if item is None else str(item), min(ranks)[2], min(ranks)[1]))
    return out


def test_proximity_equals_brute_force(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows, items = corpus()
    rng = random.Random(5)
    for k in range(60):  # words replaced by known or unknown ones, put in and left out
        w = (items[k % 13][1] or "").split()
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice([[], ["new"], ["ka"], ["one", "two"]])
            w = w or ["ka"]
        rows.append((100 + k, " ".join([prose(800 + k, rng.randint(0, 9)), *w])))
    rows += [(200, "alpha beta gamma delta epsilon zeta eta theta extra iota kappa lambda"), (201, item.replace("alpha", "x").replace("gamma", "y")), (202, item)]
    items = [*items, (7, item)]
    for slop, block_words in ((2, 1_000_000), (3, 60)):
        found = [tuple(r) for r in decontaminate.proximity_matches(frame(spark, rows).repartition(3), bench(spark, items), slop=slop, block_words=block_words).collect()]
        want = near_brute(rows, items, slop)
        assert len(found) == len(set(found)) and set(found) == want
        assert {(200, "7", 0, 1), (201, "7", 1, 0)} <= want and len(want) > 15
    both = [(r.doc_id, r.kind) for r in decontaminate.matches(frame(spark, rows), bench(spark, [(7, item)])).collect()]
    assert sorted(both) == [(200, "proximity"), (201, "proximity"), (202, "phrase")]


def test_edge_cases(spark, edge_docs, no_docs):
    items = [(1, edge_rows()[0][1]), (2, "a b")]
    found = [tuple(r) for r in decontaminate.report(edge_docs, bench(spark, items)).collect()]
    assert sorted(found, key=key) == sorted(brute([(r[0], r[1]) for r in edge_rows()], items), key=key)
    assert decontaminate.report(no_docs, bench(spark, items)).count() == 0
    none = decontaminate.report(edge_docs, bench(spark, items).limit(0)).collect()
    assert len(none) == len(edge_rows()) and not any(r.contaminated for r in none)
    clean = decontaminate.drop_contaminated(edge_docs, bench(spark, items))
    assert clean.columns == edge_docs.columns and clean.count() == sum(not r[5] for r in brute([(r[0], r[1]) for r in edge_rows()], items))
