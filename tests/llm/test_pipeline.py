import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import prose
from leafmill.llm import decontaminate, jaccard, quality, toxicity
from leafmill.llm.common import table


def test_stages_follow_their_operators(spark, sf):
    docs, labels, bench = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    columns, want = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    now = docs
    checks = {
        "quality": lambda d: {r.doc_id for r in quality.classify(d, labels).where("predicted = 1").collect()},
        "toxicity": lambda d: {r.doc_id for r in toxicity.classify(d, labels).where("predicted = 0").collect()},
        "near_duplicates": lambda d: {r.doc_id for r in jaccard.components(d).where("doc_id = component_id").collect()},
        "decontamination": lambda d: {r.doc_id for r in decontaminate.report(d, bench).where("NOT contaminated").collect()},
    }
    for name, expected in checks.items():
        after = steps[name](spark, now, sf).cache()
        want = expected(now)
        assert after.columns == columns and {r.doc_id for r in after.collect()} == want and after.count() == len(want)
        now = after
    pieces = steps["packing"](spark, now, sf).collect()
    assert {p.doc_id for p in pieces} == want
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in whole) == sorted((p.doc_id, p.start, p.ids_crc32) for p in pieces)


def test_good_labelled_rows_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, table(spark, sf, "documents"), sf).select("doc_id").collect()}
    rows = labels.collect()
    assert np.mean([r.doc_id in kept for r in rows if r.quality == 1]) > 0.97
    assert np.mean([r.doc_id not in kept for r in rows if r.quality == 0]) > 0.9


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def test_near_duplicates_and_decontamination_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    steps = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        n = min(5, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets, group = {d: shingles(t) for d, t in rows.items()}, {d: d for d in rows}
    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    kept = {d for d in rows if group[d] == d or not sets[d]}
    assert {r.doc_id for r in steps["near_duplicates"](spark, docs, sf).collect()} == kept
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words(r.text or "")
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}

    def leaked(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert {r.doc_id for r in steps["decontamination"](spark, docs, sf).collect()} == {d for d, t in rows.items() if not leaked(t)}


@pytest.fixture(scope="module")
def small(spark, edge_labels, tmp_path_factory):
    """A folder with labels and benchmark of a few rows, nulls among them."""
    at = tmp_path_factory.mktemp("tables")
    edge_labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 40)), (2, None), (None, ""), (2, "a b"), (3, "nowhere to be found at all in any of these few texts")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_on_edge_rows(spark, edge_docs, no_docs, small):
    """Nulls, empty and long texts, repeated rows and clashing columns; and nothing at all."""
    steps = dict(corpus_pipeline.STAGES)
    for name in list(steps)[:-1]:
        after = steps[name](spark, edge_docs, small)
        assert after.columns == edge_docs.columns
        every, found = ids(edge_docs), ids(after)
        assert all(found.count(r) <= every.count(r) for r in found)
        assert name == "quality" or {r for r in every if not r[2].strip()} <= set(found)  # nothing to hold against texts without words
        assert ids(steps[name](spark, no_docs, small)) == []
    leaked = ids(steps["decontamination"](spark, edge_docs, small))
    assert [r for r in ids(edge_docs) if r not in leaked] == [(False, 7, prose(3, 9000)), (False, 8, "a b")] or prose(3, 40) not in prose(3, 9000)
    pieces = steps["packing"](spark, edge_docs, small).collect()
    assert sum(p.length for p in pieces if p.doc_id == 7) == next(p.doc_tokens for p in pieces if p.doc_id == 7)
    assert sum(p.doc_id is None for p in pieces) >= 2 and steps["packing"](spark, no_docs, small).count() == 0
