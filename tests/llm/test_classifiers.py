import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import zstandard
from conftest import edge_rows
from leafmill.llm import langid, quality, toxicity
from leafmill.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def fold(d, n):
    return zlib.crc32(str("" if d is None else d).encode()) % n


def test_quality_held_out(spark):
    labels = table(spark, SF, "labels")
    rows = quality.classify(table(spark, SF, "documents"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_forest_walk_equals_naive_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.95
    for row, margin in zip(x[:50], forest.margin(x[:50]), strict=True):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9


def test_toxicity_held_out(spark):
    labels = table(spark, SF, "labels")
    rows = toxicity.classify(table(spark, SF, "documents"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.92
    assert np.mean([r.predicted == 0 for r in held if not r.toxic]) > 0.97


def test_toxicity_recall_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    held = [r for r in toxicity.classify(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.9 and np.mean([r.predicted == 0 for r in held if not r.toxic]) > 0.98


def taught():
    """Toxic texts hold one of two words, or one of an open-ended family; clean texts share their letters."""
    rng = random.Random(3)
    filler = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    rows = []
    for i in range(400):
        words = rng.choices(filler, k=40)
        if i % 8 == 0:
            words[7] = rng.choice(["idiot", "loser", "grumpf" + rng.choice("abcdefghij") + rng.choice("xyz")])
        elif i % 8 < 3:
            words[9] = rng.choice(["lose", "losing", "idiom", "idiosyncrasy"])
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    return rows


def test_lexicon_equals_brute_force_and_takes_no_letters_of_single_words(spark):
    rows = taught()
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    words, starts = toxicity._lexicon(sample, 1.0, 2.5, 4)
    toxic, every = sum(y for *_, y in rows), len(rows)

    def odds(term_in):
        y, n = sum(y for _, t, y in rows if term_in(t)), sum(term_in(t) for _, t, _ in rows)
        a, b = y + toxic / every, n - y + (every - toxic) / every
        value = math.log(a / (toxic + 1 - a)) - math.log(b / (every - toxic + 1 - b))
        z = abs(value) / math.sqrt(1 / a + 1 / b)
        return value * (1 - (2.5 / z) ** 2) if z > 2.5 else 0.0

    every_word = {w for _, t, _ in rows for w in t.split()}
    want = {w: v for w in every_word if (v := odds(lambda t, w=w: w in t.split()))}
    assert words.keys() == want.keys() and all(abs(words[w] - v) < 1e-9 for w, v in want.items())
    plain = {w for _, t, y in rows if y for w in t.split() if want.get(w, 0) <= 0}
    prefixes = {w[:k] for w in plain for k in range(3, 9) if len(w) > k}
    prefixes = {p for p in prefixes if sum(w.startswith(p) and len(w) > len(p) for w in plain) >= 4}
    family = {p: v for p in prefixes if (v := odds(lambda t, p=p: any(w.startswith(p) and len(w) > len(p) and want.get(w, 0) <= 0 for w in t.split()))) > 0}
    assert starts.keys() == family.keys() and all(abs(starts[p] - v) < 1e-9 for p, v in family.items())
    assert "grumpf" in starts and not any("idiot".startswith(p) or "loser".startswith(p) for p in starts)


def test_innocent_words_with_toxic_letters_stay_clean(spark):
    rows = taught()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert max(model.probability(t) for t in ("The idiomatic usage of closed idioms.", "They close the losing idea, pathology aside.", "", None)) < 0.3
    assert min(model.probability(t) for t in ("You are an idiot.", "Grumpfqq is what it is, and a loser too.")) > 0.5
    spans = toxicity.passages(docs, spark.sparkContext.broadcast(model)).collect()
    told = {r.doc_id for r in spans}
    assert np.mean([r[2] for r in rows if r[0] in told]) > 0.95 and sum(r[0] in told for r in rows if r[2]) > 0.9 * sum(r[2] for r in rows)
    assert all(r.first_word <= 7 <= r.last_word for r in spans if rows[r.doc_id][2])
    assert toxicity.toxic_passages(docs.limit(0), labels).count() == 0


def test_segments_equal_recursive_definition():
    """Maximal segments: the best one, then those of what is left of it and right of it."""

    def recursive(scores, at=0):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return recursive(scores[:i], at) + [(at + i, at + j - 1, best[0])] + recursive(scores[j:], at + j)

    rng = random.Random(2)
    for _ in range(150):
        scores = [rng.choice([-1.0, -1.0, rng.randint(1, 40) + rng.random()]) for _ in range(rng.randint(0, 12))]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in recursive(scores)]
        assert np.allclose([s for *_, s in found], [s for *_, s in recursive(scores)])


def test_toxicity_held_out_rows_with_known_words(spark):
    """Of the toxic rows that were never learned from, every one with a word that only toxic rows taught is found.

    The others (5 of 14 on these tables) have no such word: nothing in their text says what their label says.
    """
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r.doc_id, set(re.findall(r"[^\W\d_]+", (r.text or "").lower())), r.toxic) for r in docs.join(labels, "doc_id").where("toxic IS NOT NULL").collect()]
    taught = [r for r in rows if fold(r[0], 4) != 2]
    seen = Counter(w for _, words, toxic in taught if toxic for w in words)
    clean = {w for _, words, toxic in taught if not toxic for w in words}
    signs = {w for w, n in seen.items() if n >= 5 and w not in clean}
    score = {r.doc_id: r.score for r in toxicity.classify(docs, labels).where("held_out").collect()}
    telling = [d for d, words, toxic in rows if toxic and d in score and words & signs]
    assert len(telling) >= 9 and all(score[d] >= 0.3 for d in telling)
    assert np.mean([score[d] < 0.3 for d, _, toxic in rows if not toxic and d in score]) > 0.97


def test_forest_grows_like_a_naive_search():
    """Every split is the best of all features and cuts of the rows of its node, found by trying each."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(90, 4)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > -0.1) ^ (rng.random(90) < 0.1)).astype(float)
    forest = quality.grow(x, y, trees=4, depth=3, bins=8)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) for f in range(4)]
    margin = np.full(90, np.log(y.mean() / (1 - y.mean())))
    assert abs(forest.base - margin[0]) < 1e-12
    for tree in range(4):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        worth = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 2.0)  # noqa: B023, E731
        nodes = {0: np.arange(90)}
        for node in range(7):
            rows, best, split = nodes[node], 1e-6, (0, np.inf)
            for f, c in ((f, c) for f in range(4) for c in cuts[f]):
                low = x[rows, f] <= c
                if hess[rows[low]].sum() >= 3 and hess[rows[~low]].sum() >= 3 and (gain := worth(rows[low]) + worth(rows[~low]) - worth(rows)) > best + 1e-9:
                    best, split = gain, (f, c)
            assert (forest.feature[tree, node], forest.threshold[tree, node]) == split
            high = x[rows, split[0]] > split[1]
            nodes[2 * node + 1], nodes[2 * node + 2] = rows[~high], rows[high]
        for leaf in range(8):
            rows = nodes[7 + leaf]
            value = 0.15 * grad[rows].sum() / (hess[rows].sum() + 2.0)
            assert abs(forest.leaf[tree, leaf] - value) < 1e-9
            margin[rows] += value


def test_segment_scores_are_calibrated():
    """lambda against its closed form for steps of one, and E-values against fresh random texts."""
    rng = np.random.default_rng(11)
    model = toxicity.ToxicModel(drift=1.0)

    def best(n, p):
        hits = [(int(i), 1.0) for i in np.flatnonzero(rng.random(n) < p)]
        return max((s for *_, s in toxicity.segments(hits, 1.0)), default=0.0)

    lengths = rng.integers(50, 2000, 400)
    clean = [(int(n), best(n, 0.2)) for n in lengths]
    toxicity._constants(model, [(1.0, int(0.2 * lengths.sum()))], clean)
    assert abs(model.lam - math.log(0.8 / 0.2)) < 1e-3
    fresh = [(int(n), best(n, 0.2)) for n in rng.integers(50, 2000, 600)]
    for level in (0.05, 0.5):
        share = np.mean([math.exp(-model.significance(n, s)) < level for n, s in fresh])
        assert share < 1.6 * level + 0.02  # scores are whole numbers here, so E-values come in steps
    assert math.exp(-model.significance(1000, best(1000, 0.7))) < 1e-6


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_sizes_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs, 40)
    assert sum(map(len, model.values())) > 100_000 and all(len(d) > 5_000 for d in model.values())

    def size(text, dictionary, level):
        """Each piece alone, by an encoder of its own."""
        total, data = 0, langid.normalised(text)
        for at in range(0, len(data), 1024):
            params = zstandard.ZstdCompressionParameters.from_level(level, source_size=1024, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            total += len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(data[at : at + 1024]))
        return total

    encoders = langid.Encoders(model)
    texts = [r.text for r in docs.where("doc_id % 40 = 0 AND length(text) > 0").collect()] + ["a", "la", "xyzzy " * 700]
    for t in texts:
        sizes = [size(t, d, 3) for d in model.values()]
        assert encoders.sizes(langid.normalised(t)) == sizes
        lang, score = langid.detect(t, encoders)
        if not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0.0)
            continue
        low = sorted(sizes)
        if low[0] < low[1]:
            assert lang == list(model)[sizes.index(low[0])] and abs(score - (low[1] - low[0]) / low[1]) < 1e-12
        else:
            strong = [size(t, d, 12) if s == low[0] else 1 << 40 for s, d in zip(sizes, model.values(), strict=True)]
            assert lang == list(model)[strong.index(min(strong))] and score == 0
    assert langid.detect("whatever", langid.Encoders({"en": b"some text"})) == ("en", 1.0)


def test_language_models_do_not_mix(spark):
    """One worker process, one model after the other."""
    df = spark.createDataFrame([(i, "der und die" if i % 2 else "the and of", lang) for i, lang in enumerate(["a", "b"] * 20)], "doc_id long, text string, lang string").coalesce(1)
    for names in (("x", "y"), ("p", "q"), ("x", "y")):
        named = df.withColumn("lang", F.when(F.col("lang") == "a", names[0]).otherwise(names[1]))
        assert {(r.doc_id % 2, r.lang_pred) for r in langid.identify(named).collect()} == {(0, names[0]), (1, names[1])}


def test_edge_cases(spark, edge_docs, no_docs, edge_labels):
    for run, column in ((quality.classify, "score"), (toxicity.classify, "score")):
        rows = run(edge_docs, edge_labels).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge_rows())
        assert all(0 <= r[column] <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert run(no_docs, edge_labels).count() == 0
        assert run(edge_docs, edge_labels.limit(0)).count() == len(edge_rows())
    assert quality.keep_good(edge_docs, edge_labels).columns == edge_docs.columns
    assert toxicity.drop_toxic(edge_docs, edge_labels).columns == edge_docs.columns
    model = spark.sparkContext.broadcast(toxicity.ToxicModel(words={"idiot": 9.0}))
    spans = toxicity.passages(spark.createDataFrame([(1, "a b idiot idiot c idiot"), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.first_word, r.last_word) for r in spans] == [(1, 2, 5)]
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(edge_docs).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (10, "und", 0.0)} <= rows
    assert all(r[1] in ("en", "fr", "und") and 0 <= r[2] <= 1 for r in rows)
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(edge_docs.withColumn("lang", edge_docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")).collect()} == {"und"}
