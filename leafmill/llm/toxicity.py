"""Toxicity: maximum-scoring segment search over token log-odds.

``fit`` estimates, on a bounded labelled sample, the log-odds of every word between toxic and
other documents under a Dirichlet prior that is worth ``prior`` documents in all, dealt in
proportion to the classes, whatever the size of the sample.  Log-odds are shrunk towards 0 by
1 - (least_z / z)^2, where z is their size in standard errors; what is not beyond least_z is 0,
and what stays may be of either sign.  Words without evidence of their own that share a
beginning (3 to 8 letters) with at least ``support`` other such words of toxic documents are
judged by the log-odds of the longest such beginning: so open-ended word families are caught,
while the letters of one toxic word alone mark nothing else.

``segments`` is the linear-time scan of Ruzzo and Tompa: it yields every disjoint maximal
segment of a whole text, where each token scores its log-odds less ``drift``.  Segment scores
are turned into E-values with Karlin-Altschul constants (lambda from the clean score
distribution, K from a Gumbel fit to clean documents), and a logistic curve over the summed
evidence gives the document score.

Defined cases: null texts and texts without words have no segment and get the score of no
evidence; equal texts get equal scores; without toxic labels, or without others, every score
is near 0; texts of any length are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import discard, fold, labelled_sample, materialize, small_batches, texts_in

_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = range(8, 2, -1)
_CACHE_WORDS = 200_000


@dataclass
class ToxicModel:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    intercept: float = -20.0
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def odds(self, word: str) -> float:
        """Shrunken log-odds of a lower-case word; without evidence of its own, those of its longest known beginning."""
        own = self.words.get(word)
        if own is None:
            own = next((v for n in _BEGINNINGS if n < len(word) and (v := self.beginnings.get(word[:n])) is not None), 0.0)
        return own

    def scores(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and (position, score) of those with evidence; each other word scores ``-drift``."""
        words = _WORD.findall(text.lower()) if text else []
        known, hits = self.known, []
        if len(known) > _CACHE_WORDS:
            known.clear()
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = self.odds(w)
            if s:
                hits.append((i, s - self.drift))
        return len(words), hits

    def significance(self, n: int, score: float) -> float:
        """-ln of the E-value of a segment in a text of n words."""
        return self.lam * score - math.log(max(self.k * n, 1e-9))

    def summed(self, n: int, found: list[float]) -> float:
        """Evidence of a text of n words with these segment scores."""
        return math.log1p(sum(max(0.0, self.significance(n, s)) for s in found))

    def probability(self, text: str | None) -> float:
        n, hits = self.scores(text)
        z = self.slope * self.summed(n, [s for *_, s in segments(hits, self.drift)]) + self.intercept
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score), left to right, in linear time.

    Positions that are not in ``hits`` score ``-drift``.  Candidates are kept with the
    cumulative score left of them (``low``) and at their end (``high``).
    """
    out: list[list[float]] = []  # first, last, low, high
    total, before = 0.0, -1
    for at, score in hits:
        gap = drift * (at - before - 1)
        total -= gap
        before = at
        if score <= 0:
            total += score
            continue
        current = [at, at, total, total + score]
        total += score
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= current[2]:
                j -= 1
            if j < 0 or out[j][3] >= current[3]:
                break
            current = [out[j][0], current[1], out[j][2], current[3]]
            del out[j:]
        out.append(current)
    return [(int(a), int(b), high - low) for a, b, low, high in out]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _shrunk(toxic: float, every: float, prior: float, least_z: float) -> Column:
    """Log-odds of terms that ``y`` toxic and ``n`` documents in all hold, shrunk by what chance can make of it."""
    a, b = F.col("y") + prior * toxic / every, F.col("n") - F.col("y") + prior * (every - toxic) / every
    odds = F.log(a / (toxic + prior - a)) - F.log(b / (every - toxic + prior - b))
    z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    return F.when(z > least_z, odds * (1 - F.pow(least_z / z, F.lit(2))))


def _lexicon(sample: DataFrame, prior: float, least_z: float, support: int) -> tuple[dict[str, float], dict[str, float]]:
    """Shrunken log-odds of words and of beginnings, without those that are 0; both are bounded by the sample."""
    total = sample.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    toxic, every = float(total["t"] or 0), float(total["n"])
    if not toxic or toxic == every:
        return {}, {}

    def counted(terms, kind: str):
        """(term, toxic documents, documents) of what ``terms`` finds in each text."""
        run = F.arrow_udf(lambda texts: pa.array([terms(t) for t in texts_in(texts)], pa.list_(pa.string())), "array<string>")
        rows = sample if kind == "every" else sample.where("label = 1")
        return rows.select(F.explode(run("text")).alias("term"), "label").groupBy("term").agg(F.sum("label").alias("y"), F.count("*").alias("n"))

    def known(seen: DataFrame) -> dict[str, float]:
        found = seen.select("term", _shrunk(toxic, every, prior, least_z).alias("odds")).where("odds IS NOT NULL")
        return {r["term"]: r["odds"] for r in found.collect()}

    words = known(counted(lambda t: sorted(_words(t)), "every"))
    toxic_words = {w for w, v in words.items() if v > 0}
    # beginnings that enough words of toxic documents share
    plain = counted(lambda t: sorted(_words(t) - toxic_words), "toxic").select("term")
    shared = plain.select("term", F.explode(F.sequence(F.lit(min(_BEGINNINGS)), F.lit(max(_BEGINNINGS)))).alias("k")).where("length(term) > k")
    shared = shared.groupBy(F.expr("substring(term, 1, k)").alias("start")).agg(F.count("*").alias("c")).where(F.col("c") >= support)
    starts = {r["start"] for r in shared.collect()}

    def beginnings(text: str | None) -> list[str]:
        return sorted(starts.intersection(w[:k] for w in _words(text) - toxic_words for k in _BEGINNINGS if k < len(w)))

    return words, {start: v for start, v in known(counted(beginnings, "every")).items() if v > 0}


def _calibrate(model: ToxicModel, texts: list[tuple[float, int]]) -> None:
    """Newton steps of a one-variable logistic regression with a small ridge."""
    x, y = np.array([t[0] for t in texts]), np.array([t[1] for t in texts], float)
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve(design.T @ (design * w[:, None]) + 0.05 * np.eye(2), design.T @ (y - p) - 0.05 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.intercept = float(max(beta[0], 0.0)), float(beta[1])


def _constants(model: ToxicModel, scores: list[tuple[float, int]], clean: list[tuple[int, float]]) -> None:
    """lambda: root of sum p(s) exp(lambda s) = 1 over the (score, count) of clean texts' words.  K: from (words, best score) of clean texts."""
    words = sum(n for n, _ in clean) or 1
    hit, count = np.array([s for s, _ in scores] or [5.0]), np.array([c for _, c in scores] or [0.5], float)
    weight = count / words
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        value = (weight * np.exp(np.minimum(mid * hit, 500))).sum() + (1 - weight.sum()) * math.exp(-mid * model.drift)
        low, high = (mid, high) if value < 1 else (low, mid)
    model.lam = max(low, 0.05)
    best = [(n, s) for n, s in clean if n]
    if best:
        location = float(np.mean([model.lam * s - math.log(n) for n, s in best])) - 0.5772
        model.k = float(np.clip(math.exp(location), 1e-4, 1.0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, prior: float = 1.0, least_z: float = 2.5, support: int = 4, drift: float = 1.0) -> ToxicModel:
    """Learn from at most about ``max_rows`` labelled rows outside the held-out fold; copies count once."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", fold("_id", 4) != 2, max_rows).dropDuplicates(["text"]).where("text IS NOT NULL")
    sample = materialize(sample, "toxicity-sample")  # read five times
    model = ToxicModel(drift=drift)
    model.words, model.beginnings = _lexicon(sample, prior, least_z, support)
    if any(v > 0 for v in model.words.values()) or model.beginnings:
        # what the calibration needs of each text is its word count, few segments and counts of scores, not the text
        kind = "struct<n:int,segments:array<double>,scores:array<struct<s:double,c:int>>>"
        measured = materialize(sample.select(F.arrow_udf(lambda texts: _measured(model, texts), kind)("text").alias("m"), "label"), "toxicity-measured")
        scores = measured.where("label = 0").select(F.inline("m.scores")).groupBy("s").agg(F.sum("c").alias("c"))
        rows = measured.select("m.n", "m.segments", "label").collect()
        _constants(model, [(r["s"], r["c"]) for r in scores.collect()], [(r["n"], max(r["segments"], default=0.0)) for r in rows if not r["label"]])
        _calibrate(model, [(model.summed(r["n"], r["segments"]), r["label"]) for r in rows])
        discard(measured)
    discard(sample)
    model.known.clear()
    return model


def _measured(model: ToxicModel, texts: pa.Array) -> pa.Array:
    """Word count, segment scores, and counts of the scores (to a hundredth) of each text."""
    counts, found, scores = [], [], []
    for text in texts_in(texts):
        n, hits = model.scores(text)
        counts.append(n)
        found.append([s for *_, s in segments(hits, model.drift)])
        scores.append([{"s": s, "c": c} for s, c in Counter(round(s, 2) for _, s in hits).items()])
    kind = pa.list_(pa.struct([("s", pa.float64()), ("c", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.float64())), pa.array(scores, kind)], ["n", "segments", "scores"])


def score(text: Column, model) -> Column:
    """Toxicity of each text, 0 to 1; ``model`` is a broadcast ToxicModel."""
    return F.arrow_udf(lambda texts: pa.array([model.value.probability(t) for t in texts_in(texts)], pa.float64()), "double")(text)


def passages(docs: DataFrame, model, most: float = 0.05) -> DataFrame:
    """doc_id, first_word, last_word, score, e_value of every segment whose E-value is below ``most``; ``model`` is a broadcast.

    Words are numbered from 0.  Null texts and texts without words have no passage; repeated
    rows have theirs repeated.
    """

    def found(text: str | None) -> list[dict]:
        n, hits = model.value.scores(text)
        spans = [(a, b, s, math.exp(-model.value.significance(n, s))) for a, b, s in segments(hits, model.value.drift)]
        return [{"first_word": a, "last_word": b, "score": s, "e_value": e} for a, b, s, e in spans if e < most]

    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
    run = F.arrow_udf(lambda texts: pa.array([found(t) for t in texts_in(texts)], kind), "array<struct<first_word:int,last_word:int,score:double,e_value:double>>")
    return docs.select("doc_id", F.inline(run("text")))


def toxic_passages(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000) -> DataFrame:
    """``passages`` of every row of ``docs`` under a model that ``labels`` teach."""
    return passages(docs, docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 16_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 16_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose toxicity stays below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))
    return docs.where(score(F.col("text"), model) < threshold)
