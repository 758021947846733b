"""Quality classifier: histogram gradient-boosted trees over document statistics.

``fit`` computes ``FEATURES`` on executors for a bounded labelled sample (``max_rows``),
grows the trees from quantised histograms, and returns flat arrays.  ``score`` walks all
trees for a whole Arrow batch at once with numpy gathers: no per-row branching.

Defined cases: a null or empty text has all-zero statistics and gets the score of those;
texts of any length are read whole; equal texts get equal scores; without usable labels
of both classes the score is the label mean (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import fold, labelled_sample, small_batches, texts_in

FEATURES = (
    "log_bytes", "log_words", "word_len_mean", "word_len_std", "upper", "digit", "symbol", "punct", "bang", "pipe", "space", "newline",
    "non_ascii", "distinct_words", "top_word", "adjacent_repeat", "distinct_5grams", "distinct_lines", "line_len_mean", "byte_entropy", "stops",
    "block_symbol_max", "block_upper_max", "block_pipe_max", "block_bang_max", "block_symbol_share", "block_upper_share", "block_pipe_share",
    "block_distinct_min", "block_repeat_max", "block_repeat_share", "short_words",
)
_BLOCK = 256
_WORD_BLOCK = 40
_CLASS = np.zeros((256, 8), dtype=bool)
_CLASS[65:91, 0] = True
_CLASS[48:58, 1] = True
for _c in b"#$%&*@^~<>{}[]\\=+_":
    _CLASS[_c, 2] = True
for _c in b".,;:?'\"()-":
    _CLASS[_c, 3] = True
_CLASS[33, 4] = True
_CLASS[124, 5] = True
_CLASS[[9, 10, 11, 12, 13, 32], 6] = True
_CLASS[128:, 7] = True


def statistics(text: str | None) -> np.ndarray:
    """The values of ``FEATURES`` for one whole text."""
    out = np.zeros(len(FEATURES))
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    share = counts @ _CLASS / n
    words = data.split()
    k = len(words)
    out[0], out[1] = np.log1p(n), np.log1p(k)
    out[4], out[5], out[6], out[7], out[8], out[9], out[10] = share[0], share[1], share[2], share[3], share[4], share[5], share[6]
    out[11], out[12] = counts[10] / n, share[7]
    p = counts[counts > 0] / n
    out[19] = -(p * np.log2(p)).sum()
    out[20] = (counts[46] + counts[63]) / max(k, 1)
    lines = data.split(b"\n")
    out[17], out[18] = len(set(lines)) / len(lines), n / len(lines)
    if k:
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=k)
        out[2], out[3], out[31] = lengths.mean(), lengths.std(), (lengths <= 3).mean()
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=k)
        out[13], out[14] = len(ids) / k, np.bincount(seq).max() / k
        same = seq[1:] == seq[:-1]
        out[15] = same.mean() if k > 1 else 0.0
        if k >= 5:
            mix = np.uint64(0x9E3779B97F4A7C15)
            grams = np.zeros(k - 4, dtype=np.uint64)
            for j in range(5):
                grams = grams * mix + seq[j : k - 4 + j].astype(np.uint64) + np.uint64(1)
            out[16] = len(np.unique(grams)) / len(grams)
        else:
            out[16] = 1.0
        starts = np.arange(0, k, _WORD_BLOCK)
        sizes = np.diff(np.append(starts, k))
        repeats = np.add.reduceat(np.append(same, False).astype(np.int32), starts) / sizes
        full = sizes >= min(k, _WORD_BLOCK)
        out[29], out[30] = repeats[full].max(), (repeats > 0.5).mean()
        key = np.unique(np.repeat(np.arange(len(starts)), sizes) * (len(ids) + 1) + seq)
        distinct = np.bincount((key // (len(ids) + 1)).astype(np.int64), minlength=len(starts)) / sizes
        out[28] = distinct[full].min()
    starts = np.arange(0, n, _BLOCK)
    sizes = np.diff(np.append(starts, n))
    full = sizes >= min(n, _BLOCK)
    for column, at, most, portion in ((2, 0.04, 21, 25), (0, 0.3, 22, 26), (5, 0.04, 23, 27), (4, 0.05, 24, None)):
        block = np.add.reduceat(_CLASS[raw, column].astype(np.int32), starts) / sizes
        out[most] = block[full].max()
        if portion is not None:
            out[portion] = (block > at).mean()
    return out


@dataclass
class Forest:
    """Complete binary trees of one depth, as flat arrays: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        node = np.zeros((len(x), trees), dtype=np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 3.0) -> Forest:
    """Boost logistic loss; every split is chosen from per-node gradient histograms of quantised features."""
    inner = 2**depth - 1
    empty = Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return empty
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Forest(empty.feature, empty.threshold, empty.leaf, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    features, thresholds, leaves = [], [], []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            cut_bin = np.full(width, bins + 1)
            total_g, total_h = np.bincount(at, grad, width), np.bincount(at, hess, width)
            parent = total_g**2 / (total_h + l2)
            for f in range(x.shape[1]):
                key = at * (bins + 1) + binned[:, f]
                g = np.bincount(key, grad, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                h = np.bincount(key, hess, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + l2) + right_g**2 / (right_h + l2) - parent[:, None]
                gain[(h < least) | (right_h < least)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                for w in np.flatnonzero((value > best) & (top < len(cuts[f]))):
                    best[w], cut_bin[w] = value[w], top[w]
                    feature[first + w], threshold[first + w] = f, cuts[f][top[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + l2)
        margin = margin + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)


def _features(text: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([statistics(t) for t in texts_in(texts)], pa.list_(pa.float64())), "array<double>")(text)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, label_col: str = "quality") -> Forest:
    """Grow a forest from at most about ``max_rows`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, fold("_id", 5) != 0, max_rows)
    rows = sample.select(_features(F.col("text")).alias("x"), "label").toPandas()
    if not len(rows):
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    return grow(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(dtype=float))


def score(text: Column, forest: Forest) -> Column:
    """Probability of label 1 for each text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        done = []
        for at in range(0, len(texts), 256):  # bounds the rows x trees table
            part = texts[at : at + 256].to_pylist()
            done.append(forest.probability(np.stack([statistics(t) for t in part])))
        return pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 16_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    forest = fit(docs, labels, max_rows)
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score(F.col("text"), forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 16_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    return docs.where(score(F.col("text"), fit(docs, labels, max_rows)) >= threshold)
