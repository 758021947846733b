"""Benchmark decontamination with a distributed positional inverted index.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z.  A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one window.

1. Document frequencies of the test terms are counted over the whole corpus.
2. The two rarest terms of each window are its anchors.  The index stores, for every
   document, the positions of anchors and of the test terms that stand within reach of one
   (postings that no window could use are left out), in shared storage.
3. Anchor postings, shifted by their offset in the item, are intersected: (document, item,
   alignment) triples on which two anchors agree are candidates.
4. The remaining terms of a candidate are intersected at (document, position, term); runs of
   at least a window are exact phrases.

5. A near match is a window of which all but ``size * slop // width`` terms stand in the text at
   places that differ by at most ``slop``.  Of the rarest terms of a window, two more than may be
   missing, two or more must then be in place: pairs of such anchors are candidates, and each is
   verified on the whole text.  No near match is lost; terms that never occur are no anchors.

Texts are told apart by their md5, so copies share one entry in the index and results do not
depend on how rows were numbered or partitioned.  Test vocabularies are broadcast in blocks of items with at most about ``block_words`` words,
so nothing that is sent to executors grows with the corpus or the benchmark.

Defined cases: null texts have no words; a null doc_id is a row like any other; repeated
rows are separate documents, repeated items count once by item_id, and an item without id
contaminates but is not listed; empty tables give rows without hits; texts of any length
are indexed whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, texts_in

#: Byte map: A-Z to a-z; bytes that are neither digits, letters nor beyond ASCII become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INDEX = "key string, n_words long, postings array<struct<pos:int,term:int,anchor:boolean>>"
_POSTING = pa.struct([("pos", pa.int32()), ("term", pa.int32()), ("anchor", pa.bool_())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def _word_list(texts: pa.Array) -> pa.Array:
    return pa.array([[w.decode("utf-8", "replace") for w in words_of(t)] for t in texts.to_pylist()], pa.list_(pa.string()))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (row number of the stored table), item_id as text, words, n."""
    words = F.arrow_udf(_word_list, "array<string>")
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    return materialize(rows.withColumn("n", F.size("words")).where("n > 0"), "bench-items")


def _frequencies(docs: DataFrame, vocabulary) -> np.ndarray:
    """Documents that hold each test term."""

    def count(batches):
        size = len(vocabulary.value)
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in texts_in(batch.column("text")):
                ids = np.fromiter(map(vocabulary.value.get, set(words_of(text)), repeat(-1)), dtype=np.int64)
                total[ids[ids >= 0]] += 1
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    found = np.zeros(len(vocabulary.value), dtype=np.int64)
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # at most one row per term of the block
        found[r["term"]] = r["df"]
    return found


def _index(docs: DataFrame, vocabulary, anchors, reach: int, shortest: int) -> DataFrame:
    def build(batches):
        anchor = anchors.value
        for batch in batches:
            counts, offsets, columns = [], [0], []
            for text in texts_in(batch.column("text")):
                words = words_of(text)
                n = len(words)
                counts.append(n)
                ids = np.fromiter(map(vocabulary.value.get, words, repeat(-1)), dtype=np.int32, count=n)
                known = ids >= 0
                at = np.flatnonzero(known)
                at = at[anchor[ids[at]]]
                if len(at):
                    near = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(near, np.maximum(at - reach, 0), 1)
                    np.add.at(near, np.minimum(at + reach + 1, n), -1)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], known, [0]))))
                    long = np.zeros(n + 1, dtype=np.int32)
                    first, last = edges[::2], edges[1::2]
                    ok = last - first >= shortest
                    long[first[ok]] += 1
                    long[last[ok]] -= 1
                    keep = (np.cumsum(near)[:n] > 0) & (np.cumsum(long)[:n] > 0)
                    keep[at] = True
                    pos = np.flatnonzero(keep & known)
                    columns.append((pos, ids[pos], anchor[ids[pos]]))
                offsets.append(offsets[-1] + (len(columns[-1][0]) if len(at) else 0))
            parts = [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0) for i in range(3)]
            flat = pa.StructArray.from_arrays([pa.array(parts[0], pa.int32()), pa.array(parts[1], pa.int32()), pa.array(parts[2].astype(bool))], fields=list(_POSTING))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "key", "n_words", "postings"])

    text = F.col("text").cast("string")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.md5(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text")).mapInArrow(build, f"doc_id {id_type}, {_INDEX}")


def _anchors(items: list[tuple[int, list[int]]], df: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(term, item, position in item) of the two rarest terms of every window that can occur."""
    chosen: set[tuple[int, int, int]] = set()
    for item, terms in items:
        size = min(width, len(terms))
        for start in range(len(terms) - size + 1):
            window = sorted(range(start, start + size), key=lambda q: (df[terms[q]], q))
            if df[terms[window[0]]]:
                chosen.update((terms[q], item, q) for q in window[:2])
    return sorted(chosen)


def _near_anchors(items: list[tuple[int, list[int]]], df: np.ndarray, width: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By term: first entry of each term, and item number and position of the anchors for near matches."""
    chosen: set[tuple[int, int, int]] = set()
    for k, (_, terms) in enumerate(items):
        size = min(width, len(terms))
        missing = size * slop // width
        for start in range(len(terms) - size + 1):
            window = sorted(range(start, start + size), key=lambda q: (df[terms[q]], q))
            known = [q for q in window[: missing + 2] if df[terms[q]]]
            if len(known) >= 2:  # else more terms are missing than may be
                chosen.update((terms[q], k, q) for q in known)
    flat = np.array(sorted(chosen), dtype=np.int64).reshape(-1, 3)
    return np.searchsorted(flat[:, 0], np.arange(len(df) + 1)), flat[:, 1], flat[:, 2]


def _near(ids: np.ndarray, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], items: list[np.ndarray], width: int, slop: int) -> list[tuple[int, int, int]]:
    """(item number, at, slip) of the best near match of each item; ``ids`` are the terms of a text, -1 for others."""
    first, item_of, place_of = anchors
    at = np.flatnonzero(ids >= 0)
    low, n = first[ids[at]], first[ids[at] + 1] - first[ids[at]]
    entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, place = item_of[entry], place_of[entry]
    align = np.repeat(at, n) - place
    order = np.lexsort((place, align, item))
    item, place, align = item[order], place[order], align[order]
    pair = np.flatnonzero((item[1:] == item[:-1]) & (align[1:] - align[:-1] <= slop) & (place[1:] != place[:-1]))
    best: dict[int, tuple[int, int, int]] = {}
    for k, base in {(int(item[i]), a) for i in pair for a in range(int(align[i + 1]) - slop, int(align[i]) + 1)}:
        terms = items[k]
        size = min(width, len(terms))
        spots = base + np.arange(len(terms)) + np.arange(slop + 1)[:, None]
        inside = (spots >= 0) & (spots < len(ids))
        same = inside & (ids[np.where(inside, spots, 0)] == terms)
        met, slips = same.any(0), same.argmax(0)
        total = np.concatenate(([0], np.cumsum(met)))
        count = total[size:] - total[:-size]
        for start in np.flatnonzero(count >= size - size * slop // width):
            q = start + np.flatnonzero(met[start : start + size])
            rank = (-int(count[start]), int(np.ptp(slips[q])), int((base + q + slips[q]).min()))
            best[k] = min(best.get(k, rank), rank)
    return [(k, at, slip) for k, (_, slip, at) in sorted(best.items())]


class Index:
    """Stored postings of one block of items, and the candidates among them."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int):
        spark = docs.sparkSession
        rows = [(r["item"], r["words"]) for r in items.select("item", "words").collect()]  # bounded by the block
        vocabulary: dict[bytes, int] = {}
        coded = [(item, [vocabulary.setdefault(w.encode("utf-8", "replace"), len(vocabulary)) for w in words]) for item, words in rows]
        shared = spark.sparkContext.broadcast(vocabulary)
        self.docs, self.coded, self.vocabulary, self.df = docs, coded, shared, _frequencies(docs, shared)
        anchors = _anchors(coded, self.df, width)
        mask = np.zeros(len(vocabulary), dtype=bool)
        mask[[t for t, _, _ in anchors]] = True
        shortest = min((min(width, len(terms)) for _, terms in coded), default=1)
        self.width = width
        self.stored = materialize(_index(docs, shared, spark.sparkContext.broadcast(mask), width - 1, shortest), "postings")
        once = self.stored.where(F.size("postings") > 0).select("key", "postings").dropDuplicates(["key"])
        self.postings = once.select("key", F.inline("postings"))
        self.terms = spark.createDataFrame([(i, q, t, len(terms)) for i, terms in coded for q, t in enumerate(terms)], "item long, q int, term int, n int")
        self.anchors = spark.createDataFrame(anchors, "term int, item long, q int")

    def phrases(self) -> DataFrame:
        """Exact phrases: key (md5 of the text), item, first and last document position of maximal runs of a window or more."""
        agreed = self.postings.where("anchor").join(F.broadcast(self.anchors), "term").select("key", "item", (F.col("pos") - F.col("q")).alias("align"), "q")
        agreed = agreed.groupBy("key", "item", "align").agg(F.count_distinct("q").alias("agree"))
        length = self.terms.select("item", "n").distinct()
        agreed = agreed.join(F.broadcast(length), "item").where("agree >= least(n, 2)").select("key", "item", "align")
        wanted = agreed.join(F.broadcast(self.terms), "item").select("key", "item", "align", "q", "n", "term", (F.col("align") + F.col("q")).alias("pos"))
        met = wanted.join(self.postings.select("key", "pos", "term"), ["key", "pos", "term"])
        run = met.withColumn("island", F.col("q") - F.row_number().over(Window.partitionBy("key", "item", "align").orderBy("q")))
        runs = run.groupBy("key", "item", "align", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"))
        return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(self.width))).select("key", "item", "first", "last")

    def proximity(self, slop: int) -> DataFrame:
        """Near matches of items without an exact phrase in the text: key (md5 of the text), item, at, slip."""
        width, vocabulary = self.width, self.vocabulary
        shared = self.docs.sparkSession.sparkContext.broadcast((_near_anchors(self.coded, self.df, width, slop), [i for i, _ in self.coded], [np.array(terms) for _, terms in self.coded]))

        def find(batches):
            anchors, names, items = shared.value
            for batch in batches:
                out = []
                for key, text in zip(batch.column("key").to_pylist(), texts_in(batch.column("text")), strict=True):
                    words = words_of(text)
                    ids = np.fromiter(map(vocabulary.value.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                    out += [(key, names[k], at, slip) for k, at, slip in _near(ids, anchors, items, width, slop)]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "item", "at", "slip"])

        text = F.col("text").cast("string")
        rows = self.docs.select(F.md5(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))
        return rows.mapInArrow(find, "key string, item long, at int, slip int").distinct().join(self.phrases().select("key", "item").distinct(), ["key", "item"], "left_anti")


def _indexes(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int) -> tuple[DataFrame, list[Index]]:
    items = _items(benchmark)
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    found = [Index(docs, items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), width) for b in range(blocks)]
    return items, found


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, first, last: exact phrases (word positions) of benchmark windows."""
    items, found = _indexes(docs, benchmark, width, block_words)
    spans = _union([i.phrases() for i in found])
    return spans.join(items.select("item", "item_id"), "item").join(found[0].stored.select("key", "doc_id"), "key").select("doc_id", "item_id", "first", "last")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, at, slip: near matches of items without an exact phrase in the text.

    ``at`` is the first matched word of the best window (most terms, then least slip, then first),
    ``slip`` how far its terms are out of place, 0 where words are only replaced.
    """
    items, found = _indexes(docs, benchmark, width, block_words)
    return _near_rows(items, found, slop)


def _near_rows(items: DataFrame, found: list[Index], slop: int) -> DataFrame:
    near = _union([i.proximity(slop) for i in found])
    listed = near.join(items.select("item", "item_id"), "item").select("key", "item_id", "at", "slip").distinct()  # repeated items count once
    return listed.join(found[0].stored.select("key", "doc_id"), "key").select("doc_id", "item_id", "at", "slip")


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, kind, at, last, slip: exact phrases (``phrase``) and near matches (``proximity``)."""
    items, found = _indexes(docs, benchmark, width, block_words)
    exact = _union([i.phrases() for i in found]).join(items.select("item", "item_id"), "item").join(found[0].stored.select("key", "doc_id"), "key")
    exact = exact.select("doc_id", "item_id", F.lit("phrase").alias("kind"), F.col("first").cast("int").alias("at"), F.col("last").cast("int").alias("last"), F.lit(0).alias("slip"))
    near = _near_rows(items, found, slop).select("doc_id", "item_id", F.lit("proximity").alias("kind"), "at", F.lit(None).cast("int").alias("last"), "slip")
    return exact.unionByName(near)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int) -> tuple[DataFrame, list[Index]]:
    """Per text with hits: key, n_hit, items."""
    items, found = _indexes(docs, benchmark, width, block_words)
    spans = materialize(_union([i.phrases() for i in found]).join(items.select("item", "item_id"), "item"), "phrases")
    covered = spans.select("key", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    listed = spans.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return covered.join(listed, "key"), found


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    hits, found = _hits(docs, benchmark, width, block_words)
    counts = found[0].stored.select("key", "doc_id", "n_words").join(hits, "key", "left")
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return counts.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, without any exact phrase of the benchmark."""
    hits, _ = _hits(docs, benchmark, width, block_words)
    bad = hits.select(F.col("key").alias("_leafmill_key"))
    return docs.join(bad, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_leafmill_key"), "left_anti")
