"""Document fingerprints: improbable-feature digests in chained Bloom filters.

Every ``WINDOW``-byte window of the UTF-8 text gets a rarity rank from its byte entropy: in
prose, windows of high entropy are the improbable ones, and windows below ``_WEAK`` bits rank
last, all alike.  In each run of ``_NEIGHBOURS`` windows the leftmost rarest one gains a point.
Features are the windows with ``_POPULAR`` points (all runs, if a text has fewer) and the
``_LEAST`` rarest different windows of the text, ties by hash: so texts of every length are
treated alike, and the digest of a short one does not hang on a few windows.  Features enter
2048-bit Bloom filters in text order, ``_PER_FILTER`` to a filter.  Likeness is the mean over
the shorter chain's filters of the best bit overlap with a filter of the other chain,
normalised between what chance gives and what containment gives.

Defined cases: a null text counts as empty; an empty text has the fingerprint ``0``, likeness
1 with another empty text and 0 with any other; a text shorter than a window is one window,
filled up with zero bytes.  Equal texts have equal fingerprints and likeness 1.  Texts are
read whole.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import small_batches, texts_in

WINDOW = 8
_NEIGHBOURS = 32
_POPULAR = 8
_PER_FILTER = 160
_BITS = 2048
_HASHES = 5
_WEAK = 2.0
_BLOCK = 1 << 19
_LEAST = 64
_SCALE = 40
_G = np.zeros(WINDOW + 1)
_G[1:] = np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))
#: What the r-th occurrence of a byte adds to the sum of c log2 c, in fixed point.
_GAIN = np.round(np.diff(_G, prepend=0.0) * _SCALE).astype(np.uint8).tobytes().ljust(256, b"\0")
_MOST = _SCALE * WINDOW * int(np.log2(WINDOW))
EMPTY = "0"


def ranks(raw: np.ndarray) -> np.ndarray:
    """Rarity of every window: its entropy in fixed point, 0 where it is too weak to use."""
    n = len(raw) - WINDOW + 1
    total = np.zeros(n, dtype=np.uint16)
    seen = np.ones(len(raw), dtype=np.uint8)  # occurrences of byte i among the last d + 1 bytes
    for d in range(WINDOW):
        if d:
            seen[d:] += (raw[d:] == raw[:-d]).view(np.uint8)
        total += np.frombuffer(seen[d : d + n].tobytes().translate(_GAIN), dtype=np.uint8)
    rank = _MOST - np.minimum(total, _MOST)
    rank[rank < int(_WEAK * _SCALE * WINDOW)] = 0
    return rank


def features(data: bytes) -> np.ndarray:
    """64-bit hashes of the selected windows, in text order, each once."""
    raw = np.frombuffer(data.ljust(WINDOW, b"\0"), dtype=np.uint8)
    n = len(raw) - WINDOW + 1
    runs = max(1, n - _NEIGHBOURS + 1)
    at, hashes, rarest = [], [], (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for start in range(0, n, _BLOCK):  # bounds memory on very long texts; a block sees the runs that reach over its edges
        low = max(0, start - _NEIGHBOURS + 1)
        part = raw[low : start + _BLOCK + _NEIGHBOURS + WINDOW - 2]
        rank = ranks(part)
        own = slice(start - low, min(start - low + _BLOCK, len(rank)))
        mixed = _hashed(part[own.start : own.stop + WINDOW - 1])
        points = _points(rank)[own]
        popular = np.flatnonzero(points >= min(_POPULAR, runs))
        at.append(start + popular)
        hashes.append(mixed[popular])
        rarest = _rarest(*(np.append(a, b) for a, b in zip(rarest, (mixed, rank[own].astype(np.int64), start + np.arange(len(mixed))), strict=True)))
    every, places = np.append(np.concatenate(hashes), rarest[0]), np.append(np.concatenate(at), rarest[2])
    order = np.argsort(places, kind="stable")
    every = every[order]
    _, first = np.unique(every, return_index=True)
    return every[np.sort(first)]


def _rarest(mixed: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first occurrences of the ``_LEAST`` different windows of highest rank, ties by hash."""
    for most in (4 * _LEAST, len(rank)):
        likely = np.flatnonzero(rank >= np.partition(rank, len(rank) - most)[len(rank) - most]) if most < len(rank) else np.arange(len(rank))
        _, first = np.unique(mixed[likely], return_index=True)
        if len(first) >= _LEAST or len(likely) == len(rank):
            break
    kept = likely[first]
    kept = kept[np.lexsort((mixed[kept], -rank[kept]))][:_LEAST]
    return mixed[kept], rank[kept], at[kept]


def _hashed(raw: np.ndarray) -> np.ndarray:
    """Mixed 64-bit value of every window."""
    n = len(raw) - WINDOW + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mixed |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _points(rank: np.ndarray) -> np.ndarray:
    """In how many runs of neighbours each window is the leftmost of the rarest."""
    n = len(rank)
    span = min(_NEIGHBOURS, n)
    key = (rank.astype(np.uint32) << np.uint32(20)) | (n - np.arange(n)).astype(np.uint32)  # rarest first, then leftmost
    best, width = key, 1
    while width * 2 <= span:
        best = np.maximum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.maximum(best[: len(best) - (span - width)], best[span - width :])
    winner = n - (best & np.uint32(0xFFFFF)).astype(np.int64)
    return np.bincount(winner[best >= 1 << 20], minlength=n)


def filters(data: bytes) -> np.ndarray:
    """The chain of Bloom filters as rows of bits."""
    if not data:
        return np.zeros((0, _BITS), dtype=bool)
    found = features(data)
    chain = np.zeros(((len(found) + _PER_FILTER - 1) // _PER_FILTER, _BITS), dtype=bool)
    row = np.arange(len(found)) // _PER_FILTER
    for i in range(_HASHES):
        chain[row, ((found >> np.uint64(12 * i)) & np.uint64(_BITS - 1)).astype(np.int64)] = True
    return chain


def text_of(chain: np.ndarray) -> str:
    return ":".join(np.packbits(f).tobytes().hex() for f in chain) or EMPTY


def chain_of(fingerprint: str) -> np.ndarray:
    if fingerprint == EMPTY:
        return np.zeros((0, _BITS), dtype=bool)
    return np.stack([np.unpackbits(np.frombuffer(bytes.fromhex(f), dtype=np.uint8)).astype(bool) for f in fingerprint.split(":")])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 (what chance gives) to 1, the same in both directions."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    size_a, size_b = a.sum(axis=1)[:, None].astype(float), b.sum(axis=1)[None, :].astype(float)
    common = a.astype(np.float32) @ b.astype(np.float32).T
    chance, most = size_a * size_b / _BITS, np.minimum(size_a, size_b)
    overlap = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    if len(a) < len(b):
        return float(overlap.max(axis=1).mean())
    return float((overlap.max(axis=1).mean() + overlap.max(axis=0).mean()) / 2)


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text as a string; a null text counts as empty."""
    return F.arrow_udf(lambda texts: pa.array([text_of(filters((t or "").encode("utf-8", "replace"))) for t in texts_in(texts)], pa.string()), "string")(text)


def compare(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint strings; null if one is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [None if p is None or q is None else likeness(chain_of(p), chain_of(q)) for p, q in zip(texts_in(x), texts_in(y), strict=True)]
        return pa.array(found, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def _with_next(batches):
    """Rows sorted by (bucket, ghost, order): each real row meets the one after it."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    held = None  # bucket, doc_id, text, chain of the row that waits for its next
    for batch in batches:
        kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        out: list[tuple] = []
        for bucket, ghost, doc_id, text in zip(*(texts_in(batch.column(c)) for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
            if ghost and (held is None or held[0] != bucket):
                continue  # a tie of the ghost that was used
            chain = filters(text.encode("utf-8", "replace"))
            if held is not None:
                _, held_id, held_text, held_chain = held
                half = len(held_text) // 2
                edited = (held_text[: len(held_text) - half] + text[:half]).encode("utf-8", "replace")
                changed = filters(edited)
                out.append((held_id, len(held_text), hashlib.sha256(edited).hexdigest(), text_of(held_chain), text_of(changed), likeness(held_chain, changed), likeness(held_chain, chain)))
            held = None if ghost else (bucket, doc_id, text, chain)
        if out:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))


def with_edited(docs: DataFrame, bucket_bytes: int = 8 << 20, most_buckets: int = 100_000) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses.

    The next document of a row is the one before it in ascending doc_id order (ids that are no
    integers sort as text; ties by text; null ids first); after the last comes the first.  Ids
    alone are range-partitioned first, which gives the borders of ranges of about
    ``bucket_bytes`` of text.  The highest row of each range is sent a second time, as a ghost,
    to the range above it, so one shuffle of the texts suffices and tasks stream through sorted
    ranges without holding one.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    order_type = "long" if isinstance(id_type, T.IntegralType) else "string"
    lowest = F.lit(-(1 << 63) + 1) if order_type == "long" else F.lit("")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast(order_type), lowest).alias("order"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(1, min(most_buckets, int(size["n"]), int((size["b"] or 0) // bucket_bytes)))
    ranges = rows.select("order").repartitionByRange(parts, "order").groupBy(F.spark_partition_id().alias("p")).agg(F.min("order").alias("first"), F.max("order").alias("top"))
    borders = sorted((r["first"], r["top"]) for r in ranges.collect())  # one row per range; equal ids are in one range
    known = docs.sparkSession.sparkContext.broadcast(([first for first, _ in borders], {top: (i + 1) % len(borders) for i, (_, top) in enumerate(borders)}))

    def places(orders: pa.Array) -> pa.Array:
        firsts, above = known.value
        found = [(bisect.bisect_right(firsts, o) - 1, above.get(o)) for o in orders.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["bucket", "also"])

    placed = rows.withColumn("place", F.arrow_udf(places, "struct<bucket:long,also:long>")("order"))
    here = F.struct(F.col("place.bucket").alias("bucket"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("place.also").alias("bucket"), F.lit(True).alias("ghost"))
    spread = placed.select("doc_id", "text", "order", F.explode(F.when(F.col("place.also").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    spread = spread.select("doc_id", "text", "order", "at.bucket", "at.ghost").repartitionById(max(1, len(borders)), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "ghost", F.desc("order"), "text")
    kinds = f"doc_id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return spread.select("bucket", "ghost", "doc_id", "text").mapInArrow(_with_next, kinds)
