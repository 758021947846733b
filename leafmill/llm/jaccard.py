"""N-gram Jaccard join: rare-first prefix filtering on word shingles.

A document's set holds the 64-bit hashes of its distinct ``SHINGLE``-word shingles (with fewer
words: its whole sequence as one).  All sets order their shingles alike: first those of a fixed
share of the hash space (``_SHARE``), rarest first by their exact document frequency among
different sets; then the rest by hash; last the very common ones by hash.  Any one order gives
the same links; this one stays rare-first however large the corpus is, as the frequencies are
aggregated by key and not kept in a table of fixed size.

1. One pass gives each document its set size and set digest (64 bits of a hash of the whole
   set; copies share it) and counts all shingles in a sketch of fixed size, which tells the
   very common ones only.  Those are kept out of the frequency count, where one key would
   bring a large part of all rows to one task.
2. One pass sends the shingles of the share, and of sets that have too few of them as many
   more as their prefix takes, to their key, where frequencies are counted; what only one set
   holds is dropped there.  What is left goes back to its set: its place in the order is the
   number of dropped ones plus its rank.  A set whose first n - ceil(t n) + 1 shingles are all
   its own is out.
3. Prefixes meet by key, subject to the length, positional and suffix filters, and each pair
   is verified once by the exact intersection.  The suffix filter hashes each whole set into
   ``_RANGES`` ranges: a range that only one set of a pair uses holds a shingle that the other
   set lacks, which bounds their intersection from above.  Pairs that pass are tried again with
   ``_FINE`` ranges before their texts meet.
4. ``components`` first verifies each set against one other: of the smallest sets of its keys
   the one that most of its keys name.  Keys whose sets still lie in different components go
   on: their sets are verified against their neighbours in a random order of some of the keys,
   and then all pairs that share a key, pass the filters and still lie in different components.
   So a group of k near copies costs a multiple of k verifications and not k squared, and no
   link between components can be missed.  Keys are range-partitioned together with the sets that hold them,
   so that the rows of one key can lie in many tasks.

Texts of sets that share a key are picked with a bitmap of fixed size before they are
shuffled; the bitmap only saves work, a join decides.

Defined cases: null texts and texts without words have an empty set, n_shingles 0 and link
with nothing; equal sets are one class and link; repeated ids are separate rows; a component
whose ids are all null has a null id; an empty table gives no rows; whole texts are used.
Two different sets share a digest with probability n^2 / 2^65 for n distinct sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import discard, held, materialize, small_batches, texts_in

SHINGLE = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Sixteenths of the hash space whose shingles come first in the order.
_SHARE = 5
#: Frequencies from here on count as equal.
_TOP = 1 << 12
#: A shingle is very common if its counter holds more than this, than a 512th of the rows and than eight times the mean.
_COMMON = 255
_SKETCH_BITS = 22
_SKETCH_BLOCK = 1 << 14
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 150_000
_SEEN = 1 << 18
_RANGES = 1024
_LONGS = _RANGES // 64
_FINE = 4096
_NEIGHBOUR_KEYS = 12
#: Keys before a key that a row carries, to tell pairs that have met under one of them.
_BEFORE = 8
#: Pairs of one set that meet its text in one part.
_STAR = 512
_BITMAP_BITS = 26
_BITMAP_BLOCK = 1 << 14


class _Shingler:
    def __init__(self):
        self.words: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a whole text."""
        words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        known = self.words
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(SHINGLE, len(ids))
        out = np.full(len(ids) - size + 1, size, dtype=np.uint64)
        for j in range(size):
            out = (out ^ ids[j : j + len(out)]) * _MIX
            out ^= out >> np.uint64(31)
        return np.unique(out)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)


def keys_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys by class (0: of the share, 1: not, 2: very common) and hash; the same shingle has the same key everywhere."""
    at = _bucket(hashes)
    classes = ((hashes >> np.uint64(60)) >= np.uint64(_SHARE)).astype(np.uint64)
    classes[(common[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1] = 2
    return np.sort((classes << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1))).view(np.int64)


def digest_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def least_common(a, b):
    """Smallest intersection of sets of sizes a and b that links them."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n + (-PERCENT * n) // 100 + 1


def _profile(batches):
    """doc_id, tkey, n, sid per document, and the partition's sketch (counts to 65,535) in blocks (block >= 0)."""
    shingler, sketch = held("shingles", _Shingler), np.zeros(1 << _SKETCH_BITS, dtype=np.uint32)
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        sizes, digests = [], []
        for text in texts_in(batch.column("text")):
            s = shingler.hashes(text)
            np.add.at(sketch, _bucket(s), 1)
            sizes.append(len(s))
            digests.append(digest_of(s))
        blank = pa.nulls(len(sizes), pa.binary())
        yield pa.record_batch([batch.column("doc_id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array([-1] * len(sizes), pa.int32()), blank], names=["doc_id", "tkey", "n", "sid", "block", "counts"])
    blocks = sketch.reshape(-1, _SKETCH_BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    if len(used):
        none = pa.nulls(len(used), pa.int64())
        yield pa.record_batch([pa.nulls(len(used), kind), none, none, none, pa.array(used, pa.int32()), pa.array([np.minimum(blocks[b], 65_535).astype(np.uint16).tobytes() for b in used], pa.binary())], names=["doc_id", "tkey", "n", "sid", "block", "counts"])


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(_SKETCH_BLOCK, dtype=np.uint64)
    for counts in table.column("counts"):
        data = counts.as_py()
        total += np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * _SKETCH_BLOCK else np.uint32)
    total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _bits(batches):
    """Bitmap of the tkeys of a partition, in blocks of packed bits."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        at = np.unique(np.asarray(batch.column("tkey")) & ((1 << _BITMAP_BITS) - 1))
        blocks, first = np.unique(at // _BITMAP_BLOCK, return_index=True)
        for b, inside in zip(blocks.tolist(), np.split(at % _BITMAP_BLOCK, first[1:]), strict=True):
            block = bits.setdefault(b, np.zeros(_BITMAP_BLOCK // 8, dtype=np.uint8))
            np.bitwise_or.at(block, inside >> 3, (128 >> (inside & 7)).astype(np.uint8))
    for b, block in bits.items():
        yield pa.record_batch([pa.array([b], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "bits"])


def _or_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(_BITMAP_BLOCK // 8, dtype=np.uint8)
    for bits in table.column("bits"):
        total |= np.frombuffer(bits.as_py(), dtype=np.uint8)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})


def _signed(batches):
    """Rows with n and the used ranges of their set as ``_LONGS`` integers."""
    shingler = held("shingles", _Shingler)
    for batch in batches:
        used, sizes, fine = np.zeros((batch.num_rows, _RANGES), dtype=bool), [], []
        for i, text in enumerate(texts_in(batch.column("text"))):
            s = shingler.hashes(text)
            sizes.append(len(s))
            used[i, ((s >> np.uint64(20)) % np.uint64(_RANGES)).astype(np.int64)] = True
            row = np.zeros(_FINE, dtype=bool)
            row[((s >> np.uint64(32)) % np.uint64(_FINE)).astype(np.int64)] = True
            fine.append(np.packbits(row).tobytes())
        longs = np.packbits(used, axis=1).view("<i8")
        yield pa.record_batch([batch.column("sid"), batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int32()), pa.array(fine, pa.binary()), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(_LONGS))], names=["sid", "doc_id", "text", "n", "fine", *_SIGNATURE])


_SIGNATURE = tuple(f"g{i}" for i in range(_LONGS))


def _may_link(x: str, y: str) -> str:
    """Suffix filter of sets named by column prefixes: SQL that is false only for pairs that cannot link."""
    need = f"ceil({PERCENT} * (cast({x}n as long) + {y}n) / {100 + PERCENT})"
    lacks = lambda a, b: " + ".join(f"bit_count({a}{g} & ~{b}{g})" for g in _SIGNATURE)
    return f"({x}n - ({lacks(x, y)}) >= {need} AND {y}n - ({lacks(y, x)}) >= {need})"


def _fine_passes(n_a: pa.Array, n_b: pa.Array, fine_a: pa.Array, fine_b: pa.Array) -> pa.Array:
    """Suffix filter on ``_FINE`` ranges: false only for pairs that cannot link."""
    out = []
    for x, y, f, g in zip(n_a.to_pylist(), n_b.to_pylist(), fine_a, fine_b, strict=True):
        f, g = np.frombuffer(f.as_py(), dtype=np.uint8), np.frombuffer(g.as_py(), dtype=np.uint8)
        need = least_common(x, y)
        out.append(bool(x - np.bitwise_count(f & ~g).sum() >= need and y - np.bitwise_count(g & ~f).sum() >= need))
    return pa.array(out, pa.bool_())


def _batch(columns, names: str, kinds) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


_LONG4 = (pa.int64(),) * 4


def _entries(batches, common):
    """(key, sid, 0) of every shingle that counts or that a prefix can hold, and one (any, sid, info) of every set.

    info holds the set's size and how many of its shingles are of the share.  A partition
    repeats a set only if it is long ago.
    """
    shingler, seen = held("shingles", _Shingler), set()
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for text in texts_in(batch.column("text")):
            hashes = shingler.hashes(text)
            n = len(hashes)
            if not n or (sid := digest_of(hashes)) in seen:
                continue
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(sid)
            keys = keys_of(hashes, common)
            own = int(np.searchsorted(keys, 1 << 56))
            keys = keys[: max(own, prefix_length(n))]
            info = np.zeros(len(keys) + 1, np.int64)
            info[-1] = (n << 32) | own
            for column, value in zip(out, (np.append(keys, sid), np.full(len(info), sid), info), strict=True):
                column.append(value)
        if out[0]:
            yield _batch((np.concatenate(c) for c in out), "key sid info", _LONG4[:3])


def _frequencies(batches):
    """Of rows sorted by (key, sid): (sid, rank, key, info) of sets (rank -1) and of keys that two sets hold.

    A key of the share ranks by its frequency, up to ``_TOP``; the others rank by class.
    """
    held = [np.zeros(0, np.int64)] * 2  # rows of the last key that are not told yet
    more = False  # whether earlier rows of that key are told, with rank _TOP

    def told(key, sid):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        count = size.copy()
        if more and len(count):
            count[0] = _TOP
        count = np.repeat(count, size)
        keep = count > 1
        rank = np.where(key >> 56 == 0, np.minimum(count, _TOP), _TOP + (key >> 56))
        return sid[keep], rank[keep], key[keep], np.zeros(int(keep.sum()), np.int64)

    for batch in batches:
        key, sid, info = (np.asarray(batch.column(c)) for c in ("key", "sid", "info"))
        if (sets := info > 0).any():
            yield _batch((sid[sets], np.full(int(sets.sum()), -1), key[sets], info[sets]), "sid rank key info", _LONG4)
        key, sid = np.append(held[0], key[~sets]), np.append(held[1], sid[~sets])
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
        key, sid = key[fresh], sid[fresh]
        cut = int(np.searchsorted(key, key[-1]))
        if again := len(key) - cut >= _TOP:
            cut = len(key) - 1
        if cut:
            if again:  # the last key's rows before the cut have rank _TOP; what stands before them is whole
                whole = int(np.searchsorted(key, key[-1]))
                yield _batch(told(key[:whole], sid[:whole]), "sid rank key info", _LONG4)
                more = True
                yield _batch(told(key[whole:cut], sid[whole:cut]), "sid rank key info", _LONG4)
            else:
                yield _batch(told(key[:cut], sid[:cut]), "sid rank key info", _LONG4)
                more = False
        held = [key[cut:], sid[cut:]]
    yield _batch(told(*held), "sid rank key info", _LONG4)


def _prefixes(batches):
    """Of rows sorted by (sid, rank, key): (key, sid, n, pos) of each set's prefix, without what only it holds.

    pos is the exact place of a key of the share, and for the others that of the last key before
    which all are surely counted.
    """

    def told(sid, rank, key, info):
        if not len(sid):
            return
        first = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sid))))
        n, own = info[first] >> 32, info[first] & 0xFFFFFFFF
        shared = np.add.reduceat(((rank >= 0) & (rank <= _TOP)).astype(np.int64), first)
        at = np.arange(len(sid)) - (first + np.add.reduceat((rank < 0).astype(np.int64), first))[of]
        pos = at + (own - shared)[of]
        keep = (rank >= 0) & (pos < prefix_length(n)[of])
        yield _batch((key[keep], sid[keep], n[of][keep], pos[keep]), "key sid n pos", (*_LONG4[:2], pa.int32(), pa.int32()))

    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        held = [np.append(h, np.asarray(batch.column(c))) for h, c in zip(held, ("sid", "rank", "key", "info"), strict=True)]
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield from told(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    yield from told(*held)


def _shared_keys(batches):
    """Of rows sorted by (key, n, sid): those whose key two sets share, each set once, with their star's centre.

    The centre is the smallest set of the key; a set too long for the centre starts the next
    star.  A key can go on in the partitions beside this one: the first and the last key stay
    whatever is known of them here.
    """
    held: tuple | None = None  # last distinct row
    told = True  # whether the rows of its key are kept: for the first key, always
    centre: tuple | None = None

    def kept(key, sid, n, pos, keep):
        nonlocal centre
        out = []
        for i in np.flatnonzero(keep):
            k, s, m, p = int(key[i]), int(sid[i]), int(n[i]), int(pos[i])
            if centre is None or centre[0] != k or 100 * centre[2] < PERCENT * m:
                centre = (k, s, m, p)
            out.append((k, s, m, p, centre[1], centre[2], centre[3]))
        if out:
            yield _batch(zip(*out, strict=True), "key sid n pos c_sid c_n c_pos", (*_LONG4[:2], pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))

    for batch in batches:
        key, sid, n, pos = (np.asarray(batch.column(c)) for c in ("key", "sid", "n", "pos"))
        if held is not None:
            key, sid, n, pos = (np.append(v, c) for v, c in zip(held, (key, sid, n, pos), strict=True))
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
        key, sid, n, pos = key[fresh], sid[fresh], n[fresh], pos[fresh]
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(False, same)
        if told:
            keep |= key == key[0]
        # the last row waits for what follows
        yield from kept(key[:-1], sid[:-1], n[:-1], pos[:-1], keep[:-1])
        held, told = (key[-1:], sid[-1:], n[-1:], pos[-1:]), bool(keep[-1])
    if held is not None:
        yield from kept(*held, np.ones(1, bool))


def _beside(batches):
    """Of rows sorted by (key, order): the pairs of neighbours under one key that have different labels."""
    last = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        key, sid, label = (np.append(v, np.asarray(batch.column(c))) for v, c in zip(last, ("key", "sid", "label"), strict=True))
        last = [key[-1:], sid[-1:], label[-1:]]
        pair = (key[1:] == key[:-1]) & (label[1:] != label[:-1])
        x, y = sid[1:][pair], sid[:-1][pair]
        yield _batch((np.maximum(x, y), np.minimum(x, y)), "a b", _LONG4[:2])


def _linked(batches):
    """The exact intersection of the two texts of each pair."""
    shingler = held("shingles", _Shingler)
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
    for batch in batches:
        out = []
        for a, b, text_a, text_b in zip(*(texts_in(batch.column(c)) for c in ("a", "b", "text_a", "text_b")), strict=True):
            if last[0] != text_b:
                last = (text_b, shingler.hashes(text_b))
            x, y = shingler.hashes(text_a), last[1]
            need = least_common(len(x), len(y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= need:
                out.append((a, b, common, len(x) + len(y) - common))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "intersection", "union"])


def _merged(parts: DataFrame, merge, schema: str, fan_in: int = 32) -> DataFrame:
    """One row a block of what every partition of a stored frame has for it, merged in a tree, so that no task holds more than ``fan_in`` rows of a block or so."""
    tasks = parts.rdd.getNumPartitions()  # asks for the plan only: nothing is shuffled before ``parts``
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        parts = parts.withColumn("salt", F.spark_partition_id() % tasks).groupBy("block", "salt").applyInArrow(merge, schema)
    return parts.groupBy("block").applyInArrow(merge, schema)


def _bitmap_of(rows: DataFrame) -> dict[int, bytes]:
    """Bitmap, in blocks, of the tkeys of ``rows``: a fixed number of bits, 8 MB at most."""
    blocks = _merged(rows.select("tkey").mapInArrow(_bits, "block int, bits binary"), _or_blocks, "block int, bits binary")
    return {r["block"]: bytes(r["bits"]) for r in blocks.collect()}


def _likely(tkeys: pa.Array, bitmap: dict[int, bytes]) -> pa.Array:
    """Whether the bitmap has the bit of each tkey."""
    at = np.asarray(tkeys) & ((1 << _BITMAP_BITS) - 1)
    out = np.zeros(len(at), dtype=bool)
    for b in np.unique(at // _BITMAP_BLOCK):
        here = at // _BITMAP_BLOCK == b
        inside = at[here] % _BITMAP_BLOCK
        bits = np.frombuffer(bitmap.get(int(b), bytes(_BITMAP_BLOCK // 8)), dtype=np.uint8)
        out[here] = (bits[inside >> 3] >> (7 - (inside & 7)).astype(np.uint8)) & 1
    return pa.array(out)


def _common_bits(sketch: DataFrame, common: int) -> np.ndarray:
    """Which counters of the sketch stand for very common shingles, as packed bits; ``sketch`` has a fixed number of counters."""
    blocks = _merged(sketch.select("block", "counts"), _sum_blocks, "block int, counts binary")
    counts = np.zeros((1 << _SKETCH_BITS) // _SKETCH_BLOCK * _SKETCH_BLOCK, dtype=np.uint32).reshape(-1, _SKETCH_BLOCK)
    for r in blocks.collect():
        counts[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return np.packbits(counts.ravel() > max(common, 8 * counts.mean(dtype=np.float64)))


class Shingles:
    """Set sizes and digests of all documents, and the prefix keys that different sets share.

    ``close`` deletes what it has written; nothing that reads it can be used after that.
    """

    def __init__(self, docs: DataFrame, common: int = _COMMON):
        spark = docs.sparkSession
        small_batches(spark)
        id_type = docs.schema["doc_id"].dataType.simpleString()
        text = F.col("text").cast("string")
        self.docs = docs.select("doc_id", F.xxhash64(text).alias("tkey"), text.alias("text"))
        profile = materialize(self.docs.mapInArrow(_profile, f"doc_id {id_type}, tkey long, n long, sid long, block int, counts binary"), "shingle-profile")
        self.members = profile.where("block < 0").select("doc_id", "tkey", "n", "sid")
        bits = _common_bits(profile.where("block >= 0"), max(common, self.members.count() // 512))
        shared = spark.sparkContext.broadcast(bits.tobytes())
        entries = self.docs.select("text").mapInArrow(lambda b: _entries(b, np.frombuffer(shared.value, dtype=np.uint8)), "key long, sid long, info long")
        found = entries.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_frequencies, "sid long, rank long, key long, info long")
        found = found.repartition("sid").sortWithinPartitions("sid", "rank", "key").mapInArrow(_prefixes, "key long, sid long, n int, pos int")
        prefixes = materialize(found, "prefixes")
        by_key = prefixes.repartitionByRange("key", "n", "sid").sortWithinPartitions("key", "n", "sid")
        self.shared = materialize(by_key.mapInArrow(_shared_keys, "key long, sid long, n int, pos int, c_sid long, c_n int, c_pos int"), "shared-keys")
        discard(prefixes)
        # each set once, by its smallest row; sets are reduced before they meet, however many copies one has
        once = self.members.where("n > 0").groupBy("sid", "doc_id", "tkey").agg(F.count("*").alias("c"))
        smallest = once.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey", "c")).alias("r"))
        reps = smallest.join(self.shared.select("sid").distinct(), "sid").select("sid", F.col("r.doc_id").alias("r_id"), F.col("r.tkey").alias("tkey"), F.col("r.c").alias("c"))
        reps = materialize(reps, "candidates")
        bitmap = spark.sparkContext.broadcast(_bitmap_of(reps))
        likely = F.arrow_udf(lambda tkeys: _likely(tkeys, bitmap.value), "boolean")
        found = self.docs.where(likely("tkey")).join(reps.select("sid", "r_id", "tkey"), "tkey").where(F.col("doc_id").eqNullSafe(F.col("r_id"))).select("sid", "doc_id", "text")
        if not reps.where("c > 1").isEmpty():  # rows that repeat an id and a text
            found = found.dropDuplicates(["sid"])
        signature = ", ".join(f"{g} long" for g in _SIGNATURE)
        self.texts = materialize(found.mapInArrow(_signed, f"sid long, doc_id {id_type}, text string, n int, fine binary, {signature}"), "candidate-texts")
        discard(reps)
        self._written = [profile, self.shared, self.texts]

    def close(self) -> None:
        discard(*self._written)

    @staticmethod
    def _passes(a_n: str, a_pos: str, b_n: str, b_pos: str):
        """Length filter (b is the smaller set) and positional filter, of the first key that two sets share."""
        length = f"100 * {b_n} >= {PERCENT} * {a_n}"
        need = f"ceil({PERCENT} * (cast({a_n} as long) + {b_n}) / {100 + PERCENT})"
        return F.expr(f"{length} AND least({a_n} - {a_pos}, {b_n} - {b_pos}) >= {need}")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs of sids: a, b, intersection, union."""
        pairs = materialize(pairs.select("a", "b"), "pairs")
        self._written.append(pairs)
        met = pairs
        for side, other in ("ab", "ba"):
            # a set of many pairs, such as a star's centre, meets them in several parts
            stars = pairs.groupBy(side).agg(F.count("*").alias("pairs")).where(F.col("pairs") > _STAR).select(side, F.ceil(F.col("pairs") / _STAR).cast("int").alias("parts"))
            text = self.texts.select(F.col("sid").alias(side), F.col("text").alias(f"text_{side}"))
            if stars.isEmpty():
                met = met.join(text, side)
                continue
            text = text.join(stars, side, "left").select(side, f"text_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            met = met.join(stars, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
            met = met.join(text, [side, "part"]).drop("part")
        return met.select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long, intersection long, union long")

    def _signatures(self, prefix: str, name: str) -> DataFrame:
        return self.texts.select(F.col("sid").alias(name), *(F.col(c).alias(f"{prefix}{c}") for c in ("n", *_SIGNATURE)))

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs of sids that pass the length filter and the suffix filter."""
        signed = pairs.join(self._signatures("x_", "a"), "a").join(self._signatures("y_", "b"), "b")
        return signed.where(f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n) AND {_may_link('x_', 'y_')}").select("a", "b")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs of sids that pass the fine suffix filter."""
        a, b = (self.texts.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}")) for c in "ab")
        passes = F.arrow_udf(_fine_passes, "boolean")("n_a", "n_b", "fine_a", "fine_b")
        return pairs.join(a, "a").join(b, "b").where(passes).select("a", "b")

    def star_pairs(self) -> DataFrame:
        """One pair (a > b) of each set, with the smallest set of its keys that most of them name."""
        stars = self.shared.where("sid <> c_sid").where(self._passes("n", "pos", "c_n", "c_pos"))
        named = stars.groupBy("sid", "c_sid").agg(F.count("*").alias("c"))
        best = named.groupBy("sid").agg(F.max_by("c_sid", F.struct("c", "c_sid")).alias("c_sid"))
        return best.select(F.greatest("sid", "c_sid").alias("a"), F.least("sid", "c_sid").alias("b")).distinct()

    def mixed(self, labels: DataFrame, shared: DataFrame | None = None) -> DataFrame:
        """Rows (key, sid, n, pos, label, most, least_n) of the keys whose sets have different labels; most is the most frequent one."""
        rows = (self.shared if shared is None else shared).select("key", "sid", "n", "pos").join(labels.select("sid", "label"), "sid", "left")
        rows = rows.withColumn("label", F.coalesce("label", "sid"))
        per_label = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        per_key = per_label.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("most"), F.min("n").alias("least_n"))
        rows = materialize(rows.join(per_key.where("labels > 1").drop("labels"), "key"), "mixed-keys")
        self._written.append(rows)
        return rows

    @staticmethod
    def neighbour_pairs(mixed: DataFrame) -> DataFrame:
        """Pairs (a > b) of different labels that are neighbours in a random order of one of ``_NEIGHBOUR_KEYS`` keys of a set.

        The pairs left out here are not lost, ``crossing_pairs`` takes up all that still matter.
        """
        few = Window.partitionBy("sid").orderBy(F.xxhash64("key"), "key")
        rows = mixed.select("key", "sid", "label").withColumn("k", F.row_number().over(few)).where(F.col("k") <= _NEIGHBOUR_KEYS)
        rows = rows.select("key", "sid", "label", F.xxhash64("sid", "key").alias("order")).repartitionByRange("key", "order", "sid").sortWithinPartitions("key", "order", "sid")
        return rows.mapInArrow(_beside, "a long, b long").distinct()

    def meetings(self, mixed: DataFrame) -> DataFrame:
        """Pairs (a > b) of the rows that ``mixed`` gives that share a key, pass the filters and have different labels.

        Near copies share many keys, but a pair is told at its first common one, and again only
        where neither of the ``_BEFORE`` keys before in one set is among those of the other.
        What holds at a key holds at every earlier common one, as places only grow: so the
        first is never left out.
        """
        # no set of the key is small enough to meet the others at this position
        partner = f"greatest(least_n, ceil({PERCENT} * n / 100))"
        before = Window.partitionBy("sid").orderBy("pos", "key").rowsBetween(-_BEFORE, -1)
        open_rows = mixed.where(f"n - pos >= ceil({PERCENT} * (n + {partner}) / {100 + PERCENT})").withColumn("before", F.collect_list("key").over(before)).drop("n")
        rows = materialize(open_rows.join(self._signatures("", "sid"), "sid"), "open-rows")
        self._written.append(rows)
        side = ("sid", "n", "pos", "label", "most", "before", *_SIGNATURE)
        x, y = (d.select("key", *(F.col(c).alias(f"{p}_{c}") for c in side)) for d, p in ((rows.where("label <> most"), "x"), (rows, "y")))
        smaller = F.expr("y_n < x_n OR (y_n = x_n AND y_sid < x_sid)")
        passes = (smaller & self._passes("x_n", "x_pos", "y_n", "y_pos")) | (~smaller & self._passes("y_n", "y_pos", "x_n", "x_pos"))
        once = F.expr("y_label = y_most OR y_sid < x_sid") & ~F.arrays_overlap("x_before", "y_before")
        met = x.join(y, (x["key"] == y["key"]) & F.expr("x_label <> y_label") & passes & F.expr(_may_link("x_", "y_")) & once)
        return met.select(F.greatest("x_sid", "y_sid").alias("a"), F.least("x_sid", "y_sid").alias("b"))

    def crossing_pairs(self, mixed: DataFrame) -> DataFrame:
        """The pairs of ``meetings``, each once."""
        return self.meetings(mixed).distinct()


def connected(links: DataFrame) -> DataFrame:
    """sid, label of every linked node: the smallest sid that its links reach."""
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "links")
    labels = materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("sid"), "label"), "labels")
    while True:
        reached = edges.join(labels.withColumnRenamed("sid", "v"), "v").groupBy(F.col("u").alias("sid")).agg(F.min("label").alias("near"))
        step = labels.join(reached, "sid").select("sid", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        to = labels.select(F.col("sid").alias("label"), F.col("label").alias("root"))
        after = materialize(step.join(to, "label").select("sid", F.least("label", "root").alias("label"), "was"), "labels")
        discard(labels)
        labels = after
        if after.where("label <> was").isEmpty():
            discard(edges)
            return after

def join(docs: DataFrame) -> DataFrame:
    """a, b, intersection, union: every link between two different sets, each named by its smallest doc_id."""
    found = Shingles(docs)
    every = found.shared.select("sid", F.col("sid").alias("label")).distinct()
    links = found.verify(found.plausible(found.crossing_pairs(found.mixed(every))))
    name = found.texts.select("sid", "doc_id")
    links = links.join(name.select(F.col("sid").alias("a"), F.col("doc_id").alias("doc_a")), "a")
    links = links.join(name.select(F.col("sid").alias("b"), F.col("doc_id").alias("doc_b")), "b")
    links = materialize(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "intersection", "union"), "jaccard-links")
    found.close()
    return links


def components(docs: DataFrame, common: int = _COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the smallest doc_id that links reach.

    ``common`` is the least document frequency from which a shingle can count as very common;
    it moves work about and changes no result.
    """
    found = Shingles(docs, common)
    links = materialize(found.verify(found.plausible(found.alike(found.star_pairs()))).select("a", "b"), "star-links")
    labels = connected(links)
    mixed = None
    for pairs in (lambda rows: found.alike(found.neighbour_pairs(rows)), found.crossing_pairs):
        mixed = found.mixed(labels, mixed)
        more = materialize(found.verify(found.plausible(pairs(mixed))).select("a", "b"), "more-links")
        if not more.isEmpty():
            every = materialize(links.union(more), "links")
            discard(links, labels)
            links, labels = every, connected(every)
        discard(more)
    smallest = found.members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least_id")).join(labels.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    classes = materialize(smallest, "classes")
    names = classes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_sid = classes.join(names, "label").select("sid", "component_id")
    rows = found.members.where("n > 0").join(by_sid, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rows = rows.unionByName(found.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    rows = materialize(rows, "components")
    discard(links, labels, classes)
    found.close()
    return rows


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: those of its smallest doc_id.

    Rows without words stand for themselves.  Where rows repeat an id, exact repetitions are
    reduced to one row and different texts under one id all stay.  Only texts whose id may have
    to go are shuffled.
    """
    found = components(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_leafmill_id")).agg(F.count("*").alias("_leafmill_n"))
    repeated = not keep.where("_leafmill_n > 1").isEmpty()
    # texts of ids that a bitmap of the others cannot hold stay where they are; the bitmap only saves work, the join decides
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.xxhash64("doc_id").alias("tkey"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap_of(gone))
    likely = F.arrow_udf(lambda tkeys: _likely(tkeys, bitmap.value), "boolean")(F.xxhash64("doc_id"))
    open_rows = docs.where(likely).join(keep, F.col("doc_id").eqNullSafe(F.col("_leafmill_id")), "left_semi")
    kept = docs.where(~likely).union(open_rows)
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
