"""Hierarchical residual packing into sequences of a fixed length.

Documents longer than a sequence are cut so that only their first piece is short.  Full pieces
are sequences of their own; short ones are items.  Items are dealt by a hash of their row over
partitions of a bounded number of items, and every partition packs its own by best fit, longest
first.  Bins that are nearly full are closed; the others go on as items of the next round,
where a fraction of the partitions packs the bins of several again, until one partition holds
what is left.  Only row numbers and lengths move between rounds; a bin carries its members.

A partition keeps at most ``keep`` of its emptiest bins open, so no task of a later round sees
more than it can hold, whatever the number of documents; bins that are closed for that are
whole and valid, only not filled up any further.

Defined cases: null texts count as empty and consist of the end token alone; a document whose
length is a multiple of the sequence length has full pieces only; equal texts and repeated ids
are separate rows; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import discard, materialize, texts_in
from leafmill.llm.packing import default_ranks, tokens_of

_FLUSH = 4 << 20
_ID_BYTES = 2


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin): longest first, each into the fullest bin that still has room for it.

    Bins are kept by their free space, and a bit set of the spaces in use finds the smallest
    that is large enough, so an item costs the same whatever the number of bins.
    """
    free: list[list[int]] = [[] for _ in range(room + 1)]
    spaces, fills = 0, []
    place = np.empty(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bins = free[space]
            b = bins.pop()
            if not bins:
                spaces ^= 1 << space
            fills[b] += size
        else:
            space, b = room, len(fills)
            fills.append(size)
        left = space - size
        if left:
            free[left].append(b)
            spaces |= 1 << left
        place[i] = b
    return place, np.array(fills, dtype=np.int64)


def _tokenised(batches, path: str, end_id: int, room: int) -> Iterator[pa.RecordBatch]:
    """Rows with their ids, written a few megabytes at a time, and the number of their first full piece."""
    encode = tokens_of(path)
    end = np.array([end_id], dtype="<u2").tobytes()
    full = TaskContext.get().partitionId() << 40

    def rows(row, doc, ids, first) -> pa.RecordBatch:
        return pa.record_batch([pa.array(row, pa.int64()), doc.take(pa.array([r for r, _ in ids], pa.int64())), pa.array([len(i) // _ID_BYTES for _, i in ids], pa.int64()), pa.array(first, pa.int64()), pa.array([i for _, i in ids], pa.binary())], names=["row", "doc_id", "n", "full_at", "ids"])

    for batch in batches:
        numbers, doc = np.asarray(batch.column("row")), batch.column("doc_id")
        row, ids, first, held = [], [], [], 0
        for k, text in enumerate(texts_in(batch.column("text"), 64)):
            found = (encode(text) if text else b"") + end
            row.append(int(numbers[k]))
            ids.append((k, found))
            first.append(full)
            full += len(found) // _ID_BYTES // room
            held += len(found)
            if held > _FLUSH:
                yield rows(row, doc, ids, first)
                row, ids, first, held = [], [], [], 0
        if row:
            yield rows(row, doc, ids, first)


def _round(table: pa.Table, room: int, nearly: int, keep: int, last: bool) -> pa.Table:
    """One best-fit round of a partition; ``members`` and ``lengths`` of a bin are those of its items, in order."""
    members, lengths = table.column("members").to_pylist(), table.column("lengths").to_pylist()
    order = sorted(range(len(members)), key=lambda i: members[i][0])  # the same in every run
    place, fills = best_fit(np.array([sum(lengths[i]) for i in order], dtype=np.int64), room)
    held: list[list[int]] = [[] for _ in fills]
    for i, b in zip(order, place.tolist(), strict=True):
        held[b].append(i)
    is_open = np.zeros(len(fills), dtype=bool)
    if not last:
        roomy = np.flatnonzero(room - fills > nearly)
        is_open[roomy[np.argsort(fills[roomy], kind="stable")[:keep]]] = True
    return pa.table({"members": pa.array([[m for i in h for m in members[i]] for h in held], pa.list_(pa.int64())), "lengths": pa.array([[n for i in h for n in lengths[i]] for h in held], pa.list_(pa.int32())), "is_open": pa.array(is_open)})


_BINS = "members array<long>, lengths array<int>, is_open boolean"


def rounds(items: DataFrame, room: int, most: int = 1 << 15, fan_in: int = 8, nearly: int = 8) -> list[DataFrame]:
    """Stored closed bins of every round over ``items`` (row, length); together they hold every item once.

    ``most`` bounds the items of a partition, ``fan_in`` of which meet in one of the next round;
    bins with at most ``nearly`` free places are closed.
    """
    partitions = max(1, -(-items.count() // most))
    now = items.select(F.array("row").alias("members"), F.array(F.col("length").cast("int")).alias("lengths"), F.pmod(F.xxhash64("row"), F.lit(partitions)).alias("at"))
    stored: list[DataFrame] = []

    def packer(last: bool):
        return lambda table: _round(table, room, nearly, most // fan_in, last)

    while True:
        stored.append(materialize(now.groupBy("at").applyInArrow(packer(partitions == 1), _BINS), f"bins-{len(stored)}"))
        if partitions == 1:
            return stored
        partitions = -(-partitions // fan_in)
        now = stored[-1].where("is_open").select("members", "lengths", F.pmod(F.xxhash64(F.element_at("members", 1), F.lit(len(stored))), F.lit(partitions)).alias("at"))


def _places(batches) -> Iterator[pa.RecordBatch]:
    """(row, sequence_id, offset) of every member of closed bins; a bin is named after its first member."""
    for batch in batches:
        for at in range(0, len(batch), 1024):
            members, lengths = (batch.column(c).slice(at, 1024).to_pylist() for c in ("members", "lengths"))
            out = [(m, -1 - bin_[0], before) for bin_, sizes in zip(members, lengths, strict=True) for m, before in zip(bin_, accumulate(sizes, initial=0), strict=False)]
            yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["row", "sequence_id", "offset"])


def _cut(batches, room: int) -> Iterator[pa.RecordBatch]:
    """Pieces of rows that know the bin and place of their short piece."""
    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "full_at", "sequence_id", "offset", "ids")]
        for at in range(0, len(batch), 64):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")}
            for doc_id, full, sequence, offset, ids in zip(*(c.slice(at, 64).to_pylist() for c in columns), strict=True):
                n, start, piece = len(ids) // _ID_BYTES, 0, 0
                while start < n:
                    length = (n % room if piece == 0 else room) or room
                    cut = np.frombuffer(ids, dtype="<u2")[start : start + length].astype("<u4").tobytes()
                    where = (sequence, offset) if length < room else (full, 0)
                    full += length == room
                    for k, v in zip(out, (doc_id, piece, start, length, cut, *where), strict=True):
                        out[k].append(v)
                    start, piece = start + length, piece + 1
            kinds = {"doc_id": batch.schema.field("doc_id").type, "piece": pa.int32(), "ids": pa.binary()}
            yield pa.record_batch([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def pack(docs: DataFrame, seq_len: int = 1024, ranks_path: str | None = None, end_id: int = 2, most: int = 1 << 15) -> DataFrame:
    """Pieces of all rows: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    A bin of short pieces has a negative number, that of its first member; a full piece counts
    on from the number of its partition.
    """
    path, kind = ranks_path or default_ranks(), docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    tokens = materialize(rows.mapInArrow(lambda b: _tokenised(b, path, end_id, seq_len), f"row long, doc_id {kind}, n long, full_at long, ids binary"), "binpack-ids")
    items = tokens.select("row", (F.col("n") % seq_len).alias("length")).where("length > 0")
    bins = rounds(items, seq_len, most)
    closed = bins[-1]
    for b in bins[:-1]:
        closed = closed.unionByName(b.where("NOT is_open"))
    places = materialize(closed.select("members", "lengths").mapInArrow(_places, "row long, sequence_id long, offset long"), "binpack-places")
    discard(*bins)
    found = tokens.join(places, "row", "left").select("doc_id", "full_at", "sequence_id", "offset", "ids")
    return found.mapInArrow(lambda b: _cut(b, seq_len), f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 in place of their ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
