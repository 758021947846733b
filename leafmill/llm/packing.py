"""Packing along a space-filling curve.

Each document is tokenised once; its tokens are hashed into a signed count vector, which a
fixed projection maps to ``_DIMS`` coordinates and a Hilbert key.  Documents are range-sorted
by (key, row), laid end to end and cut every ``seq_len`` tokens, so neighbours on the curve
share sequences and only the very last sequence has padding.

The shuffle that sorts carries keys and lengths only; the ids are written once to shared
storage and joined to their place afterwards.  Offsets come from per-partition sums, so no
task sees all rows.

Defined cases: null texts count as empty and consist of the end token alone; texts of any
length are cut freely; equal texts have equal keys and are ordered by row; repeated ids
are separate rows; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import held, materialize, texts_in

_DIMS, _BITS, _HASHED = 4, 15, 128


def default_ranks() -> str:
    """Ranks of the public 50k byte-level BPE; the same vocabulary as its tokenizers file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Tokens:
    """Ids of a text as little-endian uint16.

    A text goes to the encoder whole, in one call: splitting it and looking its words up in a
    cache takes twice the time, as most distinct words of a corpus stand in few texts.
    """

    END_OF_TEXT = "<|endoftext|>"

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if len(ranks) >= 1 << 16:
            raise ValueError("ids are kept in two bytes")
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.END_OF_TEXT: len(ranks)})
        self.allowed = {self.END_OF_TEXT}

    def __call__(self, text: str) -> bytes:
        if self.END_OF_TEXT in text:
            ids = self.encoding.encode(text, allowed_special=self.allowed, disallowed_special=())
        else:
            ids = self.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}H", *ids)


def tokens_of(path: str) -> _Tokens:
    return held(f"tokens of {path}", lambda: _Tokens(path))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of integer ``points`` (n x dims), by Skilling's transpose method."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _projection() -> np.ndarray:
    """Fixed pseudo-random directions, the same in every process."""
    return np.random.Generator(np.random.PCG64(20240229)).standard_normal((_HASHED, _DIMS))


_PROJECTION = _projection()
_HASHES = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
_DIM_OF, _SIGN_OF = (_HASHES % np.uint64(_HASHED)).astype(np.int64), np.where((_HASHES >> np.uint64(12)) & np.uint64(1), 1.0, -1.0)


def _vector(ids: np.ndarray) -> np.ndarray:
    hashed = np.bincount(_DIM_OF[ids], weights=_SIGN_OF[ids], minlength=_HASHED)
    return hashed / (np.linalg.norm(hashed) or 1.0)


def _tokenised(batches, path: str, end_id: int):
    encode = tokens_of(path)
    for batch in batches:
        end = np.array([end_id], dtype="<u2").tobytes()
        ids = [(encode(t) if t else b"") + end for t in texts_in(batch.column("text"))]
        vectors = np.stack([_vector(np.frombuffer(i, dtype="<u2")) for i in ids]) if ids else np.zeros((0, _HASHED))
        grid = np.clip((vectors @ _PROJECTION / 3 + 1) / 2 * (1 << _BITS), 0, (1 << _BITS) - 1)
        yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(hilbert_keys(grid, _BITS), pa.int64()), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "key", "n", "ids"])


def _running(batches):
    """Start of each row within its sorted partition."""
    at = 0
    for batch in batches:
        n = np.asarray(batch.column("n"))
        ends = at + np.cumsum(n)
        yield pa.record_batch([batch.column("row"), batch.column("part"), pa.array(ends - n, pa.int64()), batch.column("n")], names=["row", "part", "local", "n"])
        if len(n):
            at = int(ends[-1])


def _cut(batches, seq_len: int):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        for doc_id, ids, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "at")), strict=True):
            n, start = len(ids) // 2, 0
            while start < n:
                sequence, offset = divmod(base + start, seq_len)
                length = min(n - start, seq_len - offset)
                piece = np.frombuffer(ids, dtype="<u2")[start : start + length].astype("<u4").tobytes()
                for k, v in zip(out, (doc_id, start, length, piece, n, sequence, offset), strict=True):
                    out[k].append(v)
                start += length
        kinds = {"doc_id": batch.schema.field("doc_id").type, "ids": pa.binary()}
        yield pa.record_batch([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def pack(docs: DataFrame, seq_len: int = 2048, ranks_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    path = ranks_path or default_ranks()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    tokens = materialize(rows.mapInArrow(lambda b: _tokenised(b, path, end_id), f"row long, doc_id {id_type}, key long, n long, ids binary"), "pack-ids")
    ordered = tokens.select("row", "key", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    placed = materialize(ordered.select("row", "n", F.spark_partition_id().alias("part")).mapInArrow(_running, "row long, part int, local long, n long"), "pack-order")
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"))  # one row per sorted partition
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    starts = placed.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("local")).alias("at"))
    found = tokens.select("row", "doc_id", "ids").join(starts, "row").select("doc_id", "ids", "at")
    return found.mapInArrow(lambda b: _cut(b, seq_len), f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
