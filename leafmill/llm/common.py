"""Helpers that the training-data operators share: table reads, shared storage, bounded samples.

``held`` is the only state that a worker keeps between tasks.  ``materialize`` is the only way an
operator cuts lineage: it writes Parquet to the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a reread and nothing else.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set only when the session names no shared folder (local tests).
_LOCAL_FALLBACK: dict[str, str] = {}
_HELD: dict[str, Any] = {}
_BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL_FALLBACK["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20}).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._leafmill_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what ``materialize`` has written for these frames; nothing may read them later."""
    for df in stored:
        jvm, path = df.sparkSession._jvm, df._leafmill_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of an Arrow batch of this session, as texts can be long; a bound that the user has set stays."""
    if spark.conf.get(_BATCH_BYTES) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_BYTES, most)


def held(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this Python worker between tasks, and nothing else beside it.

    Workers outlive the stage that they were started for, so what an earlier operator has loaded
    (a tokenizer, a cache of words) goes as soon as a task of another one asks for its own.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can give freed memory back
                ctypes.CDLL(None).malloc_trim(0)
        _HELD[name] = make()
    return _HELD[name]


def texts_in(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """Values of an Arrow column as Python strings, converted a few rows at a time to bound memory."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def fold(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % buckets


def hash_below(col: Column, fraction: float, salt: int) -> Column:
    """True for about ``fraction`` of the values of ``col``, the same ones in every run."""
    grain = 1 << 30
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(grain)) < int(min(1.0, fraction) * grain)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, learnable: Column, limit: int, id_col: str = "doc_id", text_col: str = "text", salt: int = 17
) -> DataFrame:
    """(text, label) of about ``limit`` labelled rows, or of all where there are fewer.

    Rows are taken by a hash of their id, so the sample is the same in every run and
    spread over the whole table.  Only ids (at most about ``limit``) are broadcast; the
    texts never shuffle.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    marked = marked.where(learnable)
    total = marked.count()
    taken = marked if total <= limit else marked.where(hash_below(F.col("_id"), limit / total, salt))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "_id").select("text", F.col("_y").alias("label"))
