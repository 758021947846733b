"""Row numbers, runs and rolling windows of keys that may hold most of a table.

A window function sorts all rows of a key in one task.  Here rows are range-partitioned by key
and order together and written once, so a key lies in as many tasks as its rows need; what the
tasks need of each other is one small row per key and task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.shared import new_path


def ranged(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` range-partitioned by keys and order and written, with ``_task`` and ``_row``, their place in it."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = placed.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def same_keys(keys: list[str], prefix: str = "_") -> Column:
    """Equal keys, null ones included, of two sides of which one has the prefix."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among the rows of their keys.

    Rows with equal keys and order are numbered in any order, nulls come first, null keys are a
    key of their own, and an empty table stays empty.
    """
    placed = ranged(rows, keys, order, "numbered")
    parts = placed.groupBy(*keys, "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_task").alias("_at"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(parts, same_keys(keys) & (F.col("_task") == F.col("_at"))).withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first")).select(*rows.columns, "pos")


def in_blocks(rows: DataFrame, reach: int, block: int = 100_000) -> DataFrame:
    """``numbered`` rows with ``block`` and ``ghost``: each block also holds, as ghosts, the ``reach`` rows before it."""
    if reach >= block:
        raise ValueError("a block has to be longer than the reach")
    at = F.floor(F.col("pos") / block)
    late = F.col("pos") % block >= block - reach
    own = F.struct(at.alias("block"), F.lit(False).alias("ghost"))
    return rows.select("*", F.inline(F.when(late, F.array(own, F.struct((at + 1).alias("block"), F.lit(True).alias("ghost")))).otherwise(F.array(own))))


def looking_back(placed: DataFrame, keys: list[str], reach: int, columns: dict[str, Callable[[Window], Column]], block: int = 100_000) -> DataFrame:
    """``numbered`` rows with columns over windows that look ``reach`` rows back, built from a window without a frame."""
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    found = in_blocks(placed, reach, block).withColumns({name: of(w) for name, of in columns.items()})
    return found.where(~F.col("ghost")).drop("block", "ghost")


def rolling(rows: DataFrame, keys: list[str], order: list[str], size: int, columns: dict[str, Column], block: int = 100_000) -> DataFrame:
    """``rows`` with aggregates over the last ``size`` rows of their keys, each row counted in."""
    over = {name: lambda w, c=c: c.over(w.rowsBetween(1 - size, 0)) for name, c in columns.items()}
    return looking_back(numbered(rows, keys, order), keys, size - 1, over, block).select(*rows.columns, *columns)


def lagged(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], block: int = 100_000) -> DataFrame:
    """``rows`` with columns of the row before under new names; null for the first of a key."""
    over = {name: lambda w, c=c: F.lag(c).over(w) for name, c in columns.items()}
    return looking_back(numbered(rows, keys, order), keys, 1, over, block).select(*rows.columns, *columns)


def tail(placed: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The last ``most`` of the ``numbered`` rows of each key; every task sorts out its own before they are shuffled."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))
    return placed.withColumn("_back", back).where(F.col("_back") <= most).drop("_back")


def running_count(rows: DataFrame, keys: list[str], order: list[str], what: Column, name: str, block: int = 100_000) -> DataFrame:
    """``rows`` with how many rows of their keys up to each of them meet ``what``; null counts as not met."""
    found = numbered(rows.withColumn("_hit", F.when(what, 1).otherwise(0)), keys, order).withColumn("block", F.floor(F.col("pos") / block))
    sums = found.groupBy(*keys, "block").agg(F.sum("_hit").alias("_hits"))
    before = F.sum("_hits").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("block").alias("_block"), F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum("_hit").over(Window.partitionBy(*keys, "block").orderBy("pos"))
    return found.withColumn("_inside", inside).join(sums, same_keys(keys) & (F.col("block") == F.col("_block"))).select(*rows.columns, (F.col("_base") + F.col("_inside")).alias(name))


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact quantile of each key, linear between neighbours; nulls do not enter, keys without values have no row.

    Weighted selection: equal values are counted first, so one of them may have nearly all rows;
    only the ranges of distinct values that hold the wanted ranks are looked at after that.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = ranged(counts, keys, [value], "values")
    by_key = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "_task").agg(F.sum("_c").alias("_n"))  # a row for each key and range
    before = F.coalesce(F.sum("_n").over(by_key.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_rank": (F.sum("_n").over(by_key) - 1) * q}).where((F.col("_before") <= F.ceil("_rank")) & (F.col("_before") + F.col("_n") > F.floor("_rank")))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_task").alias("_at"), "_before", "_rank")
    near = placed.join(parts, same_keys(keys) & (F.col("_task") == F.col("_at")))
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_task").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_before") + F.coalesce(inside, F.lit(0))
    near = near.withColumn("_start", start).where((F.col("_start") <= F.ceil("_rank")) & (F.col("_start") + F.col("_c") > F.floor("_rank")))
    part = F.max("_rank") - F.floor(F.max("_rank"))
    return near.groupBy(*keys).agg((F.min(value) + part * (F.max(value) - F.min(value))).alias(name))


def greedy(at: np.ndarray, apart: int, last: int | None) -> list[int]:
    """Positions of sorted moments that are kept: each at least ``apart`` after the one kept before it."""
    kept, i = [], 0 if last is None else int(np.searchsorted(at, last + apart))
    while i < len(at):
        kept.append(i)
        i = int(np.searchsorted(at, at[i] + apart))
    return kept
