"""Continuous jobs as Structured Streaming queries.

Jobs of many keys keep one small state per key (``state``) in RocksDB and end it by event-time
timers; jobs that look back within few, long keys carry a tail from batch to batch; the rest are
windowed aggregates.  Rows of a key are sorted within a micro-batch, so results do not depend on
how a batch was split; batches themselves follow the source's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import sequence
from leafmill.operators.health import stage_of
from leafmill.operators.pages import safe_rate
from leafmill.sources.shared import new_path, remove, written
from leafmill.streaming import state

MICROS = 1_000_000
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the queries that start inside; the session's own choice is put back."""
    own = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, own)


def read(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream over the Parquet files of a table; the schema is that of the table."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if not path.endswith(".parquet") else f"{path}*")


def run(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Drive a stream over what is there and return its output: appended rows, or the last row of each of ``keys``.

    With ``keys`` every batch writes only the rows that it changed, so what a batch costs
    follows its input and state behind a watermark can go.  A stream without output rows gives
    an empty frame.
    """
    spark, out, place = stream.sparkSession, new_path(stream.sparkSession, name), new_path(stream.sparkSession, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", place).trigger(availableNow=True)
    if keys is None:
        with _rocks(spark):
            writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    writer.outputMode("update").foreachBatch(keep).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    changes = written(spark, out, schema)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("last")).where("last IS NOT NULL").select("last.*")


def _keyed(stream: DataFrame, key: str, processor: state.Timed, schema: str, moment: str, delay: str) -> DataFrame:
    """``processor`` over the rows of each key, in event time; rows without a moment are left out, those behind the watermark too."""
    rows = stream.where(F.col(moment).isNotNull()).withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay)
    return rows.withColumn("at", F.unix_micros(moment)).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _after(moment: str, seconds: int) -> Column:
    return F.timestamp_micros(F.col(moment) + seconds * MICROS)


def in_batches(stream: DataFrame, name: str, keys: list[str], order: list[str], reach: int, columns: dict[str, Callable], block: int = 100_000) -> DataFrame:
    """Rows of a stream with columns over windows that look ``reach`` rows back within their keys.

    Each batch is one job over its rows and the last ``reach`` rows of every key that the batch
    before left behind, cut into blocks, so a stream of a single key runs over many tasks.  What
    a batch writes, its rows and its tail, lies under its number: a batch that is run again
    writes the same again.  Rows that are older than their key's tail are placed into it as far as
    it reaches back.
    """
    spark, out, place = stream.sparkSession, new_path(stream.sparkSession, name), new_path(stream.sparkSession, f"{name}-checkpoint")

    def look(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_old", F.lit(False))
        if number:
            rows = spark.read.schema(rows.schema).parquet(f"{out}/tail/{number - 1}").withColumn("_old", F.lit(True)).unionByName(rows)
        placed = sequence.numbered(rows, keys, order)
        found = sequence.looking_back(placed, keys, reach, columns, block)
        found.where(~F.col("_old")).select(*stream.columns, *columns).write.mode("overwrite").parquet(f"{out}/rows/{number}")
        sequence.tail(placed, keys, reach).drop("pos").write.mode("overwrite").parquet(f"{out}/tail/{number}")
        if number > 1:
            remove(spark, f"{out}/tail/{number - 2}")

    schema = sequence.looking_back(stream.limit(0).withColumn("pos", F.lit(0)), keys, reach, columns, block).select(*stream.columns, *columns).schema
    stream.writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(look).start().awaitTermination()
    return written(spark, f"{out}/rows", schema)


def drift(stream: DataFrame, baselines: DataFrame, size: int = 200, sigmas: float = 3.0, block: int = 100_000) -> DataFrame:
    """Every observation with the mean of its metric's last ``size`` values, and whether that left the baseline.

    Without baseline or spread it has not; null values do not enter a mean.
    """
    over = {"window_mean": lambda w: F.avg("value").over(w.rowsBetween(1 - size, 0)), "window_n": lambda w: F.count("*").over(w.rowsBetween(1 - size, 0))}
    rows = in_batches(stream.select("metric", "value", "ts", "seq"), "drift", ["metric"], ["ts", "seq"], size - 1, over, block)
    far = F.abs(F.col("window_mean") - F.col("mean")) > sigmas * F.col("std")
    rows = rows.join(F.broadcast(baselines.select("metric", "mean", "std")), "metric", "left")  # one row for each known metric
    return rows.select("metric", "seq", "window_mean", "window_n", F.coalesce((F.col("std") > 0) & far, F.lit(False)).alias("drifted"))


def triggers(stream: DataFrame, known: tuple[str, ...], days: int = 7, delay: str = "1 hour") -> DataFrame:
    """Outcome of each trigger under the cooldown of its type; of equal times the least id is recorded, null types are unknown ones.

    A type's state goes once the watermark is past its cooldown.
    """
    rows = stream.select("trigger_type", "trigger_id", "fired_at", (F.col("status") == "resolved").alias("r")).withColumn("resolved", F.coalesce("r", F.lit(False))).drop("r")
    return _keyed(rows, "trigger_type", state.Cooldown(known, days * 86_400 * MICROS), "trigger_id long, outcome string", "fired_at", delay)


def alerts(stream: DataFrame, seconds: int, absent: int, delay: str = "10 minutes") -> DataFrame:
    """Alerts (series, since, fired_at) of conditions that held for ``seconds``; each fires once, at ``since`` plus that time.

    A condition holds from a firing tick on until a tick denies it, or until ``absent`` seconds
    went by without one.  An alert that no further tick confirms fires by a timer when the
    watermark, ``delay`` behind the newest tick of all series, passes its time.  A null
    condition denies; ticks of one moment have to agree.
    """
    rows = stream.select("series", "ts", F.coalesce("firing", F.lit(False)).alias("firing"))
    found = _keyed(rows, "series", state.Persisting(seconds * MICROS, absent * MICROS), "series string, since long", "ts", delay)
    return found.select("series", _after("since", 0).alias("since"), _after("since", seconds).alias("fired_at"))


def page_states(stream: DataFrame, idle_days: int = 90, delay: str = "1 hour") -> DataFrame:
    """Every event with the state that its page is in after it; a null state or target never applies.

    Events of a page are taken by ``seq`` within a batch.  A page without events for
    ``idle_days`` is forgotten: later ones find it queued.
    """
    rows = stream.select("page_id", "seq", "expected", "target", "ts")
    return _keyed(rows, "page_id", state.PageState(idle_days * 86_400 * MICROS), "page_id string, seq long, applied boolean, state string, completed boolean", "ts", delay)


def stale_tasks(stream: DataFrame, timeout: int, delay: str = "1 hour") -> DataFrame:
    """(task_id, stale_from, stale_at) of tasks without a sign of life for ``timeout`` seconds.

    A task that speaks again is told when it does, one that never does when the watermark passes
    ``stale_at``; either gives one row, and the state of a stale task goes.  Signs older than the
    last one known change nothing.
    """
    rows = stream.select(F.col("task_id").cast("string").alias("task_id"), "ts")
    found = _keyed(rows, "task_id", state.Stale(timeout * MICROS), "task_id string, stale_from long", "ts", delay)
    return found.select("task_id", _after("stale_from", 0).alias("stale_from"), _after("stale_from", timeout).alias("stale_at"))


def dedupe(stream: DataFrame, key: str = "task_id", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first of repeated deliveries; keys are forgotten ``within`` after their watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def stage_health(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Success rate of every stage per window, late by at most an hour."""
    rows = stream.withColumn("invoked_at", F.col("invoked_at").cast("timestamp")).withWatermark("invoked_at", "1 hour").groupBy(F.window("invoked_at", width), stage_of(F.col("service_name")).alias("stage"))
    s = rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"))
    return s.select(F.col("window.start").alias("window_start"), "stage", "total", "succeeded", safe_rate(F.col("succeeded"), F.col("total")).alias("success_rate"))


def kpi(stream: DataFrame) -> DataFrame:
    """Gauges that every batch updates: calls and success share."""
    return stream.groupBy().agg(F.count("*").alias("calls"), safe_rate(F.count_if(F.col("status") == "success"), F.count("*")).alias("success_rate"))


def counter_increase(stream: DataFrame, width: str, slide: str, delay: str = "1 hour", block: int = 100_000) -> DataFrame:
    """Increase of counters (series, ts, value) per sliding window; a fall is a reset, and nothing is extrapolated.

    The step between two samples belongs to the window of the later one.  The first sample of a
    series, and one after a null, gives nothing; samples of one moment follow in any order, and
    one that comes in a later batch than newer ones gives nothing.  A first stream carries the last sample of every series
    from batch to batch, a second one sums the steps in event-time windows.
    """
    rows = in_batches(stream.select("series", "ts", "value"), "counter", ["series"], ["ts"], 1, {"before": lambda w: F.lag("value").over(w)}, block)
    before = F.col("before")
    gain = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    spark, out = stream.sparkSession, new_path(stream.sparkSession, "counter-steps")
    rows.select("series", F.col("ts").cast("timestamp").alias("ts"), gain.alias("gain")).write.parquet(out)
    steps = read(spark, out).withWatermark("ts", delay).groupBy("series", F.window("ts", width, slide)).agg(F.sum("gain").alias("increase"))
    return run(steps.select("series", F.col("window.start").alias("window_start"), F.round("increase", 6).alias("increase")), "increase", ["series", "window_start"])


def histogram(events: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts le_0, le_1, ... of (series, value) up to each bound, one pass; null values count nowhere."""
    return events.groupBy("series").agg(*(F.count_if(F.col("value") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)))


def long_buckets(counts: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """(series, le, count) rows of what ``histogram`` gives."""
    each = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("count")) for i, b in enumerate(bounds)))
    return counts.select("series", F.inline(each))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Quantile from cumulative buckets (series, le, count), linear within a bucket; beyond the last bound it is that bound."""
    w = Window.partitionBy("series").orderBy("le")
    rows = buckets.withColumns({"below": F.coalesce(F.lag("count").over(w), F.lit(0)), "lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("count").over(Window.partitionBy("series"))})
    hit = rows.where((F.col("count") >= q * F.col("total")) & (F.col("total") > 0)).groupBy("series").agg(F.min(F.struct("le", "lo", "below", "count", "total")).alias("h")).select("series", "h.*")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (q * F.col("total") - F.col("below")) / F.nullif(F.col("count") - F.col("below"), F.lit(0))
    return hit.select("series", F.round(F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.coalesce(inside, F.col("le"))), 6).alias("quantile"))


def ratio_counts(events: DataFrame, num: Column, den: Column, width: str) -> DataFrame:
    """window_start, n and d: how many events of each window meet ``num`` and ``den``."""
    s = events.groupBy(F.window("ts", width)).agg(F.count_if(num).alias("n"), F.count_if(den).alias("d"))
    return s.select(F.col("window.start").alias("window_start"), "n", "d")


def ratio_alert(counts: DataFrame, threshold: float) -> DataFrame:
    """n / max(d, 1) of each window against a threshold; windows without events have no row."""
    ratio = F.col("n") / F.greatest(F.col("d"), F.lit(1))
    return counts.select("window_start", F.round(ratio, 6).alias("ratio"), (ratio > threshold).alias("firing"))
