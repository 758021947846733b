"""Throughput, service health, drift baselines and other aggregates; one aggregate per source table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import sequence
from leafmill.operators.pages import TERMINAL, safe_rate, terminal_in_window, ts
from leafmill.sources.shared import new_path, remove

STAGES = ("preprocessing", "rectification", "layout", "classification")


def stage_of(service: Column) -> Column:
    """Stage of a service; null and unknown services count as classification."""
    return F.when(service.isin("geometry_a", "geometry_b"), "preprocessing").when(service == "rectify", "rectification").when(service.isin("layout_a", "layout_b"), "layout").otherwise("classification")


def page_rates(pages: DataFrame, now: str, hours: int) -> DataFrame:
    """Pages per wall-clock hour and per active hour; active only if every page has a time and they sum above 0."""
    a = terminal_in_window(pages, now, hours).agg(F.count("*").alias("n"), F.count("processing_time_ms").alias("timed"), F.sum("processing_time_ms").alias("ms"))
    active = F.when((F.col("n") == F.col("timed")) & (F.col("ms") > 0), F.round(F.col("n") / (F.col("ms") / 3.6e6), 4))
    return a.select("n", F.round(F.col("n") / hours, 4).alias("wall_rate"), active.alias("active_rate"))


def acceptance_rates(pages: DataFrame) -> DataFrame:
    """Accepted over terminal pages (the numerator is not limited to terminal ones), approved over those with a verdict."""
    return pages.agg(safe_rate(F.count_if(F.col("status") == "accepted"), F.count_if(F.col("status").isin(*TERMINAL))).alias("acceptance"), safe_rate(F.count_if(F.col("qa_approved")), F.count("qa_approved")).alias("agreement"))


def dashboard(pages: DataFrame, jobs: DataFrame, now: str, hours: int) -> DataFrame:
    """One row of page counts, active jobs, acceptance and page rates; empty tables give zeros, and null rates where nothing was timed."""
    s = F.col("status")
    counts = pages.agg(F.count("*").alias("n_pages"), F.count_if(s == "accepted").alias("n_accepted"), F.count_if(s == "review").alias("n_review"), F.count_if(s == "failed").alias("n_failed"), F.count_if(s == "pending_human_correction").alias("n_pending"))
    totals = jobs.agg(F.count_if(F.col("status").isin("running", "queued")).alias("n_active_jobs"))
    for part in (totals, acceptance_rates(pages), page_rates(pages, now, hours).drop("n")):
        counts = counts.crossJoin(F.broadcast(part))  # one row each
    return counts


def stage_health(invocations: DataFrame, now: str, hours: int) -> DataFrame:
    """Success rate of every stage since ``hours`` before ``now``; stages without calls stay, with rate 0."""
    recent = invocations.where(F.col("invoked_at") >= ts(now) - F.expr(f"INTERVAL {hours} HOURS"))
    found = recent.groupBy(stage_of(F.col("service_name")).alias("stage")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"))
    stages = invocations.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    rows = stages.join(found, "stage", "left").select("stage", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "succeeded")))
    return rows.withColumn("success_rate", safe_rate(F.col("succeeded"), F.col("total")))


def review_rates(lineage: DataFrame, invocations: DataFrame, now: str, hours: int) -> DataFrame:
    """One row of human corrections in the window, per hour, and the share of rescues that were not skipped (0 without any); null times are outside the window."""
    start = ts(now) - F.expr(f"INTERVAL {hours} HOURS")
    fixes = lineage.where(F.col("human_corrected") & (F.col("human_correction_timestamp") >= start)).agg(F.count("*").alias("n_corrections"))
    used = invocations.where("service_name = 'rectify'").agg(safe_rate(F.count_if(F.col("status") != "skipped"), F.count("*")).alias("rescue_rate"))
    return fixes.select("n_corrections", F.round(F.col("n_corrections") / hours, 4).alias("corrections_per_hour")).crossJoin(F.broadcast(used))


def service_inventory(invocations: DataFrame, approximate: bool = False) -> DataFrame:
    """Calls, errors, success rate, last call and p95 of each service.

    Nulls do not enter p95, and a service without times has none.  The exact p95 is read off
    row numbers, so that a service with most calls is no single task; ``approximate`` takes a
    sketch instead.
    """
    aggregates = [F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status").isin("error", "timeout")).alias("errors"), F.max("invoked_at").alias("last_seen")]
    if approximate:
        rows = invocations.groupBy("service_name").agg(*aggregates, F.percentile_approx("processing_time_ms", 0.95).alias("p95_ms"))
    else:
        p95 = sequence.quantile(invocations, ["service_name"], "processing_time_ms", 0.95, "p95_ms").withColumnRenamed("service_name", "service")
        rows = invocations.groupBy("service_name").agg(*aggregates).join(p95, F.col("service_name").eqNullSafe(F.col("service")), "left").drop("service")
    return rows.withColumns({"p95_ms": F.round("p95_ms", 4), "success_rate": F.round(F.col("succeeded") / F.nullif(F.col("total"), F.lit(0)), 4)})


def catalogue_inventory(catalogue: DataFrame, invocations: DataFrame) -> DataFrame:
    """Calls of each catalogue row (service, pattern), a pattern join against the few distinct services."""
    per = invocations.groupBy("service_name").agg(F.count("*").alias("n"))
    return catalogue.join(F.broadcast(per), F.expr("service_name ILIKE pattern"), "left").groupBy("service").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def training_status(jobs: DataFrame, now: str, hours: int = 72, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Jobs by status, and the last ``most`` completed ones of the window, newest first, ties by id; a null status is a status."""
    recent = jobs.where((F.col("status") == "completed") & (F.col("completed_at") >= ts(now) - F.expr(f"INTERVAL {hours} HOURS")))
    return jobs.groupBy("status").agg(F.count("*").alias("n")), recent.orderBy(F.col("completed_at").desc(), "train_job_id").limit(most)


def rolling_drift(observations: DataFrame, baselines: DataFrame, size: int = 200, sigmas: float = 3.0, block: int = 100_000) -> DataFrame:
    """Mean of the last ``size`` values of each metric, and whether it left the baseline.

    Without baseline or spread it has not; null values do not enter a mean.  Metrics are cut
    into blocks of rows, so one metric can hold all of them.
    """
    rows = sequence.rolling(observations.select("metric", "ts", "seq", "value"), ["metric"], ["ts", "seq"], size, {"window_mean": F.avg("value"), "window_n": F.count("*")}, block)
    far = F.abs(F.col("window_mean") - F.col("mean")) > sigmas * F.col("std")
    rows = rows.join(F.broadcast(baselines), "metric", "left")  # one row for each known metric
    return rows.select("metric", "seq", F.round("window_mean", 9).alias("window_mean"), "window_n", F.coalesce((F.col("std") > 0) & far, F.lit(False)).alias("drifted"))


def baselines(observations: DataFrame, least: int = 200) -> DataFrame:
    """Count, mean and deviation of each metric with at least ``least`` rows; null values count as rows but enter no mean."""
    return observations.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev("value"), 6).alias("std")).where(F.col("n") >= least)


def merged_baselines(known: DataFrame, observed: DataFrame) -> DataFrame:
    """Baselines (metric, mean, std, source): what ``baselines`` measured replaces the known row of its metric.

    Metrics of either side stay; one row a metric on each side is taken for granted.
    """
    new = observed.select("metric", F.col("mean").alias("new_mean"), F.col("std").alias("new_std"), F.lit("empirical").alias("new"))
    rows = known.select("metric", "mean", "std").join(new, "metric", "full")
    fresh = F.col("new").isNotNull()
    return rows.select("metric", F.when(fresh, F.col("new_mean")).otherwise(F.col("mean")).alias("mean"), F.when(fresh, F.col("new_std")).otherwise(F.col("std")).alias("std"), F.coalesce("new", F.lit("analytic")).alias("source"))


def failure_streaks(invocations: DataFrame, least: int = 5, block: int = 100_000) -> DataFrame:
    """Runs of at least ``least`` failures in a row of each service; a success ends a run, a null status is a failure.

    Runs are told apart by how many successes came before, counted in blocks of rows.
    """
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    rows = sequence.running_count(invocations.select("service_name", "invoked_at", "id", "status"), ["service_name"], ["invoked_at", "id"], ok, "island", block).where(~ok)
    return rows.groupBy("service_name", "island").agg(F.count("*").alias("length"), F.min("invoked_at").alias("first_at"), F.max("invoked_at").alias("last_at")).where(F.col("length") >= least).drop("island")


def persisting(ticks: DataFrame, seconds: int, block: int = 100_000) -> DataFrame:
    """Runs of ticks (series, ts, firing) that stay true for at least ``seconds``; null is not true.

    Runs are told apart by how many ticks denied before, counted in blocks of rows whose sums are
    carried on, so one series may have all ticks; ticks of one moment follow in any order.
    """
    firing = F.coalesce("firing", F.lit(False))
    rows = sequence.running_count(ticks.select("series", "ts", "firing"), ["series"], ["ts"], ~firing, "island", block).where(firing)
    runs = rows.groupBy("series", "island").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("ticks"))
    return runs.where(F.unix_timestamp("until") - F.unix_timestamp("since") >= seconds).drop("island")


def cooldown(events: DataFrame, days: int = 7) -> DataFrame:
    """Events (kind, fired_at, event_id) that are kept: those at least ``days`` after the last kept one of their kind.

    Events of one moment count once, by their least id; null moments are left out, null kinds
    are a kind.  Events and the moments from which each lets the next one pass are sorted
    together into ranges, so an event's successor is what follows in its range or else the first
    event of a later one.  Within a range a task knows for every event where a run of kept ones
    that starts there leaves the range; the ranges that a kind's first event reaches are then
    found by doubling the step, which takes the logarithm of the ranges, not of the events, and
    none where a kind lies in one.
    """
    apart, kind = days * 86_400 * 1_000_000, events.schema["fired_at"].dataType
    per = events.where(F.col("fired_at").isNotNull()).groupBy("kind", "fired_at").agg(F.min("event_id").alias("event_id"))
    rows = per.select(F.coalesce("kind", F.lit("\0")).alias("k"), F.unix_micros(F.col("fired_at").cast("timestamp")).alias("at"), "event_id")
    offers = rows.select("k", F.col("at").alias("moment"), F.lit(True).alias("offer"), "at", "event_id")
    asks = rows.select("k", (F.col("at") + apart).alias("moment"), F.lit(False).alias("offer"), "at", F.lit(None).cast("long").alias("event_id"))
    placed = sequence.ranged(offers.unionByName(asks), ["k"], ["moment", "offer"], "cooldown")
    offered = F.when(F.col("offer"), F.col("moment"))
    ranges = placed.groupBy("k", "_task").agg(F.min(offered).alias("first")).where("first IS NOT NULL")  # a row for each kind and range
    entries = ranges.groupBy("k").agg(F.min("first").alias("at"), F.count("*").alias("n"))
    most = entries.agg(F.max("n")).first()[0] or 0
    own = placed.where("offer").select("k", "at", "event_id", F.col("_task").alias("range"))
    entries, made = entries.select("k", "at"), []
    if most > 1:
        inside = F.min(offered).over(Window.partitionBy("k", "_task").orderBy(F.desc("_row")))
        later = F.min("first").over(Window.partitionBy("k").orderBy("_task").rowsBetween(1, Window.unboundedFollowing))
        ends = placed.groupBy("k", "_task").agg(F.min(offered).alias("first")).withColumn("later", later).select(F.col("k").alias("k2"), F.col("_task").alias("task2"), "later")
        found = placed.withColumn("inside", inside).where("NOT offer").join(ends, (F.col("k") == F.col("k2")) & (F.col("_task") == F.col("task2")))
        steps = own.select("k", "at", "range").join(found.select("k", "at", F.coalesce("inside", "later").alias("next")), ["k", "at"])
        jumps = steps.groupBy("k", "range").applyInArrow(_exits, "k string, at long, next long")
        jumps = _stored(jumps, "cooldown-jumps", made)
        for _ in range((most - 1).bit_length()):  # entries holds the first 2^i ranges that a kind reaches, jumps leads 2^i on
            more = entries.join(jumps, ["k", "at"]).where("next IS NOT NULL").select("k", F.col("next").alias("at"))
            entries = _stored(entries.union(more), "cooldown-entries", made)
            on = jumps.select(F.col("k").alias("k2"), F.col("at").alias("at2"), F.col("next").alias("next2"))
            jumps = _stored(jumps.where("next IS NOT NULL").join(on, (F.col("k") == F.col("k2")) & (F.col("next") == F.col("at2"))).select("k", "at", F.col("next2").alias("next")), "cooldown-jumps", made)
    started = own.join(entries, ["k", "at"]).select(F.col("k").alias("k2"), F.col("range").alias("range2"), F.col("at").alias("entry"))
    runs = own.join(started, (F.col("k") == F.col("k2")) & (F.col("range") == F.col("range2"))).select("k", "range", "at", "event_id", "entry")
    kept = runs.groupBy("k", "range").applyInArrow(lambda t: _kept(t, apart), "k string, at long, event_id long")
    if made:
        kept = _stored(kept, "cooldown-kept", [])
        for path in made:
            remove(events.sparkSession, path)
    return kept.select(F.nullif("k", F.lit("\0")).alias("kind"), F.timestamp_micros("at").cast(kind).alias("fired_at"), "event_id")


def _exits(table: pa.Table) -> pa.Table:
    """For every event of a range, the event behind the range that a run of kept ones from it leads to."""
    table = table.sort_by("at")
    at, after = np.asarray(table.column("at")), table.column("next")
    to = np.asarray(after.fill_null(-(1 << 63)))
    jump = np.searchsorted(at, to)
    stays = (jump < len(at)) & (at[np.minimum(jump, len(at) - 1)] == to)
    jump = np.where(stays, jump, np.arange(len(at)))
    while not (jump == (on := jump[jump])).all():
        jump = on
    return pa.table({"k": table.column("k"), "at": table.column("at"), "next": after.take(pa.array(jump))})


def _kept(table: pa.Table, apart: int) -> pa.Table:
    """The kept events of a range from its entry on."""
    table = table.sort_by("at")
    at, entry = np.asarray(table.column("at")), int(table.column("entry")[0].as_py())
    return table.select(["k", "at", "event_id"]).take(pa.array(sequence.greedy(at, apart, entry - apart), pa.int64()))


def _stored(rows: DataFrame, name: str, made: list[str]) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    made.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
