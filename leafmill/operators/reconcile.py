"""Queue reconciliation, audit joins and latest-row lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.pages import AUTOMATABLE, HUMAN_ONLY, PAGE_KEY, TERMINAL, is_stale, ts

TASK = "task_id string, page_id string, job_id string, retry_count int, _bad string"
COMPLETE = ("accepted", "review", "failed", "split", "pending_human_correction", "ptiff_qa_pending")
ACTIVE = ("preprocessing", "rectification", "layout_detection", "semantic_norm")


def parse_tasks(raw: DataFrame) -> DataFrame:
    """Queue items with their fields; ``poison`` marks text that is not a task."""
    parsed = F.from_json("raw", TASK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("task", parsed).select(*raw.columns, "task.task_id", "task.page_id", "task.job_id", "task.retry_count", (F.col("task._bad").isNotNull() | F.col("task.task_id").isNull()).alias("poison"))


def latest(df: DataFrame, keys: list[str], value: str, *order: Column | str) -> DataFrame:
    """``value`` of the row that is last in ``order``, one row per key: an aggregate, not a sort."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def with_latest_reason(pages: DataFrame, gates: DataFrame) -> DataFrame:
    """Pages with the newest review reason of their job and number, ties by gate id; null if there is none."""
    last = gates.where("review_reason IS NOT NULL").groupBy(*PAGE_KEY).agg(F.max_by("review_reason", F.struct("created_at", "gate_id")).alias("latest_reason"))
    return pages.join(last, list(PAGE_KEY), "left")


def null_safe_lineage(pages: DataFrame, lineage: DataFrame) -> DataFrame:
    """Pages with the lineage row of the same (job, page, sub index), where null equals null."""
    right = lineage.select("lineage_id", *(F.col(c).alias(f"l_{c}") for c in (*PAGE_KEY, "sub_page_index")))
    same = (F.col("job_id") == F.col("l_job_id")) & (F.col("page_number") == F.col("l_page_number")) & F.col("sub_page_index").eqNullSafe(F.col("l_sub_page_index"))
    return pages.join(right, same, "left").drop("l_job_id", "l_page_number", "l_sub_page_index")


def lineage_bundle(lineage: DataFrame, invocations: DataFrame, gates: DataFrame) -> DataFrame:
    """Each lineage row with its calls in time order and its page's gates; none gives an empty list.

    Children are aggregated before the join; a page's history is bounded by its passes.
    """
    calls = invocations.groupBy("lineage_id").agg(F.sort_array(F.collect_list(F.struct("invoked_at", "id", "service_name"))).alias("calls"))
    steps = gates.groupBy(*PAGE_KEY).agg(F.sort_array(F.collect_list(F.struct("created_at", "gate_id", "gate_type"))).alias("gates"))
    rows = lineage.join(calls, "lineage_id", "left").join(steps, list(PAGE_KEY), "left")
    return rows.withColumns({"calls": F.coalesce("calls", F.expr("cast(array() as array<struct<invoked_at:timestamp,id:bigint,service_name:string>>)")), "gates": F.coalesce("gates", F.expr("cast(array() as array<struct<created_at:timestamp,gate_id:string,gate_type:string>>)"))})


def owner_of_uri(uris: DataFrame, *legs: tuple[DataFrame, str, str]) -> DataFrame:
    """Job that owns each uri; ``legs`` are (table, uri column, job column) in order of priority."""
    every = None
    for rank, (table, uri, job) in enumerate(legs):
        leg = table.where(F.coalesce(F.col(uri), F.lit("")) != "").select(F.col(uri).alias("uri"), F.col(job).alias("job_id"), F.lit(rank).alias("rank"))
        every = leg if every is None else every.unionByName(leg)
    best = every.groupBy("uri").agg(F.min(F.struct("rank", "job_id")).alias("m"))
    return uris.join(best, "uri", "left").select("uri", F.col("m.job_id").alias("job_id"), F.col("m.rank").alias("priority"))


def queue_ids(tasks: DataFrame) -> DataFrame:
    """Distinct page ids in the live queues; poison rows and null ids are left out."""
    return tasks.where("NOT poison AND page_id IS NOT NULL AND queue IN ('pending','processing')").select("page_id").distinct()


def orphans(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pages that work should continue on and that no queue holds."""
    return pages.where(F.col("status").isin(*AUTOMATABLE)).select("page_id", "status").join(queue_ids(tasks), "page_id", "left_anti")


def _task_view(tasks: DataFrame, pages: DataFrame, heartbeats: DataFrame) -> DataFrame:
    beats = heartbeats.select("task_id", F.lit(True).alias("alive")).distinct()
    known = pages.select("page_id", "status", "status_updated_at", "created_at", F.lit(True).alias("known"))
    return tasks.join(known, "page_id", "left").join(beats, "task_id", "left").withColumns({"alive": F.coalesce("alive", F.lit(False)), "known": F.coalesce("known", F.lit(False))})


def reconcile(tasks: DataFrame, pages: DataFrame, heartbeats: DataFrame, now: str, max_retries: int = 3) -> DataFrame:
    """Action for every task in processing."""
    rows = _task_view(tasks.where("queue = 'processing'"), pages, heartbeats)
    again = F.when(F.col("retry_count") + 1 > max_retries, "dead_letter").otherwise("requeue")
    s = F.col("status")
    action = (
        F.when(F.col("poison"), "poison").when(~F.col("known"), "not_found").when(s.isin(*COMPLETE), "acked_terminal").when(F.col("alive"), "skipped_active")
        .when(s == "queued", again).when(s.isin(*ACTIVE) & is_stale(now, True), again).when(s.isin(*ACTIVE), "skipped_active").otherwise("acked_terminal")
    )
    return rows.select("queue_key", "task_id", "page_id", action.alias("action"))


def diagnose(tasks: DataFrame, pages: DataFrame, heartbeats: DataFrame, now: str) -> DataFrame:
    """Reason why each queue item is there."""
    rows = _task_view(tasks, pages, heartbeats)
    s = F.col("status")
    reason = (
        F.when(F.col("poison"), "unparseable_item").when(~F.col("known"), "item_without_matching_page").when(s.isin(*HUMAN_ONLY), "item_for_human_only_page").when(s.isin("split", *TERMINAL), "item_for_terminal_page")
        .when((F.col("queue") == "processing") & s.isin(*AUTOMATABLE) & is_stale(now, False) & ~F.col("alive"), "stale_item_without_worker").otherwise("item_with_automatable_page")
    )
    return rows.select("queue_key", "queue", reason.alias("reason"))


def dlq_repairs(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Active pages with a dead-lettered task: to be failed."""
    dead = tasks.where("queue = 'dead_letter' AND NOT poison").select("page_id")
    return pages.where(F.col("status").isin(*AUTOMATABLE)).join(dead, "page_id", "left_semi").select("page_id", F.col("status").alias("from_state"), F.lit("failed").alias("to_state"))


def blockers(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """What still keeps the system from being drained, from both sources, with the columns of each."""
    db = pages.where(F.col("status").isin(*AUTOMATABLE)).select(F.lit("table").alias("source"), "page_id", "status")
    items = tasks.where("queue <> 'dead_letter'").select(F.lit("queue").alias("source"), "page_id", "queue")
    return db.unionByName(items, allowMissingColumns=True)


def drained(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: active pages, live queue items, and whether both are 0; empty tables are drained."""
    active = pages.agg(F.count_if(F.col("status").isin(*AUTOMATABLE)).alias("active_pages"))
    items = tasks.agg(F.count_if(F.col("queue") != "dead_letter").alias("queue_items"))
    return active.crossJoin(F.broadcast(items)).withColumn("drained", (F.col("active_pages") == 0) & (F.col("queue_items") == 0))


def reconcile_training(triggers: DataFrame, jobs: DataFrame, now: str, timeout_minutes: int = 120) -> tuple[DataFrame, DataFrame]:
    """Triggers in processing that must fail, with why; running jobs past their time."""
    rows = triggers.where("status = 'processing'").join(jobs.select("train_job_id", F.col("status").alias("job_status")), "train_job_id", "left")
    why = F.when(F.col("train_job_id").isNull(), "no_job_id").when(F.col("job_status").isNull(), "job_missing").when(F.col("job_status") == "failed", "job_failed")
    stuck = jobs.where((F.col("status") == "running") & (F.col("started_at") < ts(now) - F.expr(f"INTERVAL {timeout_minutes} MINUTES"))).select("train_job_id")
    return rows.select("trigger_id", why.alias("why")).where("why IS NOT NULL"), stuck


def purge(table: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of a table that stay when ``jobs`` are deleted."""
    return table.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def purge_all(tables: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table when ``jobs`` go with all that hangs on them.

    Tables with a job_id are purged by it, those with a lineage_id or page_id alone by the
    lineage and pages of the jobs; rows whose key is null stay.
    """
    gone = jobs.select("job_id").distinct()
    by = {"job_id": gone}
    for table, key in (("lineage", "lineage_id"), ("pages", "page_id")):
        if table in tables:
            by[key] = tables[table].join(gone, "job_id", "left_semi").select(key).distinct()
    out = {}
    for name, rows in tables.items():
        key = next((k for k in by if k in rows.columns), None)
        out[name] = rows if key is None else rows.join(by[key], key, "left_anti")
    return out


def metric_uris(rows: DataFrame, metrics: str, field: str, owner: str) -> DataFrame:
    """uri, owner of the uris that JSON metrics name; broken documents and those without the field have none."""
    return rows.select(F.get_json_object(metrics, f"$.{field}").alias("uri"), owner).where("uri IS NOT NULL AND uri <> ''")


def new_versions(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: (service, tag) that is not there yet, once each."""
    return found.dropDuplicates(["service_name", "version_tag"]).join(existing.select("service_name", "version_tag"), ["service_name", "version_tag"], "left_anti")


def shadow_todo(pages: DataFrame, jobs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Final pages of shadow jobs: the newest evaluation to reuse, or none yet."""
    last = evaluations.groupBy("page_id").agg(F.max_by("eval_id", F.struct("created_at", "eval_id")).alias("eval_id"))
    shadow = jobs.where("shadow_mode").select("job_id")
    return pages.where(F.col("status").isin(*TERMINAL)).join(shadow, "job_id", "left_semi").select("page_id").join(last, "page_id", "left").withColumn("todo", F.col("eval_id").isNull())


#: Metrics that a drift observer watches, by the trigger that each one raises; fixed values.
_GEOMETRY = ("geometry_confidence", "split_detection_rate", "tta_structural_agreement_rate", "tta_prediction_variance")
_LAYOUT = ("mean_page_confidence", "region_count", "class_fraction.text_block", "class_fraction.title", "class_fraction.table", "class_fraction.image", "class_fraction.caption")
WATCHED = {
    "drift_alert_persistence": (
        *(f"geometry_a.{m}" for m in _GEOMETRY),
        *(f"geometry_b.{m}" for m in _GEOMETRY),
        *(f"normalize.{m}" for m in ("blur_score", "border_score", "foreground_coverage")),
        "rectify.rectification_confidence",
        *(f"geometry_selection_route.{m}_fraction" for m in ("accepted", "review", "structural_disagreement", "sanity_failed", "split_confidence_low", "tta_variance_high")),
        *(f"artifact_validation_route.{m}_fraction" for m in ("valid", "invalid", "rectification_triggered")),
    ),
    "layout_confidence_degradation": (*(f"layout_a.{m}" for m in _LAYOUT), *(f"layout_b.{m}" for m in _LAYOUT), "gate.layout_consensus_confidence"),
    "structural_agreement_degradation": ("gate.structural_agreement_rate",),
}
#: Hours that a metric has to stay off before its trigger is raised; fixed values.
PERSISTENCE_HOURS = {"drift_alert_persistence": 48.0, "layout_confidence_degradation": 48.0, "structural_agreement_degradation": 48.0, "escalation_rate_anomaly": 24.0, "auto_accept_rate_collapse": 24.0}


def route_metrics(observations: DataFrame) -> DataFrame:
    """Rows of each metric with the trigger type that it raises and how long it has to persist; metrics without one are ignored."""
    routes = F.create_map(*[F.lit(x) for kind, metrics in WATCHED.items() for m in metrics for x in (m, kind)])
    hours = F.create_map(*[F.lit(x) for kind, h in PERSISTENCE_HOURS.items() for x in (kind, h)])
    kind = F.when(F.col("metric").isNotNull(), F.element_at(routes, F.col("metric")))
    rows = observations.groupBy("metric").agg(F.count("*").alias("n")).withColumn("trigger_type", kind).where("trigger_type IS NOT NULL")
    return rows.select("metric", "trigger_type", F.element_at(hours, F.col("trigger_type")).alias("persistence_hours"), "n")


def cooldowns(triggers: DataFrame, kinds: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Latest trigger of every known kind and whether it still cools down; kinds without one stay."""
    last = triggers.groupBy("trigger_type").agg(F.max(F.struct("fired_at", "trigger_id")).alias("m"))
    rows = kinds.join(last, "trigger_type", "left").select("trigger_type", F.col("m.fired_at").alias("fired_at"), F.col("m.trigger_id").alias("trigger_id"))
    return rows.withColumn("in_cooldown", F.coalesce(F.col("fired_at") + F.expr(f"INTERVAL {days} DAYS") > ts(now), F.lit(False)))


def shadow_delta(gates: DataFrame) -> DataFrame:
    """Latest candidate minus latest production score, the same for all pages: two rows of one."""
    prod = gates.where("gate_type = 'geometry_selection'").agg(F.max_by("geometry_iou", F.struct("created_at", "gate_id")).alias("production"))
    cand = gates.where("gate_type = 'artifact_validation'").agg(F.max_by("geometry_iou", F.struct("created_at", "gate_id")).alias("candidate"))
    return prod.crossJoin(F.broadcast(cand)).withColumn("delta", F.round(F.col("candidate") - F.col("production"), 6))
