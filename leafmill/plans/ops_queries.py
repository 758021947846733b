"""Queries of service health, reconciliation and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import health as h
from leafmill.operators import reconcile as r
from leafmill.plans.registry import Tables, query
from leafmill.plans.views import NOW_EVENTS, NOW_PAGES

_E, _P = f"TIMESTAMP '{NOW_EVENTS}'", f"TIMESTAMP '{NOW_PAGES}'"
_HOURS = 24 * 365
_STAGE = "CASE WHEN service_name IN ('geometry_a','geometry_b') THEN 'preprocessing' WHEN service_name = 'rectify' THEN 'rectification' WHEN service_name IN ('layout_a','layout_b') THEN 'layout' ELSE 'classification' END"
_AUTO = "('queued','preprocessing','rectification','layout_detection','semantic_norm')"
_WINDOW = f"status IN ('accepted','review','failed') AND status_updated_at BETWEEN {_P} - INTERVAL {_HOURS} HOUR AND {_P}"
_RATES = f"SELECT count(*) AS n, round(count(*) / {_HOURS}, 4) AS wall_rate, CASE WHEN count(*) = count(processing_time_ms) AND sum(processing_time_ms) > 0 THEN round(count(*) / (sum(processing_time_ms) / 3.6e6), 4) END AS active_rate FROM v_pages WHERE {_WINDOW}"
_ACCEPT = "SELECT round(count(*) FILTER (WHERE status = 'accepted') / count(*) FILTER (WHERE status IN ('accepted','review','failed')), 4) AS acceptance, round(count(*) FILTER (WHERE qa_approved) / count(qa_approved), 4) AS agreement FROM v_pages"


@query(f"""SELECT s.stage, coalesce(f.total, 0) AS total, coalesce(f.succeeded, 0) AS succeeded, CASE WHEN coalesce(f.total, 0) = 0 THEN 0.0 ELSE round(f.succeeded / f.total, 4) END AS success_rate
FROM (VALUES ('preprocessing'), ('rectification'), ('layout'), ('classification')) s(stage) LEFT JOIN (SELECT {_STAGE} AS stage, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded FROM v_invocations WHERE invoked_at >= {_E} - INTERVAL 240 HOUR GROUP BY 1) f USING (stage)""")
def a4_stage_health(t: Tables):
    return h.stage_health(t.v_invocations, NOW_EVENTS, 240)


@query(_RATES)
def a1_page_rates(t: Tables):
    return h.page_rates(t.v_pages, NOW_PAGES, _HOURS)


@query(_ACCEPT)
def a2_acceptance_rates(t: Tables):
    return h.acceptance_rates(t.v_pages)


@query(f"""SELECT * EXCLUDE (n) FROM (SELECT count(*) AS n_pages, count(*) FILTER (WHERE status = 'accepted') AS n_accepted, count(*) FILTER (WHERE status = 'review') AS n_review, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'pending_human_correction') AS n_pending FROM v_pages),
(SELECT count(*) AS n_active_jobs FROM v_jobs WHERE status IN ('running','queued')), ({_ACCEPT}), ({_RATES})""")
def a3_dashboard(t: Tables):
    return h.dashboard(t.v_pages, t.v_jobs, NOW_PAGES, _HOURS)


@query(f"""SELECT n_corrections, round(n_corrections / {_HOURS}, 4) AS corrections_per_hour, rescue_rate FROM
(SELECT count(*) AS n_corrections FROM v_lineage WHERE human_corrected AND human_correction_timestamp >= {_P} - INTERVAL {_HOURS} HOUR),
(SELECT round(count(*) FILTER (WHERE status <> 'skipped') / count(*), 4) AS rescue_rate FROM v_invocations WHERE service_name = 'rectify')""")
def a5_review_rates(t: Tables):
    return h.review_rates(t.v_lineage, t.v_invocations, NOW_PAGES, _HOURS)


@query("""SELECT service_name, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status IN ('error','timeout')) AS errors, max(invoked_at) AS last_seen,
round(quantile_cont(processing_time_ms, 0.95), 4) AS p95_ms, round(count(*) FILTER (WHERE status = 'success') / count(*), 4) AS success_rate FROM v_invocations GROUP BY 1""")
def a6_service_inventory(t: Tables):
    return h.service_inventory(t.v_invocations)


_CATALOGUE = [("geometry", "GEOMETRY%"), ("layout", "layout_%"), ("rescue", "rect%"), ("ghost", "nothing%")]


@query(f"SELECT service, coalesce(sum(n), 0)::BIGINT AS n FROM (VALUES {', '.join(map(str, _CATALOGUE))}) c(service, pattern) LEFT JOIN (SELECT service_name, count(*) AS n FROM v_invocations GROUP BY 1) i ON i.service_name ILIKE c.pattern GROUP BY 1")
def j19_catalogue_inventory(t: Tables):
    return h.catalogue_inventory(t.spark.createDataFrame(_CATALOGUE, "service string, pattern string"), t.v_invocations)


@query(f"""SELECT 'count' AS part, status AS name, count(*) AS n, NULL::TIMESTAMP AS completed FROM v_train_jobs GROUP BY status UNION ALL
SELECT * FROM (SELECT 'recent', train_job_id, NULL::BIGINT, completed_at FROM v_train_jobs WHERE status = 'completed' AND completed_at >= TIMESTAMP '2024-01-02' - INTERVAL 72 HOUR ORDER BY completed_at DESC, train_job_id LIMIT 10)""")
def a13_training_status(t: Tables):
    counts, recent = h.training_status(t.v_train_jobs, "2024-01-02 00:00:00")
    n, at = F.lit(None).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("completed")
    return counts.select(F.lit("count").alias("part"), F.col("status").alias("name"), "n", at).unionByName(recent.select(F.lit("recent").alias("part"), F.col("train_job_id").alias("name"), n, F.col("completed_at").alias("completed")))


_DRIFT = "SELECT o.metric, o.seq, avg(value) OVER w AS m, count(*) OVER w AS window_n FROM v_observations o WINDOW w AS (PARTITION BY metric ORDER BY ts, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"


@query(f"SELECT d.metric, seq, round(m, 9) AS window_mean, window_n, coalesce(b.std > 0 AND abs(m - b.mean) > 3.0 * b.std, false) AS drifted FROM ({_DRIFT}) d LEFT JOIN v_baselines b ON b.metric = d.metric")
def w1_rolling_drift(t: Tables):
    return h.rolling_drift(t.v_observations, t.v_baselines)


@query("SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std FROM v_observations GROUP BY 1 HAVING count(*) >= 200")
def a33_baselines(t: Tables):
    return h.baselines(t.v_observations)


@query("""SELECT metric, round(CASE WHEN o.n >= 200 THEN o.mean ELSE b.mean END, 6) AS mean, round(CASE WHEN o.n >= 200 THEN o.std ELSE b.std END, 6) AS std, CASE WHEN o.n >= 200 THEN 'empirical' ELSE 'analytic' END AS source
FROM v_baselines b FULL JOIN (SELECT metric, count(*) AS n, avg(value) AS mean, stddev(value) AS std FROM v_observations WHERE metric LIKE '%.latency' OR seq % 20 = 0 GROUP BY 1) o USING (metric) WHERE b.metric IS NOT NULL OR o.n >= 200""")
def a33_merged_baselines(t: Tables):
    rows = h.merged_baselines(t.v_baselines, h.baselines(t.v_observations.where("metric LIKE '%.latency' OR seq % 20 = 0")))
    return rows.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""SELECT service_name, count(*) AS length, min(invoked_at) AS first_at, max(invoked_at) AS last_at FROM (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY service_name ORDER BY invoked_at, id) AS island FROM v_invocations)
WHERE status <> 'success' GROUP BY service_name, island HAVING count(*) >= 3""")
def w18_failure_streaks(t: Tables):
    return h.failure_streaks(t.v_invocations, 3)


_TICKS = "SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) > 48 AS firing FROM {e} GROUP BY 1, 2"


@query(f"""SELECT series, min(ts) AS since, max(ts) AS until, count(*) AS ticks FROM (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS island FROM ({_TICKS.format(e="events")}))
WHERE firing GROUP BY series, island HAVING epoch(max(ts)) - epoch(min(ts)) >= 7200""")
def w17_persisting(t: Tables):
    return h.persisting(t.spark.sql(_TICKS, e=t.events), 7200)


@query("""WITH RECURSIVE e AS (SELECT trigger_type AS kind, fired_at, min(trigger_id) AS event_id FROM v_triggers GROUP BY 1, 2),
k AS (SELECT kind, min(fired_at) AS fired_at FROM e GROUP BY 1 UNION ALL SELECT k.kind, (SELECT min(fired_at) FROM e WHERE e.kind = k.kind AND e.fired_at >= k.fired_at + INTERVAL 7 DAY) FROM k WHERE k.fired_at IS NOT NULL)
SELECT e.* FROM k JOIN e USING (kind, fired_at)""")
def w16_cooldown(t: Tables):
    return h.cooldown(t.v_triggers.select(F.col("trigger_type").alias("kind"), "fired_at", F.col("trigger_id").alias("event_id")))


_KINDS = ["drift_alert_persistence", "escalation_rate_anomaly", "auto_accept_rate_collapse", "structural_agreement_degradation", "layout_confidence_degradation"]


@query(f"""SELECT k.trigger_type, m.fired_at, m.trigger_id, coalesce(m.fired_at + INTERVAL 7 DAY > {_E}, false) AS in_cooldown FROM (VALUES {', '.join(f"('{k}')" for k in _KINDS)}) k(trigger_type)
LEFT JOIN (SELECT trigger_type, fired_at, trigger_id FROM (SELECT *, row_number() OVER (PARTITION BY trigger_type ORDER BY fired_at DESC, trigger_id DESC) AS r FROM v_triggers) WHERE r = 1) m USING (trigger_type)""")
def w4_cooldowns(t: Tables):
    return r.cooldowns(t.v_triggers, t.spark.createDataFrame([(k,) for k in _KINDS], "trigger_type string"), NOW_EVENTS)


_PARSED = "SELECT *, CASE WHEN json_valid(raw) THEN raw->>'task_id' END AS task_id, CASE WHEN json_valid(raw) THEN raw->>'page_id' END AS page_id, CASE WHEN json_valid(raw) THEN CAST(raw->>'retry_count' AS INT) END AS retry_count, NOT json_valid(raw) AS poison FROM v_tasks"


@query(f"SELECT queue_key, task_id, page_id, retry_count, poison FROM ({_PARSED})")
def s7_parse_tasks(t: Tables):
    return r.parse_tasks(t.v_tasks).select("queue_key", "task_id", "page_id", "retry_count", "poison")


@query("""SELECT page_id, latest_reason FROM v_pages LEFT JOIN (SELECT job_id, page_number, review_reason AS latest_reason FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number ORDER BY created_at DESC, gate_id DESC) AS r
FROM v_gates WHERE review_reason IS NOT NULL) WHERE r = 1) USING (job_id, page_number)""")
def j6_latest_reason(t: Tables):
    return r.with_latest_reason(t.v_pages, t.v_gates).select("page_id", "latest_reason")


@query("SELECT p.page_id, l.lineage_id FROM v_pages p LEFT JOIN v_lineage l ON p.job_id = l.job_id AND p.page_number = l.page_number AND p.sub_page_index IS NOT DISTINCT FROM l.sub_page_index")
def j7_null_safe_lineage(t: Tables):
    return r.null_safe_lineage(t.v_pages, t.v_lineage).select("page_id", "lineage_id")


@query("""SELECT lineage_id, coalesce(c.calls, '') AS calls, coalesce(g.gates, '') AS gates FROM v_lineage l
LEFT JOIN (SELECT lineage_id, string_agg(service_name, ',' ORDER BY invoked_at, id, service_name) AS calls FROM v_invocations GROUP BY 1) c USING (lineage_id)
LEFT JOIN (SELECT job_id, page_number, string_agg(gate_type, ',' ORDER BY created_at, gate_id, gate_type) AS gates FROM v_gates GROUP BY 1, 2) g USING (job_id, page_number)""")
def j8_lineage_bundle(t: Tables):
    rows = r.lineage_bundle(t.v_lineage, t.v_invocations, t.v_gates)
    return rows.select("lineage_id", F.array_join("calls.service_name", ",").alias("calls"), F.array_join("gates.gate_type", ",").alias("gates"))


_URIS = "SELECT output_uri AS uri FROM {l} WHERE output_uri IS NOT NULL UNION SELECT input_uri FROM {p} WHERE input_uri IS NOT NULL UNION SELECT artifact_uri FROM {i} WHERE artifact_uri IS NOT NULL UNION SELECT concat('s3://met/', CAST(id % 97 AS STRING), '.json') FROM {i} WHERE id % 5 = 0"


_METRIC_JSON = """SELECT lineage_id, CASE WHEN id % 3 = 0 THEN concat('{{"p95":1,"artifact_uri":"s3://met/', CAST(id % 97 AS STRING), '.json"}}') WHEN id % 3 = 1 THEN '{{broken' ELSE '{{"p95":2}}' END AS metrics FROM {i}"""


@query(f"""WITH u AS ({_URIS.format(l="v_lineage", p="v_pages", i="v_invocations")}), legs AS (SELECT output_uri AS uri, job_id, 0 AS rank FROM v_lineage WHERE coalesce(output_uri, '') <> '' UNION ALL SELECT otiff_uri, job_id, 1 FROM v_lineage
UNION ALL SELECT output_uri, job_id, 2 FROM v_pages WHERE coalesce(output_uri, '') <> '' UNION ALL SELECT input_uri, job_id, 3 FROM v_pages WHERE coalesce(input_uri, '') <> '' UNION ALL SELECT artifact_uri, lineage_id, 4 FROM v_invocations WHERE coalesce(artifact_uri, '') <> ''
UNION ALL SELECT 's3://met/' || id % 97 || '.json', lineage_id, 5 FROM v_invocations WHERE id % 3 = 0)
SELECT uri, job_id, rank AS priority FROM u LEFT JOIN (SELECT uri, job_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY rank, job_id) AS r FROM legs) WHERE r = 1) USING (uri)""")
def j10_owner_of_uri(t: Tables):
    uris = t.spark.sql(_URIS, l=t.v_lineage, p=t.v_pages, i=t.v_invocations)
    return r.owner_of_uri(uris, (t.v_lineage, "output_uri", "job_id"), (t.v_lineage, "otiff_uri", "job_id"), (t.v_pages, "output_uri", "job_id"), (t.v_pages, "input_uri", "job_id"), (t.v_invocations, "artifact_uri", "lineage_id"), (r.metric_uris(t.spark.sql(_METRIC_JSON, i=t.v_invocations), "metrics", "artifact_uri", "lineage_id"), "uri", "lineage_id"))


_IDS = f"SELECT DISTINCT page_id FROM ({_PARSED}) WHERE NOT poison AND queue IN ('pending','processing')"


@query(_IDS)
def u1_queue_ids(t: Tables):
    return r.queue_ids(r.parse_tasks(t.v_tasks))


@query(f"SELECT page_id, status FROM v_pages WHERE status IN {_AUTO} AND page_id NOT IN ({_IDS})")
def j11_orphans(t: Tables):
    return r.orphans(t.v_pages, r.parse_tasks(t.v_tasks))


@query(f"SELECT page_id FROM v_pages WHERE status IN {_AUTO} EXCEPT SELECT page_id FROM ({_IDS})")
def u2_missing_ids(t: Tables):
    return t.v_pages.where(F.col("status").isin(*r.AUTOMATABLE)).select("page_id").subtract(r.queue_ids(r.parse_tasks(t.v_tasks)))


_AGE = f"epoch({_P}) - epoch(coalesce(p.status_updated_at, p.created_at)) >= CASE WHEN p.status = 'layout_detection' THEN 180 ELSE 900 END"
_TASKS = f"SELECT k.*, p.status, p.page_id IS NOT NULL AS known, hb.task_id IS NOT NULL AS alive, {_AGE} AS stale FROM ({_PARSED}) k LEFT JOIN v_pages p ON p.page_id = k.page_id LEFT JOIN (SELECT DISTINCT task_id FROM v_heartbeats) hb ON hb.task_id = k.task_id"


@query(f"""SELECT queue_key, task_id, page_id, CASE WHEN poison THEN 'poison' WHEN NOT known THEN 'not_found' WHEN status IN ('accepted','review','failed','split','pending_human_correction','ptiff_qa_pending') THEN 'acked_terminal'
WHEN alive THEN 'skipped_active' WHEN status = 'queued' OR coalesce(stale, true) THEN CASE WHEN retry_count + 1 > 3 THEN 'dead_letter' ELSE 'requeue' END ELSE 'skipped_active' END AS action FROM ({_TASKS}) WHERE queue = 'processing'""")
def j12_reconcile(t: Tables):
    return r.reconcile(r.parse_tasks(t.v_tasks), t.v_pages, t.v_heartbeats, NOW_PAGES)


@query(f"""SELECT queue_key, queue, CASE WHEN poison THEN 'unparseable_item' WHEN NOT known THEN 'item_without_matching_page' WHEN status IN ('pending_human_correction','ptiff_qa_pending') THEN 'item_for_human_only_page'
WHEN status IN ('split','accepted','review','failed') THEN 'item_for_terminal_page' WHEN queue = 'processing' AND coalesce(stale, false) AND NOT alive THEN 'stale_item_without_worker' ELSE 'item_with_automatable_page' END AS reason FROM ({_TASKS})""")
def j13_diagnose(t: Tables):
    return r.diagnose(r.parse_tasks(t.v_tasks), t.v_pages, t.v_heartbeats, NOW_PAGES)


@query(f"SELECT page_id, status AS from_state, 'failed' AS to_state FROM v_pages WHERE status IN {_AUTO} AND page_id IN (SELECT page_id FROM ({_PARSED}) WHERE queue = 'dead_letter' AND NOT poison)")
def j14_dlq_repairs(t: Tables):
    return r.dlq_repairs(t.v_pages, r.parse_tasks(t.v_tasks))


@query(f"""SELECT 'trigger' AS kind, trigger_id::VARCHAR AS id, why FROM (SELECT trigger_id, CASE WHEN t.train_job_id IS NULL THEN 'no_job_id' WHEN j.status IS NULL THEN 'job_missing' WHEN j.status = 'failed' THEN 'job_failed' END AS why
FROM v_triggers t LEFT JOIN v_train_jobs j ON j.train_job_id = t.train_job_id WHERE t.status = 'processing') WHERE why IS NOT NULL
UNION ALL SELECT 'job', train_job_id, 'timeout' FROM v_train_jobs WHERE status = 'running' AND started_at < {_E} - INTERVAL 120 MINUTE""")
def j15_reconcile_training(t: Tables):
    triggers, stuck = r.reconcile_training(t.v_triggers, t.v_train_jobs, NOW_EVENTS)
    return triggers.select(F.lit("trigger").alias("kind"), F.col("trigger_id").cast("string").alias("id"), "why").unionByName(stuck.select(F.lit("job").alias("kind"), F.col("train_job_id").alias("id"), F.lit("timeout").alias("why")))


@query("""SELECT candidate, production, round(candidate - production, 6) AS delta FROM (SELECT geometry_iou AS production FROM v_gates WHERE gate_type = 'geometry_selection' ORDER BY created_at DESC, gate_id DESC LIMIT 1),
(SELECT geometry_iou AS candidate FROM v_gates WHERE gate_type = 'artifact_validation' ORDER BY created_at DESC, gate_id DESC LIMIT 1)""")
def j20_shadow_delta(t: Tables):
    return r.shadow_delta(t.v_gates)


_ROUTED = {m: kind for kind, metrics in r.WATCHED.items() for m in metrics}
_SEEN = [*_ROUTED, "gate.unwatched", "layout_a.latency"]


@query(f"""SELECT metric, trigger_type, CASE WHEN trigger_type IN ('escalation_rate_anomaly', 'auto_accept_rate_collapse') THEN 24.0 ELSE 48.0 END::DOUBLE AS persistence_hours, count(*) AS n
FROM (SELECT [{', '.join(f"'{m}'" for m in _SEEN)}][event_id % {len(_SEEN)} + 1] AS metric FROM events) JOIN (VALUES {', '.join(map(str, _ROUTED.items()))}) m(metric, trigger_type) USING (metric) GROUP BY 1, 2""")
def j21_route_metrics(t: Tables):
    metric = F.get(F.array(*map(F.lit, _SEEN)), (F.col("event_id") % len(_SEEN)).cast("int"))
    return r.route_metrics(t.events.select(metric.alias("metric")))


_EVALS = "SELECT page_id, concat('e-', page_id, '-', CAST(retry_count AS STRING)) AS eval_id, created_at FROM {p} WHERE retry_count > 1 AND created_at IS NOT NULL"
_KEPT = {
    "jobs": "v_jobs WHERE job_id NOT IN (SELECT job_id FROM gone)", "pages": "v_pages WHERE job_id NOT IN (SELECT job_id FROM gone)", "gates": "v_gates WHERE job_id NOT IN (SELECT job_id FROM gone)", "lineage": "v_lineage WHERE job_id NOT IN (SELECT job_id FROM gone)",
    "invocations": "v_invocations WHERE lineage_id NOT IN (SELECT lineage_id FROM v_lineage WHERE job_id IN (SELECT job_id FROM gone))", "tasks": "v_tasks WHERE queue_key NOT IN (SELECT 't-' || page_id FROM v_pages WHERE job_id IN (SELECT job_id FROM gone))",
    "evaluations": f"({_EVALS.format(p='v_pages')}) WHERE page_id NOT IN (SELECT page_id FROM v_pages WHERE job_id IN (SELECT job_id FROM gone))",
}


@query(f"WITH gone AS (SELECT job_id FROM v_jobs WHERE shadow_mode) {' UNION ALL '.join(f"SELECT '{k}' AS name, count(*) AS n FROM {v}" for k, v in _KEPT.items())}")
def j23_purge(t: Tables):
    gone = t.v_jobs.where("shadow_mode")
    tables = {"jobs": t.v_jobs, "pages": t.v_pages, "gates": t.v_gates, "lineage": t.v_lineage, "invocations": t.v_invocations, "tasks": t.v_tasks.withColumn("page_id", F.expr("substring(queue_key, 3)")), "evaluations": t.spark.sql(_EVALS, p=t.v_pages)}
    out = None
    for name, rows in r.purge_all(tables, gone).items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_TAGGED = "SELECT service_name, 'v' || floor(price * 100)::BIGINT AS version_tag FROM v_models WHERE stage"


@query(f"{_TAGGED} = 'staging' EXCEPT {_TAGGED} = 'archived'")
def j25_new_versions(t: Tables):
    tag = F.concat(F.lit("v"), F.floor(F.col("price") * 100).cast("long").cast("string")).alias("version_tag")
    found, there = (t.v_models.where(f"stage = '{s}'").select("service_name", tag) for s in ("staging", "archived"))
    return r.new_versions(found, there)


@query(f"""SELECT p.page_id, e.eval_id, e.eval_id IS NULL AS todo FROM v_pages p JOIN v_jobs j USING (job_id) LEFT JOIN ({_EVALS.format(p="v_pages")}) e ON e.page_id = p.page_id WHERE j.shadow_mode AND p.status IN ('accepted','review','failed')""")
def j26_shadow_todo(t: Tables):
    return r.shadow_todo(t.v_pages, t.v_jobs, t.spark.sql(_EVALS, p=t.v_pages))


@query(f"SELECT a.active_pages, q.queue_items, a.active_pages = 0 AND q.queue_items = 0 AS drained FROM (SELECT count(*) AS active_pages FROM v_pages WHERE status IN {_AUTO}) a, (SELECT count(*) AS queue_items FROM v_tasks WHERE queue <> 'dead_letter') q")
def a35_drained(t: Tables):
    return r.drained(t.v_pages, r.parse_tasks(t.v_tasks))


@query(f"SELECT 'table' AS source, page_id, status, NULL AS queue FROM v_pages WHERE status IN {_AUTO} UNION ALL SELECT 'queue', page_id, NULL, queue FROM ({_PARSED}) WHERE queue <> 'dead_letter'")
def u4_blockers(t: Tables):
    return r.blockers(t.v_pages, r.parse_tasks(t.v_tasks))


@query("SELECT job_id, page_number, route_decision FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number ORDER BY created_at DESC, gate_id DESC) AS r FROM v_gates WHERE gate_type IN ('geometry_selection','geometry_selection_post_rectification')) WHERE r = 1")
def w2_latest_gate(t: Tables):
    rows = t.v_gates.where(F.col("gate_type").isin("geometry_selection", "geometry_selection_post_rectification"))
    return r.latest(rows, ["job_id", "page_number"], "route_decision", "created_at", "gate_id")


@query("SELECT lineage_id, artifact_uri FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY invoked_at DESC, id DESC) AS r FROM v_invocations WHERE status = 'success' AND service_name = 'rectify') WHERE r = 1")
def w15_latest_artifact(t: Tables):
    return r.latest(t.v_invocations.where("status = 'success' AND service_name = 'rectify'"), ["lineage_id"], "artifact_uri", "invoked_at", "id")
