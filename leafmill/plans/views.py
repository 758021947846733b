"""Views of page-pipeline tables over the driver's tables, as SQL that Spark and DuckDB both run.

``{name}`` is a base table or another view; ``{e1}`` is the first element of the embedding.
"""

from __future__ import annotations

import re

#: Fixed moments that stand for now.
NOW_PAGES = "2001-06-01 00:00:00"
NOW_EVENTS = "2024-01-25 00:00:00"

#: Parts of ``v_page_base`` and ``v_pages`` that the twins share with the way Spark goes (``SPARK_PAGES``).
PAGE_NUMBER = "CASE WHEN l_orderkey % 3 = 0 THEN CAST(floor((l_linenumber + 1) / 2) AS INT) ELSE CAST(l_linenumber AS INT) END"
_SUB_PAGE = "CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber % 2 AS INT) END"
_PAGE_ID = "concat('job-', CAST(k AS STRING), '/', CAST(page_number AS STRING), '/', coalesce(CAST(sub_page_index AS STRING), '-')) AS page_id"
_FROM_LINES = """CASE WHEN q < 20 THEN 'accepted' WHEN q < 25 THEN 'review' WHEN q < 28 THEN 'failed' WHEN q < 34 THEN 'pending_human_correction' WHEN q < 38 THEN 'layout_detection'
    WHEN q < 42 THEN 'ptiff_qa_pending' WHEN q < 44 THEN 'preprocessing' WHEN q < 46 THEN 'semantic_norm' WHEN q < 47 THEN 'rectification' ELSE 'queued' END AS status,
  CASE WHEN p % 50 = 0 THEN NULL ELSE price END AS processing_time_ms, CASE WHEN p % 40 = 0 THEN NULL ELSE ship END AS status_updated_at,
  CASE WHEN p % 80 = 0 THEN NULL ELSE ship - INTERVAL 1 DAY END AS created_at, CAST(s % 5 AS INT) AS retry_count,
  CASE WHEN p % 9 = 0 THEN NULL WHEN p % 9 = 1 THEN '' ELSE concat('s3://out/', CAST(k AS STRING), '/', CAST(p AS STRING), '.tiff') END AS output_uri,
  CASE WHEN p % 11 = 0 THEN NULL ELSE concat('s3://in/', CAST(k AS STRING), '/', CAST(page_number AS STRING), '.tiff') END AS input_uri,
  CASE WHEN p % 3 = 0 THEN 1 - sub_page_index + 1 END AS reading_order, p % 2 = 0 AS qa_approved, p % 17 = 0 AS human_corrected,
  CASE WHEN p % 6 = 0 THEN '["low_confidence","split_confidence_low"]' WHEN p % 6 = 1 THEN '["tta_variance_high"]' WHEN p % 6 = 2 THEN NULL ELSE '[]' END AS review_reasons"""

VIEWS = {
    "v_jobs": """
SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_id, concat('col-', CAST(o_custkey % 50 AS STRING)) AS collection_id,
  CASE o_custkey % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'newspaper' WHEN 2 THEN 'microfilm' ELSE 'archival_document' END AS material_type,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'queued' END AS status, o_orderkey % 7 = 0 AS shadow_mode,
  CASE WHEN o_orderkey % 5 = 0 THEN 'preprocess' ELSE 'layout' END AS pipeline_mode, concat('u-', CAST(o_custkey AS STRING)) AS created_by, o_orderdate AS created_at
FROM {orders}""",
    "v_users": "SELECT concat('u-', CAST(c_custkey AS STRING)) AS user_id, c_name AS username, c_mktsegment AS role FROM {customer}",
    "v_page_base": f"""
SELECT l_orderkey AS k, {PAGE_NUMBER} AS page_number,
  {_SUB_PAGE} AS sub_page_index, max(l_quantity) AS q, max(l_partkey) AS p, max(l_suppkey) AS s,
  max(l_extendedprice) AS price, max(l_shipdate) AS ship
FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "v_pages": f"""
SELECT {_PAGE_ID},
  concat('job-', CAST(k AS STRING)) AS job_id, page_number, sub_page_index,
  {_FROM_LINES}
FROM {{v_page_base}}
UNION ALL
SELECT DISTINCT concat('job-', CAST(k AS STRING), '/', CAST(page_number AS STRING), '/-'), concat('job-', CAST(k AS STRING)), page_number, CAST(NULL AS INT),
  CASE WHEN k % 2 = 0 THEN 'split' ELSE 'pending_human_correction' END, CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 0,
  CAST(NULL AS STRING), concat('s3://in/', CAST(k AS STRING), '/', CAST(page_number AS STRING), '.tiff'), CAST(NULL AS INT), false, false, CAST(NULL AS STRING)
FROM {{v_page_base}} WHERE k % 3 = 0""",
    "v_invocations": """
SELECT event_id AS id, concat('ln-', CAST(user_id AS STRING)) AS lineage_id,
  CASE event_type WHEN 'click' THEN 'geometry_a' WHEN 'view' THEN 'geometry_b' WHEN 'purchase' THEN 'rectify' WHEN 'signup' THEN 'layout_a' ELSE 'classify' END AS service_name,
  CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 17 = 0 THEN 'timeout' WHEN event_id % 29 = 0 THEN 'skipped' ELSE 'success' END AS status, ts AS invoked_at,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE value * 100 END AS processing_time_ms,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('s3://art/', CAST(event_id % 997 AS STRING), '.json') END AS artifact_uri
FROM {events}""",
    "v_lineage": """
SELECT concat('ln-', CAST(o_orderkey AS STRING)) AS lineage_id, concat('job-', CAST(o_orderkey AS STRING)) AS job_id, CAST(1 + o_custkey % 3 AS INT) AS page_number,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 2 AS INT) END AS sub_page_index,
  CASE o_custkey % 5 WHEN 0 THEN 'book' WHEN 1 THEN ' Newspaper' WHEN 2 THEN 'microfilm' WHEN 3 THEN 'archival_document' ELSE NULL END AS material_type,
  o_custkey % 2 = 0 AS geometry_a_used, o_custkey % 3 = 0 AS geometry_b_used, o_orderkey % 4 < 2 AS human_corrected,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS human_correction_timestamp,
  CASE WHEN o_orderkey % 9 < 7 THEN 'accepted' ELSE 'rejected' END AS acceptance_decision, o_orderdate AS created_at,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(600 + o_custkey % 400 AS INT) END AS corr_w, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE CAST(800 + o_custkey % 300 AS INT) END AS corr_h,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(700 + o_orderkey % 300 AS INT) END AS down_w, CAST(900 + o_orderkey % 200 AS INT) AS down_h,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('s3://out/', CAST(o_orderkey AS STRING), '.tiff') END AS output_uri,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('s3://fixed/', CAST(o_orderkey AS STRING), '.tiff') END AS corrected_uri,
  concat('s3://in/', CAST(o_orderkey AS STRING), '/', CAST(1 + o_custkey % 3 AS STRING), '.tiff') AS otiff_uri, o_totalprice AS price
FROM {orders}""",
    "v_gates": """
SELECT concat('g-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS gate_id,
  concat('job-', CAST(l_orderkey AS STRING)) AS job_id, CASE WHEN l_orderkey % 3 = 0 THEN CAST(floor((l_linenumber + 1) / 2) AS INT) ELSE CAST(l_linenumber AS INT) END AS page_number,
  CASE l_returnflag WHEN 'A' THEN 'geometry_selection' WHEN 'N' THEN 'geometry_selection_post_rectification' ELSE 'artifact_validation' END AS gate_type,
  CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'pending_human_correction' END AS route_decision,
  CASE WHEN l_partkey % 4 = 0 THEN 'split_confidence_low' WHEN l_partkey % 4 = 1 THEN 'tta_variance_high' WHEN l_partkey % 4 = 2 THEN NULL ELSE 'geometry_sanity_failed' END AS review_reason,
  l_shipdate AS created_at, l_discount AS geometry_iou
FROM {lineitem}""",
    "v_tasks": """
SELECT concat('t-', page_id) AS queue_key, CASE WHEN retry_count = 0 THEN 'pending' WHEN retry_count < 4 THEN 'processing' ELSE 'dead_letter' END AS queue,
  CASE WHEN page_number = 5 AND retry_count = 2 THEN concat('{{broken ', page_id)
    ELSE concat('{{"task_id":"t-', page_id, '","page_id":"', CASE WHEN page_number = 6 THEN 'gone/' ELSE '' END, page_id, '","job_id":"', job_id, '","retry_count":', CAST(retry_count AS STRING), '}}') END AS raw
FROM {v_pages} WHERE status <> 'split' AND page_number % 2 = 1""",
    "v_heartbeats": "SELECT concat('t-', page_id) AS task_id FROM {v_pages} WHERE page_number % 3 = 0 AND retry_count % 2 = 0",
    "v_models": """
SELECT concat('m-', CAST(p_partkey AS STRING)) AS model_id, CASE p_partkey % 3 WHEN 0 THEN 'geometry_a' WHEN 1 THEN 'geometry_b' ELSE 'classify' END AS service_name,
  concat('v', CAST(p_partkey AS STRING)) AS version_tag, CASE p_size % 4 WHEN 0 THEN 'staging' WHEN 1 THEN 'production' WHEN 2 THEN 'archived' ELSE 'shadow' END AS stage,
  TIMESTAMP '2024-01-01 00:00:00' + p_size * INTERVAL 1 HOUR + p_partkey * INTERVAL 1 SECOND AS created_at,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-10 00:00:00' + p_partkey * INTERVAL 1 MINUTE END AS promoted_at, p_retailprice AS price
FROM {part}""",
    "v_model_gates": """
SELECT concat('m-', CAST(p_partkey AS STRING)) AS model_id, g.gate, CASE p_partkey % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'newspaper' ELSE 'microfilm' END AS material_type,
  CASE WHEN (p_partkey + g.i) % 7 = 0 THEN NULL ELSE (p_partkey + g.i) % 5 <> 0 END AS pass, p_retailprice / 2000 AS value, CAST(p_size % 3 AS INT) AS regressions
FROM {part} CROSS JOIN (SELECT 'geometry_iou' AS gate, 0 AS i UNION ALL SELECT 'split_precision', 1 UNION ALL SELECT 'structural_agreement', 2 UNION ALL SELECT 'golden_dataset', 3 UNION ALL SELECT 'latency_p95', 4) g
WHERE p_partkey % 11 <> 0""",
    "v_triggers": """
SELECT event_id AS trigger_id, CASE user_id % 5 WHEN 0 THEN 'drift_alert_persistence' WHEN 1 THEN 'escalation_rate_anomaly' WHEN 2 THEN 'auto_accept_rate_collapse'
  WHEN 3 THEN 'structural_agreement_degradation' ELSE 'unlisted_trigger' END AS trigger_type, ts AS fired_at,
  CASE WHEN event_id % 20 = 7 THEN 'resolved' WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'processing' ELSE 'completed' END AS status,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('rj-', CAST(event_id + event_id % 4 AS STRING)) END AS train_job_id
FROM {events} WHERE event_type = 'error'""",
    "v_train_jobs": """
SELECT concat('rj-', CAST(event_id AS STRING)) AS train_job_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, ts AS started_at,
  CASE WHEN event_id % 4 >= 2 THEN ts + INTERVAL 90 MINUTE END AS completed_at
FROM {events} WHERE event_type <> 'view'""",
    "v_observations": """
SELECT concat(CASE event_type WHEN 'click' THEN 'geometry_a' WHEN 'view' THEN 'geometry_b' WHEN 'purchase' THEN 'rectify' WHEN 'signup' THEN 'layout_a' ELSE 'classify' END,
  CASE WHEN user_id % 2 = 0 THEN '.confidence' ELSE '.latency' END) AS metric, value, ts, event_id AS seq FROM {events}""",
    "v_baselines": "SELECT metric, avg(value) * 0.9 AS mean, CAST(CASE WHEN metric LIKE 'classify%' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS std FROM {v_observations} WHERE metric <> 'rectify.latency' GROUP BY metric",
    "v_regions": """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS page_id, CAST(vec_id % 10 AS INT) AS pos,
  CASE label % 5 WHEN 0 THEN 'text_block' WHEN 1 THEN 'title' WHEN 2 THEN 'table' WHEN 3 THEN 'image' ELSE 'caption' END AS type,
  CAST({e1} AS DOUBLE) * 300 + 500 AS x_min, CAST({e2} AS DOUBLE) * 400 + 700 AS y_min, CAST({e1} AS DOUBLE) * 300 + 520 + abs(CAST({e3} AS DOUBLE)) * 1500 AS x_max,
  CAST({e2} AS DOUBLE) * 400 + 720 + abs(CAST({e4} AS DOUBLE)) * 1500 AS y_max, least(1.0, 0.5 + abs(CAST({e7} AS DOUBLE))) AS confidence
FROM {embeddings}""",
    "v_regions_b": """
SELECT page_id, pos, CASE WHEN pos = 9 THEN 'caption' ELSE type END AS type, x_min + pos * 2 AS x_min, y_min + 3 AS y_min, x_max + pos * 2 AS x_max, y_max + 3 AS y_max, confidence * 0.95 AS confidence
FROM {v_regions} WHERE (page_id + pos) % 6 <> 0""",
    "v_quads": """
SELECT vec_id, CASE label % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'newspaper' WHEN 2 THEN 'archival_document' ELSE 'microfilm' END AS material_type,
  50 + CAST({e1} AS DOUBLE) * 100 AS x1, 40 + CAST({e2} AS DOUBLE) * 100 AS y1, 700 + CAST({e3} AS DOUBLE) * 100 AS x2, 60 + CAST({e4} AS DOUBLE) * 100 AS y2,
  720 + CAST({e5} AS DOUBLE) * 200 AS x3, 540 + CAST({e6} AS DOUBLE) * 200 AS y3, 60 + CAST({e7} AS DOUBLE) * 100 AS x4, 550 + CAST({e8} AS DOUBLE) * 100 AS y4,
  least(1.0, 0.6 + abs(CAST({e9} AS DOUBLE)) * 2) AS confidence, least(1.0, 0.65 + abs(CAST({e10} AS DOUBLE)) * 2) AS tta_agreement, abs(CAST({e11} AS DOUBLE)) AS tta_variance,
  abs(CAST({e12} AS DOUBLE)) * 20 AS skew_residual, least(1.0, abs(CAST({e13} AS DOUBLE)) * 5) AS blur_score, least(1.0, abs(CAST({e14} AS DOUBLE)) * 4) AS border_score,
  least(1.0, abs(CAST({e15} AS DOUBLE)) * 5) AS foreground_coverage
FROM {embeddings}""",
    "v_predictions": """
SELECT d.doc_id AS case_id, concat('img-', CAST(d.doc_id AS STRING)) AS image_key, l.quality AS expected_class, CASE WHEN d.n_chars % 9 > 0 THEN l.quality ELSE 1 - l.quality END AS predicted_class,
  CAST(0.6 + (d.n_chars % 41) / 100.0 AS DOUBLE) AS confidence, CAST(0.7 AS DOUBLE) AS confidence_min, d.lang AS material_type, CAST(0.5 + (d.n_chars % 53) / 100.0 AS DOUBLE) AS iou, CAST(0.75 AS DOUBLE) AS iou_min,
  d.n_chars % 4 = 0 AS split_expected, d.n_chars % 4 = 0 OR d.n_chars % 31 = 0 AS split_predicted
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}

#: By what lines are laid out; a block is 64 page numbers of a job, so a job of few pages lies in one and one of very many in many.
JOB_ID = "concat('job-', CAST(l_orderkey AS STRING))"
PAGE_BLOCK = f"floor(({PAGE_NUMBER}) / 64)"


def _spark_pages(block: str = "") -> str:
    """Pages of ``{lines}``; ``block`` is empty, or ``page_block, `` for that column, which the page number determines.

    Every line stands once, and once more for the split parent of its page, so that one grouping finds pages and parents; with
    the lines laid out by ``JOB_ID`` and ``PAGE_NUMBER`` (or ``PAGE_BLOCK``), neither it nor what groups pages by job and page
    (and block) shuffles again.
    """
    return f"""
SELECT page_id, job_id, {block}page_number, sub_page_index, CASE WHEN NOT parent THEN status WHEN k % 2 = 0 THEN 'split' ELSE 'pending_human_correction' END AS status, processing_time_ms, status_updated_at, created_at,
  CASE WHEN parent THEN 0 ELSE retry_count END AS retry_count, output_uri, input_uri, reading_order, CASE WHEN parent THEN false ELSE qa_approved END AS qa_approved,
  CASE WHEN parent THEN false ELSE human_corrected END AS human_corrected, CASE WHEN NOT parent THEN review_reasons END AS review_reasons
FROM (SELECT {_PAGE_ID}, job_id, k, parent, {block}page_number, sub_page_index,
  {_FROM_LINES}
FROM (SELECT job_id, k, {block}page_number, CASE WHEN NOT parent THEN sub_page END AS sub_page_index, parent, max(l_quantity) FILTER (WHERE NOT parent) AS q, max(l_partkey) FILTER (WHERE NOT parent) AS p,
  max(l_suppkey) FILTER (WHERE NOT parent) AS s, max(l_extendedprice) FILTER (WHERE NOT parent) AS price, max(l_shipdate) FILTER (WHERE NOT parent) AS ship
FROM (SELECT *, {JOB_ID} AS job_id, l_orderkey AS k, {PAGE_NUMBER} AS page_number, {PAGE_BLOCK} AS page_block, {_SUB_PAGE} AS sub_page, explode(CASE WHEN l_orderkey % 3 = 0 THEN array(false, true) ELSE array(false) END) AS parent FROM {{lines}})
GROUP BY ALL))"""


SPARK_PAGES, SPARK_BLOCKS = _spark_pages(), _spark_pages("page_block, ")


def _elements(sql: str, first: int) -> str:
    return re.sub(r"\{e(\d+)\}", lambda m: f"embedding[{int(m[1]) - 1 + first}]", sql)


def needs(name: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", VIEWS[name])))


def spark_sql(name: str) -> tuple[str, list[str]]:
    """Spark SQL with its DataFrame arguments left in braces."""
    return _elements(VIEWS[name], 0), needs(name)


def twin_sql(name: str) -> str:
    """DuckDB SQL that refers to views and tables by name."""
    return _elements(VIEWS[name], 1).format(**{n: n for n in needs(name)})
