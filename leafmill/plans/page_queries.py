"""Queries over jobs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import pages as p
from leafmill.plans.registry import Tables, query
from leafmill.plans.views import NOW_PAGES

_T = f"TIMESTAMP '{NOW_PAGES}'"
_LEAF = "SELECT * FROM v_pages x WHERE NOT (sub_page_index IS NULL AND EXISTS (SELECT 1 FROM v_pages c WHERE c.job_id = x.job_id AND c.page_number = x.page_number AND c.sub_page_index IS NOT NULL))"
_AUTO = "('queued','preprocessing','rectification','layout_detection','semantic_norm')"


@query(f"SELECT page_id, status FROM v_pages WHERE status IN ('accepted','review','failed') AND status_updated_at BETWEEN {_T} - INTERVAL 8760 HOUR AND {_T}")
def p1_terminal_window(t: Tables):
    return p.terminal_in_window(t.v_pages, NOW_PAGES, 8760).select("page_id", "status")


@query("SELECT job_id, collection_id, status FROM v_jobs WHERE (job_id ILIKE '%12%' OR collection_id ILIKE '%12%') AND material_type = 'book' AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def p2_search_jobs(t: Tables):
    return p.search_jobs(t.v_jobs, text="12", material="book", since="1996-01-01", until="1999-12-31").select("job_id", "collection_id", "status")


@query("SELECT page_id, status FROM v_pages WHERE list_contains(from_json(review_reasons, '[\"VARCHAR\"]'), 'split_confidence_low')")
def p3_has_reason(t: Tables):
    return p.has_reason(t.v_pages, "split_confidence_low").select("page_id", "status")


@query(f"SELECT CASE WHEN status IN {_AUTO} THEN 'automatable' WHEN status IN ('pending_human_correction','ptiff_qa_pending') THEN 'human_only' ELSE 'terminal' END AS work, count(*) AS n FROM v_pages GROUP BY 1")
def p4_work_classes(t: Tables):
    return t.v_pages.groupBy(p.work_class(F.col("status")).alias("work")).agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, coalesce(age >= lim, true) AS stale_recovery, coalesce(age >= lim, false) AS stale_drain FROM (
SELECT page_id, epoch({_T}) - epoch(coalesce(status_updated_at, created_at)) AS age, CASE WHEN status = 'layout_detection' THEN 180 ELSE 900 END AS lim FROM v_pages)""")
def p5_stale_pages(t: Tables):
    return t.v_pages.select("page_id", p.is_stale(NOW_PAGES, True).alias("stale_recovery"), p.is_stale(NOW_PAGES, False).alias("stale_drain"))


_MOVES = "SELECT job_id, page_number, status AS from_state, lead(status) OVER (PARTITION BY job_id ORDER BY page_number, sub_page_index NULLS FIRST, page_id, status) AS to_state FROM v_pages"
_EDGES = ", ".join(f"('{a}','{b}')" for a, to in p.TRANSITIONS.items() for b in to)


@query(f"SELECT from_state, to_state, count(*) AS n FROM ({_MOVES}) m WHERE to_state IS NOT NULL AND (from_state, to_state) NOT IN (SELECT * FROM (VALUES {_EDGES})) GROUP BY 1, 2")
def p6_invalid_transitions(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy("page_number", F.col("sub_page_index").asc_nulls_first(), "page_id", "status")
    moves = t.v_pages.select(F.col("status").alias("from_state"), F.lead("status").over(w).alias("to_state")).where("to_state IS NOT NULL")
    return p.invalid_transitions(moves).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


_NEXT = " ".join(f"WHEN '{a}' THEN {len(to)}" for a, to in p.TRANSITIONS.items())


@query(f"SELECT page_id, status, status IN ('ptiff_qa_pending','accepted','pending_human_correction','review','failed','split') AS worker_terminal, status IN ('review','failed') AS leaf_final, CASE status {_NEXT} END AS n_next FROM v_pages")
def p7_state_flags(t: Tables):
    return p.state_flags(t.v_pages)


@query("SELECT material_type, count(*) AS n, round(sum(CASE WHEN price > 200000 THEN 1 ELSE 0 END) / count(*), 4) AS rate, 0.0 AS empty_rate FROM v_lineage GROUP BY 1")
def p9_safe_rate(t: Tables):
    return t.v_lineage.groupBy("material_type").agg(F.count("*").alias("n"), p.safe_rate(F.count_if(F.col("price") > 200000), F.count("*")).alias("rate"), p.safe_rate(F.lit(1), F.count_if(F.lit(False))).alias("empty_rate"))


@query("""SELECT CASE WHEN m IN ('book','newspaper','microfilm') THEN m WHEN m = 'archival_document' THEN 'microfilm' ELSE 'book' END AS bucket, count(*) AS n
FROM (SELECT lower(trim(material_type)) AS m FROM v_lineage) GROUP BY 1""")
def p10_material_buckets(t: Tables):
    return t.v_lineage.groupBy(p.material_bucket(F.col("material_type")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT page_id, coalesce(nullif(output_uri, ''), nullif(input_uri, '')) AS uri, CASE WHEN nullif(output_uri, '') IS NOT NULL THEN 'output' WHEN nullif(input_uri, '') IS NOT NULL THEN 'input' END AS uri_source FROM v_pages")
def p11_preferred_uri(t: Tables):
    return p.preferred_uri(t.v_pages).select("page_id", "uri", "uri_source")


_NAME = "printf('page_%04d', page_number) || coalesce('_' || coalesce(reading_order, sub_page_index)::VARCHAR, '') || '.tiff'"


@query(f"SELECT page_id, {_NAME} AS name FROM v_pages")
def p12_canonical_filename(t: Tables):
    return t.v_pages.select("page_id", p.canonical_filename().alias("name"))


@query("SELECT page_id, CASE WHEN sub_page_index IS NOT NULL THEN 'split_child' WHEN human_corrected THEN 'human_corrected' WHEN nullif(output_uri, '') IS NOT NULL THEN 'normalized_output' ELSE 'original_upload' END AS role FROM v_pages")
def p13_artifact_role(t: Tables):
    return t.v_pages.select("page_id", p.artifact_role().alias("role"))


@query("""SELECT lineage_id, CASE WHEN c THEN corr_w WHEN d THEN down_w END AS width, CASE WHEN c THEN corr_h WHEN d THEN down_h END AS height, CASE WHEN c THEN 'correction' WHEN d THEN 'downsample' ELSE 'rejected' END AS dims_source
FROM (SELECT *, coalesce(corr_w > 0 AND corr_h > 0, false) AS c, coalesce(down_w > 0 AND down_h > 0, false) AS d FROM v_lineage)""")
def p14_resolve_dims(t: Tables):
    return p.resolve_dims(t.v_lineage).select("lineage_id", "width", "height", "dims_source")


@query("SELECT lineage_id, isoyear(human_correction_timestamp) = 1997 AND week(human_correction_timestamp) = 20 AS in_week, true AS in_all FROM v_lineage WHERE human_correction_timestamp IS NOT NULL UNION ALL SELECT lineage_id, false, true FROM v_lineage WHERE human_correction_timestamp IS NULL")
def p15_source_window(t: Tables):
    at = F.col("human_correction_timestamp")
    return t.v_lineage.select("lineage_id", p.in_source_window(at, "1997w20").alias("in_week"), p.in_source_window(at, "all").alias("in_all"))


@query("""SELECT lineage_id, sub_page_index, CASE sub_page_index WHEN 0 THEN 0 ELSE cut END AS x_min, CASE sub_page_index WHEN 0 THEN cut ELSE down_w END AS x_max
FROM (SELECT lineage_id, down_w, coalesce(corr_w, down_w // 2) AS cut FROM v_lineage) CROSS JOIN (VALUES (0), (1)) s(sub_page_index) WHERE cut > 0 AND cut < down_w""")
def p24_child_crops(t: Tables):
    return p.child_crops(t.v_lineage.select("lineage_id", F.col("down_w").alias("width"), F.col("corr_w").alias("split_x"))).select("lineage_id", "sub_page_index", "x_min", "x_max")


@query("SELECT v_pages.page_id, v_jobs.material_type, v_jobs.created_by FROM v_pages JOIN v_jobs USING (job_id) WHERE v_pages.status = 'pending_human_correction'")
def j1_page_job(t: Tables):
    return t.v_pages.where("status = 'pending_human_correction'").join(t.v_jobs.select("job_id", "material_type", "created_by"), "job_id").select("page_id", "material_type", "created_by")


@query("SELECT j.job_id, u.username FROM v_jobs j LEFT JOIN v_users u ON j.created_by = u.user_id")
def j2_job_user(t: Tables):
    return t.v_jobs.join(t.v_users, F.col("created_by") == F.col("user_id"), "left").select("job_id", "username")


@query(f"SELECT page_id, status FROM ({_LEAF})")
def j3_review_units(t: Tables):
    return p.review_units(t.v_pages).select("page_id", "status")


@query(f"SELECT job_id FROM v_jobs j WHERE EXISTS (SELECT 1 FROM v_pages x WHERE x.job_id = j.job_id AND x.status IN ('pending_human_correction','ptiff_qa_pending')) AND NOT EXISTS (SELECT 1 FROM v_pages x WHERE x.job_id = j.job_id AND x.status IN {_AUTO})")
def j4_human_only_jobs(t: Tables):
    human, active = (t.v_pages.where(F.col("status").isin(*s)).select("job_id") for s in (p.HUMAN_ONLY, p.AUTOMATABLE))
    return t.v_jobs.select("job_id").join(human, "job_id", "left_semi").join(active, "job_id", "left_anti")


@query("""SELECT x.page_id, EXISTS (SELECT 1 FROM v_pages c WHERE c.job_id = x.job_id AND c.page_number = x.page_number AND c.sub_page_index IS NOT NULL) AS has_children
FROM v_pages x WHERE x.status = 'split'""")
def j5_split_parents(t: Tables):
    parents, kids = t.v_pages.where("status = 'split'").select("page_id", *p.PAGE_KEY), t.v_pages.where("sub_page_index IS NOT NULL").select(*p.PAGE_KEY)
    with_kids = parents.join(kids, list(p.PAGE_KEY), "left_semi").select("page_id", F.lit(True).alias("has_children"))
    return with_kids.unionByName(parents.join(kids, list(p.PAGE_KEY), "left_anti").select("page_id", F.lit(False).alias("has_children")))


@query("SELECT v.job_id, v.page_number, count(*) AS n_children FROM v_pages v WHERE sub_page_index IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_and(coalesce(output_uri, '') <> '')")
def j22_siblings(t: Tables):
    return p.siblings(t.v_pages)


@query("SELECT status, count(*) AS n FROM v_pages GROUP BY 1")
def a7_status_counts(t: Tables):
    return t.v_pages.groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT j.job_id) AS n_jobs FROM v_jobs j JOIN v_pages x USING (job_id) WHERE x.status IN {_AUTO}")
def a8_active_jobs(t: Tables):
    active = t.v_pages.where(F.col("status").isin(*p.AUTOMATABLE)).select("job_id")
    return t.v_jobs.select("job_id").join(active, "job_id", "left_semi").agg(F.count("*").alias("n_jobs"))


@query(f"""SELECT job_id, count(*) AS n_leaf, count(*) FILTER (WHERE status = 'accepted') AS n_accepted, count(*) FILTER (WHERE status = 'review') AS n_review, count(*) FILTER (WHERE status = 'failed') AS n_failed,
count(*) FILTER (WHERE status IN ('pending_human_correction','ptiff_qa_pending')) AS n_pending,
CASE WHEN bool_and(status = 'queued') THEN 'queued' WHEN NOT bool_and(status IN ('split','accepted','review','failed')) THEN 'running' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'done' END AS job_status FROM ({_LEAF}) GROUP BY job_id""")
def a9_job_rollup(t: Tables):
    return p.job_rollup(t.page_blocks, t.page_parts)


@query("""SELECT job_id, NOT bool_or((status = 'ptiff_qa_pending' AND NOT qa_approved) OR (status = 'pending_human_correction' AND NOT parent)) AS gate_ready, count(*) FILTER (WHERE status = 'ptiff_qa_pending') AS n_waiting
FROM (SELECT x.*, sub_page_index IS NULL AND EXISTS (SELECT 1 FROM v_pages c WHERE c.job_id = x.job_id AND c.page_number = x.page_number AND c.sub_page_index IS NOT NULL) AS parent FROM v_pages x) WHERE status <> 'split' GROUP BY job_id""")
def a10_qa_gate(t: Tables):
    return p.qa_gate(t.page_blocks, t.page_parts)


@query("""SELECT job_id, page_number, count(*) FILTER (WHERE sub_page_index IS NOT NULL) AS n_children FROM v_pages GROUP BY 1, 2
HAVING count(*) FILTER (WHERE sub_page_index IS NOT NULL) > 0 AND bool_and(sub_page_index IS NULL OR status IN ('accepted','review','failed')) AND bool_or(sub_page_index IS NULL AND status = 'pending_human_correction')""")
def a11_closable_parents(t: Tables):
    return p.closable_parents(t.v_pages)


@query("""SELECT *, pending = 0 AND in_correction = 0 AS gate_ready FROM (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status = 'ptiff_qa_pending' AND NOT qa_approved) AS pending,
count(*) FILTER (WHERE status = 'ptiff_qa_pending' AND qa_approved) AS approved, count(*) FILTER (WHERE status = 'pending_human_correction') AS in_correction, count(*) FILTER (WHERE status IN ('accepted','layout_detection')) AS released
FROM v_pages WHERE status <> 'split' GROUP BY job_id)""")
def a12_viewer_summary(t: Tables):
    return p.viewer_summary(t.page_blocks, t.page_parts)


_READ = """SELECT *, row_number() OVER w AS position, lag(page_id) OVER w AS previous_page, lead(page_id) OVER w AS next_page FROM v_pages WHERE status <> 'split'
WINDOW w AS (PARTITION BY job_id ORDER BY page_number, coalesce(reading_order, sub_page_index + 1, 0), coalesce(sub_page_index, -1))"""


@query(f"SELECT page_id, previous_page, next_page FROM ({_READ})")
def w6_navigation(t: Tables):
    return p.reading_order(t.v_pages).select("page_id", "previous_page", "next_page")


@query(f"SELECT page_id, job_id, position FROM ({_READ})")
def w7_reading_order(t: Tables):
    return p.reading_order(t.v_pages).select("page_id", "job_id", "position")


@query(f"""SELECT job_id, count(*) AS n_pages, count(*) FILTER (WHERE coalesce(output_uri, '') <> '') AS n_output, count(*) FILTER (WHERE coalesce(output_uri, '') = '') AS n_without_output, count(*) >= 100 AS large,
string_agg({_NAME} || '=' || coalesce(nullif(output_uri, ''), nullif(input_uri, ''), ''), ';' ORDER BY position) AS manifest FROM ({_READ}) GROUP BY job_id""")
def s15_download_manifest(t: Tables):
    return p.download_manifest(t.v_pages)


@query("SELECT page_id, status_updated_at, (SELECT count(*) FROM v_pages WHERE status = 'review') AS total FROM v_pages WHERE status = 'review' ORDER BY status_updated_at ASC NULLS LAST, page_id LIMIT 25 OFFSET 50")
def w19_paginate(t: Tables):
    rows, total = p.paginate(t.v_pages.where("status = 'review'").select("page_id", "status_updated_at"), [F.col("status_updated_at").asc_nulls_last(), F.col("page_id")], 25, page=3)
    return rows.join(F.broadcast(total), how="cross")  # one row


@query("SELECT job_id, created_at FROM v_jobs ORDER BY created_at DESC NULLS FIRST, job_id LIMIT 100")
def o1_newest_jobs(t: Tables):
    return t.v_jobs.select("job_id", "created_at").orderBy(F.col("created_at").desc_nulls_first(), "job_id").limit(100)


@query("SELECT page_id, status_updated_at FROM v_pages WHERE status = 'pending_human_correction' ORDER BY status_updated_at ASC NULLS LAST, page_id LIMIT 50")
def o2_oldest_waiting(t: Tables):
    return t.v_pages.where("status = 'pending_human_correction'").select("page_id", "status_updated_at").orderBy(F.col("status_updated_at").asc_nulls_last(), "page_id").limit(50)


@query(f"SELECT page_id, coalesce(status_updated_at, created_at) AS moment FROM v_pages WHERE status IN {_AUTO} ORDER BY moment ASC NULLS FIRST, page_id LIMIT 20")
def o3_oldest_active(t: Tables):
    return t.v_pages.where(F.col("status").isin(*p.AUTOMATABLE)).select("page_id", F.coalesce("status_updated_at", "created_at").alias("moment")).orderBy(F.col("moment").asc_nulls_first(), "page_id").limit(20)


@query("SELECT job_id, string_agg(page_number::VARCHAR || ':' || status, ',' ORDER BY page_number, sub_page_index NULLS FIRST, status) AS pages FROM v_pages GROUP BY job_id")
def o4_job_page_list(t: Tables):
    entry = F.struct("page_number", "sub_page_index", "status")
    lists = t.v_pages.groupBy("job_id").agg(F.sort_array(F.collect_list(entry)).alias("a"))
    return lists.select("job_id", F.array_join(F.transform("a", lambda x: F.concat(x["page_number"].cast("string"), F.lit(":"), x["status"])), ",").alias("pages"))


@query(f"SELECT page_id, job_id, status AS from_state, 'failed' AS to_state FROM ({_LEAF}) WHERE status IN {_AUTO} OR status IN ('ptiff_qa_pending','pending_human_correction')")
def c15_cancel_plan(t: Tables):
    return p.cancel_plan(t.v_pages)


@query("""WITH g AS (SELECT job_id FROM (SELECT x.*, sub_page_index IS NULL AND EXISTS (SELECT 1 FROM v_pages c WHERE c.job_id = x.job_id AND c.page_number = x.page_number AND c.sub_page_index IS NOT NULL) AS parent FROM v_pages x) WHERE status <> 'split' GROUP BY job_id
HAVING NOT bool_or((status = 'ptiff_qa_pending' AND NOT qa_approved) OR (status = 'pending_human_correction' AND NOT parent)))
SELECT x.page_id, x.job_id, CASE WHEN j.pipeline_mode = 'layout' THEN 'layout_detection' ELSE 'accepted' END AS to_state FROM v_pages x JOIN g USING (job_id) JOIN v_jobs j USING (job_id) WHERE x.status = 'ptiff_qa_pending'""")
def c16_release_plan(t: Tables):
    return p.release_plan(t.page_blocks, t.v_jobs, t.page_parts)


_ACTIONS = """SELECT page_id, action, moment FROM (SELECT page_id, status_updated_at AS moment, CASE retry_count WHEN 0 THEN 'approve' WHEN 1 THEN 'flag' WHEN 2 THEN 'correct' WHEN 3 THEN 'reject' ELSE 'edit' END AS action FROM {p} WHERE status_updated_at IS NOT NULL
UNION ALL SELECT page_id, created_at, 'split' FROM {p} WHERE created_at IS NOT NULL UNION ALL SELECT page_id, status_updated_at + INTERVAL 1 HOUR, 'send_to_review' FROM {p} WHERE status_updated_at IS NOT NULL AND page_number = 2) a"""
_CASES = " ".join(f"WHEN action = '{n}' THEN status IN ({', '.join(repr(s) for s in froms)})" for n, (froms, _) in p.ACTIONS.items())
_TO = " ".join(f"WHEN action = '{n}' THEN {repr(to) if to else 'status'}" for n, (_, to) in p.ACTIONS.items())


@query(f"""WITH a AS ({_ACTIONS.format(p="v_pages")}), l AS (SELECT page_id, action FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY moment DESC, action DESC) AS r FROM a) WHERE r = 1)
SELECT page_id, action, status AS from_state, ok AS applied, CASE WHEN ok THEN CASE {_TO} END ELSE status END AS to_state,
CASE WHEN ok AND action = 'approve' THEN true WHEN ok AND action IN ('edit','flag') THEN false ELSE qa_approved END AS approved, CASE WHEN ok AND action = 'split' THEN 2 ELSE 0 END AS n_children
FROM (SELECT x.page_id, l.action, x.status, x.qa_approved, CASE {_CASES} END AS ok FROM v_pages x JOIN l USING (page_id))""")
def c21_apply_actions(t: Tables):
    return p.apply_actions(t.v_pages, t.spark.sql(_ACTIONS, p=t.v_pages))
