"""Queries of curation, golden evaluation, models and orientation."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import curation as c
from leafmill.operators import golden as gd
from leafmill.operators import orientation as o
from leafmill.plans.registry import Tables, query
from leafmill.plans.views import NOW_EVENTS

_BUCKET = "CASE WHEN lower(trim(material_type)) IN ('book','newspaper','microfilm') THEN lower(trim(material_type)) WHEN lower(trim(material_type)) = 'archival_document' THEN 'microfilm' ELSE 'book' END"
_GRID = "(SELECT f AS family, m AS material FROM (VALUES ('segmentation'), ('pose')) x(f) CROSS JOIN (VALUES ('book'), ('newspaper'), ('microfilm')) y(m))"
_FAM = f"SELECT family, {_BUCKET} AS material, l.* FROM v_lineage l CROSS JOIN (VALUES ('segmentation'), ('pose')) f(family) WHERE human_corrected AND acceptance_decision = 'accepted' AND CASE family WHEN 'pose' THEN geometry_b_used ELSE geometry_a_used END"


@query("SELECT job_id, CASE WHEN ('0x' || substr(sha1('42:' || job_id), 1, 8))::BIGINT % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM v_jobs")
def f13_hash_split(t: Tables):
    return t.v_jobs.select("job_id", c.hash_split(F.col("job_id")).alias("part"))


@query("""WITH s AS (SELECT stem, row_number() OVER (ORDER BY sha1('42|' || stem), stem) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT 'job-' || o_custkey AS stem FROM orders))
SELECT part, count(*) AS n FROM (SELECT CASE WHEN r <= round(n * 0.70) THEN 'train' WHEN r <= round(n * 0.70) + round(n * 0.15) THEN 'val' ELSE 'test' END AS part FROM orders JOIN s ON s.stem = 'job-' || o_custkey) GROUP BY 1""")
def f14_group_split(t: Tables):
    items = t.orders.select(F.concat(F.lit("job-"), F.col("o_custkey").cast("string"), F.lit("_rot"), ((F.col("o_orderkey") % 4) * 90).cast("string"), F.lit(".png")).alias("name"))
    return c.group_split(items, c.base_stem(F.col("name"))).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT vec_id, '0 ' || printf('%.6f', x1) || ' ' || printf('%.6f', y1) || ' ' || printf('%.6f', x2) || ' ' || printf('%.6f', y2) AS line FROM v_quads")
def f15_label_line(t: Tables):
    return t.v_quads.select("vec_id", c.seg_line(F.lit(0), [(F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))]).alias("line"))


@query("""SELECT lineage_id, split_part(substr(otiff_uri, 6), '/', 1) AS bucket, substr(otiff_uri, 6 + length(split_part(substr(otiff_uri, 6), '/', 1)) + 1) AS key, regexp_extract(lineage_id, '([^-]+)$', 1) AS suffix,
's3://w/' || lineage_id AS book_weights FROM v_lineage""")
def f16_parsing(t: Tables):
    notes = F.concat(F.lit("run ok weights:book=s3://w/"), "lineage_id", F.lit(" weights:microfilm=s3://m/x done"))
    u = c.object_uri(F.col("otiff_uri"))
    return t.v_lineage.select("lineage_id", u["bucket"].alias("bucket"), u["key"].alias("key"), c.case_suffix(F.replace("lineage_id", F.lit("-"), F.lit("_"))).alias("suffix"), c.weight_tokens(notes)["book"].alias("book_weights"))


@query("SELECT lineage_id, regexp_replace(otiff_uri, '^(.*/)([^/]+)$', '\\1corrected/\\2') AS corrected, replace(otiff_uri, '.tiff', '_1.tiff') AS child FROM v_lineage")
def f17_derived_uri(t: Tables):
    return t.v_lineage.select("lineage_id", c.derived_uri(F.col("otiff_uri"), "corrected").alias("corrected"), c.derived_uri(F.col("otiff_uri"), "child", F.lit(1)).alias("child"))


@query("SELECT event_id, TRY_CAST(props->>'k' AS DOUBLE) AS k, props->>'missing' AS missing, TRY_CAST(props AS DOUBLE) AS bad FROM events")
def f18_json_fields(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.col("props").try_cast("double").alias("bad"))


@query(f"SELECT event_id, (epoch(TIMESTAMP '{NOW_EVENTS}') - epoch(date_trunc('second', ts)))::BIGINT AS age, isoyear(ts) AS iso_year, week(ts) AS iso_week, date_trunc('hour', ts) AS hour FROM events")
def f19_dates(t: Tables):
    return t.events.select("event_id", (F.unix_timestamp(F.lit(NOW_EVENTS).cast("timestamp")) - F.unix_timestamp("ts")).alias("age"), F.extract(F.lit("YEAROFWEEK"), F.col("ts")).alias("iso_year"), F.weekofyear("ts").alias("iso_week"), F.date_trunc("hour", "ts").alias("hour"))


_ORDER = "SELECT CAST(floor(vec_id / 3) AS BIGINT) AS k, CASE WHEN CAST(floor(vec_id / 3) AS BIGINT) % 3 = 0 THEN 'rtl' WHEN CAST(floor(vec_id / 3) AS BIGINT) % 3 = 1 THEN 'ltr' ELSE 'unresolved' END AS direction, concat('u', CAST(vec_id AS STRING)) AS uri, x1 AS x FROM {q} WHERE vec_id % 7 <> 0"


@query(f"""SELECT k, CASE WHEN n = 1 THEN l WHEN d = 'rtl' THEN r ELSE l END AS first_uri, CASE WHEN n > 1 THEN CASE WHEN d = 'rtl' THEN l ELSE r END END AS second_uri FROM (SELECT k, count(*) AS n, min(direction) AS d, arg_min(uri, x) AS l, arg_max(uri, x) AS r FROM ({_ORDER.format(q="v_quads")}) GROUP BY k)""")
def f20_assign_order(t: Tables):
    return o.assign_order(t.spark.sql(_ORDER, q=t.v_quads), "k")


_WORK = "SELECT lineage_id, down_w AS width, CASE WHEN o % 3 = 0 THEN CAST(10 AS INT) END AS h_x0, CASE WHEN o % 2 = 0 THEN CAST(400 AS INT) END AS h_x1, CASE WHEN o % 5 <> 0 THEN CAST(20 AS INT) END AS a_x0, CASE WHEN o % 7 <> 0 THEN CAST(410 AS INT) END AS a_x1, CAST(30 AS INT) AS b_x0, CASE WHEN o % 4 <> 0 THEN CAST(420 AS INT) END AS b_x1 FROM (SELECT *, CAST(price AS BIGINT) AS o FROM {l}) x"


@query(f"""SELECT lineage_id, CASE WHEN h THEN 'human' WHEN a THEN 'gate_a' WHEN b THEN 'gate_b' ELSE 'half_page' END AS source, CASE WHEN h THEN h_x0 WHEN a THEN a_x0 WHEN b THEN b_x0 ELSE 0 END AS x0, CASE WHEN h THEN h_x1 WHEN a THEN a_x1 WHEN b THEN b_x1 ELSE width // 2 END AS x1
FROM (SELECT *, h_x0 IS NOT NULL AND h_x1 IS NOT NULL AS h, a_x0 IS NOT NULL AND a_x1 IS NOT NULL AS a, b_x1 IS NOT NULL AS b FROM ({_WORK.format(l="v_lineage").replace('CAST(price AS BIGINT)', 'CAST(trunc(price) AS BIGINT)')}))""")
def f21_workspace_params(t: Tables):
    return c.workspace_params(t.spark.sql(_WORK, l=t.v_lineage)).select("lineage_id", "source", "x0", "x1")


_RULES = {
    "confidence_range": "confidence BETWEEN 0 AND 0.8", "box_order": "x_min < x_max AND y_min < y_max", "inside": "x_max <= 1000", "type": "type IN ('text_block', 'title', 'table', 'image')", "id": "pos <> 3", "corners": "pos <> 5",
    "page_count": "page_id % 4 <> 1 OR pos <> 2", "boundaries": "x_min < x_max AND x_max < y_max", "context": "page_id % 9 <> 0",
}


@query(f"SELECT page_id, pos, concat_ws(',', {', '.join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in _RULES.items())}) AS broken FROM v_regions")
def p8_validate(t: Tables):
    rows = t.v_regions.select(
        "*", F.when(F.col("pos") == 3, "x3").otherwise(F.concat(F.lit("r"), "pos")).alias("id"), F.slice(F.array("x_min", "y_min", "x_max", "y_max"), 1, F.when(F.col("pos") == 5, 3).otherwise(4)).alias("corners"),
        F.when((F.col("page_id") % 4 == 1) & (F.col("pos") == 2), 2).otherwise(1).alias("page_count"), F.array(F.lit(1)).alias("pages"), F.lit(800).alias("width"), F.when(F.col("page_id") % 9 == 0, 801).otherwise(800).alias("context_width"),
    )
    rules = {"confidence_range": F.col("confidence").between(0, 0.8), "box_order": (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max")), "inside": F.col("x_max") <= 1000, "type": F.col("type").isin("text_block", "title", "table", "image")}
    rules |= {"id": F.col("id").rlike(r"^r\d+$"), "corners": F.size("corners") == 4, "page_count": F.size("pages") == F.col("page_count"), "boundaries": c.ascending(F.array("x_min", "x_max", "y_max")), "context": F.col("width") == F.col("context_width")}
    return c.validate(rows, rules).select("page_id", "pos", F.array_join("broken", ",").alias("broken"))


_STORED = "CASE WHEN p % 3 = 0 THEN NULL ELSE concat('{{\"layout_input\":{{\"source_page_artifact_uri\":\"', CASE WHEN p % 3 = 1 THEN uri ELSE 's3://old' END, '\"}},\"downsample\":\"d\"', CASE WHEN p % 2 = 0 THEN ',\"keep\":\"k\"' ELSE '' END, '}}') END"
_LAYOUTS = f"SELECT page_id, uri, {_STORED} AS stored FROM (SELECT page_id, coalesce(output_uri, 'none') AS uri, retry_count + page_number AS p FROM {{t}}) x"
_LAYOUT_SQL = _LAYOUTS.format(t="v_pages")


@query(f"SELECT page_id, (stored->'layout_input'->>'source_page_artifact_uri') IS NOT DISTINCT FROM uri AS fresh FROM ({_LAYOUT_SQL})")
def p19_fresh_layout(t: Tables):
    return t.spark.sql(_LAYOUTS, t=t.v_pages).select("page_id", c.fresh_layout(F.col("stored"), F.col("uri")).alias("fresh"))


@query(f"SELECT page_id, CASE WHEN stored LIKE '%keep%' THEN 'keep=k' END AS left_over FROM ({_LAYOUT_SQL})")
def p21_without_layout(t: Tables):
    m = c.without_layout(F.col("stored"))
    return t.spark.sql(_LAYOUTS, t=t.v_pages).select("page_id", F.when(m.isNotNull(), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")).alias("left_over"))


@query("""SELECT lineage_id, array_to_string(a, ',') AS allowed, a[1] AS default_source, CASE WHEN list_contains(a, corrected_uri) THEN corrected_uri END AS chosen FROM (SELECT lineage_id, corrected_uri, list_filter([output_uri, CASE WHEN corrected_uri = output_uri THEN NULL ELSE corrected_uri END, otiff_uri], lambda x: x IS NOT NULL) AS a FROM v_lineage WHERE corrected_uri IS NOT NULL)""")
def p20_correction_source(t: Tables):
    s = c.correction_source([F.col("output_uri"), F.col("corrected_uri"), F.col("otiff_uri"), F.col("output_uri")], F.col("corrected_uri"))
    return t.v_lineage.where("corrected_uri IS NOT NULL").select("lineage_id", F.array_join(s["allowed"], ",").alias("allowed"), s["default"].alias("default_source"), s["chosen"].alias("chosen"))


@query("SELECT lineage_id, CASE WHEN output_uri IS NULL THEN otiff_uri ELSE output_uri || ',' || otiff_uri END AS uris FROM v_lineage")
def u5_ordered_distinct(t: Tables):
    return t.v_lineage.select("lineage_id", F.array_join(F.array_distinct(F.filter(F.array("output_uri", "otiff_uri", "output_uri", "otiff_uri"), lambda x: x.isNotNull())), ",").alias("uris"))


_POLICIES = "SELECT model_id, price > 950 AS needs_audit, price > 1000 AS needs_slo, CASE WHEN stage = 'staging' THEN 'a' END AS audit_evidence, CASE WHEN stage = 'production' THEN 's' END AS slo_evidence FROM {m}"


@query(f"SELECT model_id, concat_ws(',', CASE WHEN needs_audit AND audit_evidence IS NULL THEN 'audit' END, CASE WHEN needs_slo AND slo_evidence IS NULL THEN 'slo' END) AS missing FROM ({_POLICIES.format(m='v_models')}) WHERE (needs_audit AND audit_evidence IS NULL) OR (needs_slo AND slo_evidence IS NULL)")
def p23_guardrails(t: Tables):
    return c.guardrails(t.spark.sql(_POLICIES, m=t.v_models)).select("model_id", F.array_join("missing", ",").alias("missing"))


_ROWS = """SELECT *, CASE WHEN coalesce(corr_w > 0 AND corr_h > 0, false) OR coalesce(down_w > 0 AND down_h > 0, false) THEN CASE WHEN geometry_a_used OR geometry_b_used THEN NULL ELSE 'no_family' END ELSE 'no_dimensions' END AS reason FROM v_lineage WHERE human_corrected AND acceptance_decision = 'accepted'"""


@query(f"""SELECT 'kept' AS kind, family || '/' || {_BUCKET} || '/' || CASE WHEN ('0x' || substr(sha1('42:' || job_id), 1, 8))::BIGINT % 5 = 0 THEN 'val' ELSE 'train' END AS name, count(*) AS n FROM ({_ROWS}) r CROSS JOIN (VALUES ('segmentation'), ('pose')) f(family)
WHERE reason IS NULL AND CASE family WHEN 'pose' THEN geometry_b_used ELSE geometry_a_used END GROUP BY 2 UNION ALL SELECT 'skipped', reason, count(*) FROM ({_ROWS}) WHERE reason IS NOT NULL GROUP BY 2""")
def c13_corrected_set(t: Tables):
    kept, skipped = c.corrected_set(t.v_lineage, "all")
    names = kept.groupBy(F.concat_ws("/", "family", "material", "part").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kept").alias("kind"), "name", "n")
    return names.unionByName(skipped.select(F.lit("skipped").alias("kind"), F.col("reason").alias("name"), "n"))


@query(f"SELECT family || '_' || material AS name, count(*) AS n FROM ({_FAM}) WHERE coalesce(corr_w > 0 AND corr_h > 0, false) OR coalesce(down_w > 0 AND down_h > 0, false) GROUP BY 1")
def a31_export_report(t: Tables):
    kept, _ = c.corrected_set(t.v_lineage, None)
    return kept.groupBy(F.concat_ws("_", "family", "material").alias("name")).agg(F.count("*").alias("n"))


@query(f"SELECT g.family, g.material, coalesce(n, 0) AS n, coalesce(n, 0) >= 1000 AS enough FROM {_GRID} g LEFT JOIN (SELECT family, material, count(*) AS n FROM ({_FAM}) GROUP BY 1, 2) x ON x.family = g.family AND x.material = g.material")
def a14_sufficiency(t: Tables):
    return c.sufficiency(t.v_lineage, 1000)


@query("SELECT fold, source = fold AS held_out, count(*) AS n FROM documents CROSS JOIN (VALUES ('src0'), ('src1'), ('src2')) f(fold) GROUP BY 1, 2")
def a37_folds(t: Tables):
    items = t.documents.select("doc_id", F.col("source").alias("collection"))
    return c.folds(items, ["src0", "src1", "src2"], F.col("doc_id")).groupBy("fold", "held_out").agg(F.count("*").alias("n"))


@query("SELECT service_name AS family, version_tag AS version FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY created_at DESC, version_tag DESC) AS r FROM v_models WHERE stage <> 'shadow') WHERE r = 1")
def w14_latest_dataset(t: Tables):
    return c.latest_dataset(t.v_models.select(F.col("service_name").alias("family"), F.col("version_tag").alias("version"), "created_at", (F.col("stage") != "shadow").alias("approved")))


@query("""SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS checksum, sum(n)::BIGINT AS n_files FROM (SELECT b, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n
FROM (SELECT ('0x' || substr(sha1('p/' || page_id), 1, 8))::BIGINT % greatest(1, (SELECT count(*) FROM pages) // 1000) AS b, 'p/' || page_id || '=' || sha256(html) AS line FROM pages) GROUP BY b)""")
def a32_dataset_checksum(t: Tables):
    return c.dataset_checksum(t.pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("hash")))


@query("""SELECT 'c_' || d.doc_id AS case_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'found' END AS state, coalesce(n, 0) >= 2 AS split_expected FROM documents d
LEFT JOIN (SELECT doc_id, count(CASE WHEN quality = 1 THEN 1 END) AS n FROM labels GROUP BY 1) l USING (doc_id)""")
def j24_refresh_cases(t: Tables):
    cases = t.documents.select(F.concat(F.lit("c_"), F.col("doc_id").cast("string")).alias("case_id"))
    return c.refresh_cases(cases, t.labels.select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, 1).alias("box")))


_CASES = "SELECT image_key, case_id, CASE WHEN case_id % 7 = 0 THEN 'x' ELSE material_type END AS sha FROM {p}"


@query("SELECT image_key, case_id AS case_a, case_id AS case_b, true AS same FROM v_predictions WHERE case_id % 7 <> 0 AND case_id % 2 = 0 UNION ALL SELECT image_key, case_id, case_id, false FROM v_predictions WHERE case_id % 7 = 0 AND case_id % 2 = 0")
def j9_golden_pairs(t: Tables):
    a = t.spark.sql("SELECT image_key, case_id, material_type AS sha FROM {p}", p=t.v_predictions)
    pairs, differ = gd.golden_pairs(a, t.spark.sql(_CASES, p=t.v_predictions).where("case_id % 2 = 0"))
    return pairs.withColumn("same", F.lit(True)).unionByName(differ.withColumn("same", F.lit(False)))


@query("SELECT round(avg(confidence), 6) AS value, avg(confidence) >= 0.8 AS pass, count(*) FILTER (WHERE predicted_class <> expected_class OR confidence < confidence_min) AS regressions FROM v_predictions")
def a23_classifier_gate(t: Tables):
    return gd.classifier_gate(t.v_predictions)


@query("""SELECT round(avg(iou), 6) AS value, round(count(*) FILTER (WHERE split_expected AND split_predicted) / count(*) FILTER (WHERE split_expected), 6) AS split_rate, avg(iou) >= 0.75 AND count(*) FILTER (WHERE split_expected AND NOT split_predicted) = 0 AS pass,
count(*) FILTER (WHERE split_expected <> split_predicted) + count(*) FILTER (WHERE iou < iou_min) + count(*) FILTER (WHERE confidence < confidence_min) AS regressions FROM v_predictions""")
def a24_segmentation_gate(t: Tables):
    return gd.segmentation_gate(t.v_predictions)


@query("SELECT round(avg(coalesce(CASE WHEN vec_id % 10 <> 0 THEN confidence END, 0.0)), 6) AS value, round(coalesce(avg(CASE WHEN vec_id % 10 <> 0 THEN (sqrt((x1 - 50) * (x1 - 50) + (y1 - 40) * (y1 - 40)) + sqrt((x2 - 700) * (x2 - 700) + (y2 - 60) * (y2 - 60))) / 2 / 1000 END), 1.0), 6) AS mean_distance, false AS pass, count(*) FILTER (WHERE vec_id % 10 = 0) AS regressions FROM v_quads")
def a25_pose_gate(t: Tables):
    pt = lambda x, y: F.struct((x / 1000).alias("x"), (y / 1000).alias("y"))
    d = gd.mean_keypoint_distance(F.array(pt(F.col("x1"), F.col("y1")), pt(F.col("x2"), F.col("y2"))), F.array(pt(F.lit(50.0), F.lit(40.0)), pt(F.lit(700.0), F.lit(60.0))))
    hit = F.col("vec_id") % 10 != 0
    return gd.pose_gate(t.v_quads.select(F.when(hit, F.col("confidence")).alias("iou"), F.when(hit, d).alias("distance")), least_iou=0.99)


@query("SELECT model_id, count(*) AS total, count(*) FILTER (WHERE coalesce(pass, true)) AS passed, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT coalesce(pass, true)), '') AS failed FROM v_model_gates GROUP BY 1")
def a15_gate_summary(t: Tables):
    return gd.gate_summary(t.v_model_gates)


_JOINED = "SELECT g.*, m.service_name FROM v_model_gates g JOIN v_models m USING (model_id)"


@query(f"SELECT service_name, gate, bool_and(coalesce(pass, true)) AS pass, round(min(value), 4) AS value, sum(regressions)::BIGINT AS regressions FROM ({_JOINED}) GROUP BY 1, 2")
def a16_merge_gates(t: Tables):
    return gd.merge_gates(t.v_model_gates.join(t.v_models.select("model_id", "service_name"), "model_id"))


@query(f"""WITH m AS (SELECT service_name, gate, bool_and(coalesce(pass, true)) AS pass, round(min(value), 4) AS value FROM ({_JOINED}) WHERE gate <> 'latency_p95' GROUP BY 1, 2)
SELECT g.gate, coalesce(a.pass AND b.pass, false) AS pass, least(coalesce(a.value, 0.0), coalesce(b.value, 0.0)) AS value FROM (VALUES ('geometry_iou'), ('split_precision'), ('structural_agreement'), ('golden_dataset'), ('latency_p95')) g(gate)
LEFT JOIN (SELECT * FROM m WHERE service_name = 'geometry_a') a USING (gate) LEFT JOIN (SELECT * FROM m WHERE service_name = 'geometry_b') b USING (gate)""")
def a17_merge_two(t: Tables):
    merged = gd.merge_gates(t.v_model_gates.where("gate <> 'latency_p95'").join(t.v_models.select("model_id", "service_name"), "model_id"))
    return gd.merge_two(merged.where("service_name = 'geometry_a'"), merged.where("service_name = 'geometry_b'"))


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_name, stage ORDER BY CASE WHEN stage = 'archived' THEN promoted_at ELSE created_at END DESC NULLS FIRST, model_id) AS r FROM v_models) WHERE r = 1"


@query(f"SELECT service_name, stage, model_id FROM ({_LATEST})")
def w3_latest_model(t: Tables):
    return gd.latest_model(t.v_models).select("service_name", "stage", "model_id")


@query("SELECT version_tag AS current_version, 'v' || (SELECT count(*) + 1 FROM v_models) AS next_version FROM v_models ORDER BY created_at DESC, model_id LIMIT 1")
def w5_current_policy(t: Tables):
    total = t.v_models.agg(F.concat(F.lit("v"), (F.count("*") + 1).cast("string")).alias("next_version"))
    return t.v_models.orderBy(F.col("created_at").desc(), "model_id").limit(1).select(F.col("version_tag").alias("current_version")).crossJoin(F.broadcast(total))


_SUMMARY = "SELECT model_id, count(*) AS total, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT coalesce(pass, true)), '') AS failed FROM v_model_gates GROUP BY 1"


@query(f"""WITH latest AS ({_LATEST}), s AS ({_SUMMARY}) SELECT l.service_name, l.model_id, p.model_id AS replaces, s.total IS NOT NULL AND s.failed = '' AS promote, CASE WHEN s.total IS NULL THEN 'no_gate_results' WHEN s.failed <> '' THEN 'gates_failed' END AS blocked_by,
(SELECT count(*) FROM latest x WHERE x.stage = 'archived' AND x.service_name = l.service_name) AS can_roll_back FROM latest l LEFT JOIN s USING (model_id) LEFT JOIN (SELECT * FROM latest WHERE stage = 'production') p ON p.service_name = l.service_name WHERE l.stage = 'staging'""")
def c14_promotion_plan(t: Tables):
    plan = gd.promotion_plan(t.v_models, t.v_model_gates).drop("bypassed")
    back = gd.rollback_plan(t.v_models, F.lit(NOW_EVENTS).cast("timestamp")).groupBy("service_name").agg(F.count("*").alias("can_roll_back"))
    return plan.join(back, "service_name", "left").withColumn("can_roll_back", F.coalesce("can_roll_back", F.lit(0)))


_BALLOTS = "SELECT job_id, CASE WHEN processing_time_ms IS NULL THEN 'unknown' WHEN processing_time_ms > 40000 THEN 'book' ELSE 'newspaper' END AS choice, page_number AS pos, 0.5 + page_number / 20.0 AS confidence FROM {p} WHERE sub_page_index IS NULL AND status <> 'split'"


@query(f"""SELECT job_id, choice, n AS votes, total, round(c, 6) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY job_id)::BIGINT AS total, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, f) AS r FROM (SELECT job_id, choice, count(*) AS n, min(pos) AS f, avg(confidence) AS c FROM ({_BALLOTS.format(p='v_pages')}) GROUP BY 1, 2)) WHERE r = 1""")
def a18_vote(t: Tables):
    return gd.vote(t.spark.sql(_BALLOTS, p=t.v_pages).withColumn("confidence", F.col("confidence").cast("double")), "job_id")


_VOTED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY votes DESC, f) AS o, sum(votes) OVER (PARTITION BY k) AS total FROM (SELECT k, choice, count(*) AS votes, min(pos) AS f FROM b WHERE r <= {n} * take GROUP BY 1, 2)) WHERE o = 1"


@query(f"""WITH b AS (SELECT *, CASE WHEN n < 11 THEN n ELSE least(ceil(n * 0.2), 50) END AS take FROM (SELECT collection_id AS k, material_type AS choice, CAST(substr(job_id, 5) AS BIGINT) AS pos, count(*) OVER (PARTITION BY collection_id) AS n,
row_number() OVER (PARTITION BY collection_id ORDER BY sha1(substr(job_id, 5)), CAST(substr(job_id, 5) AS BIGINT)) AS r FROM v_jobs)), one AS ({_VOTED.format(n=1)}), two AS ({_VOTED.format(n=2)})
SELECT k AS collection_id, CASE WHEN one.votes / one.total >= 0.7 THEN one.choice ELSE two.choice END AS choice, 0.9::DOUBLE AS confidence, CASE WHEN one.votes / one.total >= 0.7 THEN 1 ELSE 2 END AS rounds FROM one JOIN two USING (k)""")
def a19_sampled_vote(t: Tables):
    ballots = t.v_jobs.select("collection_id", F.col("material_type").alias("choice"), F.substring("job_id", 5, 20).cast("long").alias("pos"), F.lit(0.9).alias("confidence"))
    return gd.sampled_vote(ballots, "collection_id")


_PASSES = "SELECT CAST(floor(vec_id / 5) AS BIGINT) AS page_id, CASE WHEN confidence > 0.75 THEN 2 ELSE 1 END AS page_count, x1 AS cx, y1 AS cy FROM {q}"


@query(f"""SELECT a.page_id, round(agreement, 4) AS agreement, round(variance, 6) AS variance, agreement < 0.80 AS low_agreement, variance > 0.10 AS high_variance FROM (SELECT page_id, max(n) / sum(n) AS agreement FROM (SELECT page_id, page_count, count(*) AS n FROM ({_PASSES.format(q='v_quads')}) GROUP BY 1, 2) GROUP BY 1) a
JOIN (SELECT page_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE var_pop(cx / 80) + var_pop(cy / 60) END AS variance FROM ({_PASSES.format(q='v_quads')}) GROUP BY 1) b USING (page_id)""")
def a27_tta_stats(t: Tables):
    return gd.tta_stats(t.spark.sql(_PASSES, q=t.v_quads), 80.0, 60.0)


_METRICS = "SELECT material_type AS collection, avg(confidence) AS iou, avg(tta_agreement) AS split, avg(border_score) AS agreement, quantile_cont(skew_residual, 0.95) AS p95 FROM {q} WHERE vec_id % 2 = {r} GROUP BY 1"


@query(f"""SELECT c.collection, c.iou >= p.iou - 0.02 AND c.split >= p.split - 0.03 AND c.agreement >= p.agreement - 0.05 AND c.p95 <= p.p95 * 1.25 AS pass FROM ({_METRICS.format(q='v_quads', r=0)}) c JOIN ({_METRICS.format(q='v_quads', r=1)}) p USING (collection)""")
def a36_promotion_gates(t: Tables):
    new, old = (gd.collection_metrics(t.v_quads.where(f"vec_id % 2 = {r}").select(F.col("material_type").alias("collection"), F.col("confidence").alias("iou"), F.col("tta_agreement").alias("split"), F.col("border_score").alias("agreement"), F.col("skew_residual").alias("latency"))) for r in (0, 1))
    return gd.promotion_gates(new, old)


_AUDITS = "SELECT lineage_id, trim(coalesce(material_type, 'none')) AS material, created_at AS audited_at, NOT human_corrected AS auto_accepted, price > 300000 AS flagged FROM {l}"


@query(f"""SELECT week, material, count(*) AS n, round(count(*) FILTER (WHERE flagged) / count(*), 4) AS rate FROM (SELECT printf('%04dw%02d', isoyear(audited_at), week(audited_at)) AS week, material, flagged FROM ({_AUDITS.format(l='v_lineage')}) WHERE auto_accepted) GROUP BY ROLLUP (week, material) HAVING week IS NOT NULL""")
def a34_bad_accept_rate(t: Tables):
    return gd.bad_accept_rate(t.spark.sql(_AUDITS, l=t.v_lineage))


_DETS = "SELECT page_id, pos, type AS cls, confidence, x_min, x_max, (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy FROM {r} WHERE pos < 1 + page_id % 4"
_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, pos) AS r FROM ({_DETS.format(r='v_regions')})) WHERE r <= 2"


@query(f"""SELECT page_id, count(*) AS n, round(min(confidence), 6) AS confidence, arg_min(pos, cx) AS left_pos, CASE WHEN count(*) = 2 THEN arg_max(pos, cx) END AS right_pos, CASE WHEN count(*) = 2 THEN floor((arg_min(x_max, cx) + arg_max(x_min, cx)) / 2)::BIGINT END AS split_x FROM ({_TOP}) GROUP BY 1""")
def w12_top_two(t: Tables):
    return gd.top_two(t.spark.sql(_DETS, r=t.v_regions), "page_id")


@query(f"""SELECT page_id, n, CASE WHEN c < 0.52 THEN 'low_confidence' WHEN n = 1 THEN 'single' WHEN k < 2 THEN 'duplicate_class' WHEN dx > 1.5 * dy THEN 'horizontal' WHEN dy > 1.5 * dx THEN 'vertical' ELSE 'ambiguous' END AS state
FROM (SELECT page_id, count(*) AS n, count(DISTINCT cls) AS k, min(confidence) AS c, max(cx) - min(cx) AS dx, max(cy) - min(cy) AS dy FROM ({_TOP}) GROUP BY 1)""")
def w13_check_assignment(t: Tables):
    return gd.check_assignment(t.spark.sql(_DETS, r=t.v_regions), "page_id", 0.52)


_SCORES = "SELECT vec_id, r.rotation, CASE r.rotation WHEN 0 THEN skew_residual * 10 WHEN 90 THEN blur_score * 50 WHEN 180 THEN border_score * 50 ELSE foreground_coverage * 40 END AS score FROM {q} CROSS JOIN (SELECT 0 AS rotation UNION ALL SELECT 90 UNION ALL SELECT 180 UNION ALL SELECT 270) r"
_ORIENT = "SELECT vec_id, rotation, round(CASE WHEN second > 0 THEN best / second ELSE 0.0 END, 6) AS ratio, CASE WHEN second > 0 THEN best / second ELSE 0.0 END >= 1.2 AND best - second >= 15 AS confident FROM (SELECT vec_id, max(CASE WHEN k = 1 THEN rotation END) AS rotation, max(CASE WHEN k = 1 THEN score END) AS best, max(CASE WHEN k = 2 THEN score END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, rotation) AS k FROM ({s}) s) x GROUP BY vec_id) y"


@query(_ORIENT.format(s=_SCORES.format(q="v_quads")))
def w11_orientation(t: Tables):
    return o.orientation(t.spark.sql(_SCORES, q=t.v_quads), "vec_id")


_SIB = "SELECT page_id, job_id, page_number, sub_page_index, CAST(retry_count % 2 * 90 AS INT) AS rotation, qa_approved AS confident FROM {p} WHERE sub_page_index IS NOT NULL"


@query(f"""SELECT a.page_id, CASE WHEN b.page_id IS NOT NULL AND NOT a.confident AND b.confident AND b.rotation <> 0 THEN b.rotation ELSE a.rotation END AS rotation, coalesce(a.confident AND b.confident AND a.rotation <> b.rotation, false) AS conflict,
coalesce(NOT a.confident AND b.confident AND b.rotation <> 0, false) AS inherited FROM ({_SIB.format(p='v_pages')}) a LEFT JOIN ({_SIB.format(p='v_pages')}) b ON a.job_id = b.job_id AND a.page_number = b.page_number AND b.sub_page_index = 1 - a.sub_page_index""")
def c20_sibling_orientation(t: Tables):
    return o.sibling_orientation(t.spark.sql(_SIB, p=t.v_pages))


def _lines(t: Tables):
    return t.documents.select(F.floor(F.col("doc_id") / 4).alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"), "n_chars").select("page_id", "text", ((F.col("n_chars") % 130) / 100.0).cast("double").alias("conf"))


_TEXT = r"""(SELECT CAST(floor(doc_id / 4) AS BIGINT) AS page_id, count(*) AS n_boxes, sum(length(t)) AS n, sum(length(regexp_replace(t, '[^\p{Arabic}]', '', 'g'))) AS a, sum(length(regexp_replace(t, '[^\p{Latin}\p{Nd}]', '', 'g'))) AS l, avg(least(1.0, (n_chars % 130) / 100.0)) AS c
FROM (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY 1)"""


@query(f"SELECT page_id, CASE WHEN n = 0 THEN 0.0 ELSE round(a / n, 6) END AS arabic_ratio, CASE WHEN n = 0 THEN 0.0 ELSE round(l / n, 6) END AS latin_ratio, CASE WHEN n = 0 THEN 0.0 ELSE round((n - a - l) / n, 6) END AS garbage_ratio, n_boxes, (a + l)::BIGINT AS n_chars, round(c, 6) AS mean_conf FROM {_TEXT}")
def a28_script_evidence(t: Tables):
    return o.script_evidence(_lines(t))


@query(f"SELECT page_id, CASE WHEN a + l = 0 OR a = l THEN 'unresolved' WHEN a > l THEN 'rtl' ELSE 'ltr' END AS direction FROM {_TEXT}")
def a29_reading_direction(t: Tables):
    return o.reading_direction(o.script_evidence(_lines(t)), "page_id")


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{Arabic}]', '', 'g')) AS arabic, length(regexp_replace(text, '[^\p{Latin}\p{Nd}]', '', 'g')) AS latin, length(regexp_replace(text, '[\p{Latin}\p{Nd}\p{Arabic}]', '', 'g')) AS other FROM documents")
def x2_script_counts(t: Tables):
    return t.documents.select("doc_id", o.script_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("SELECT page_id, CASE WHEN n = 0 THEN 'no_blocks' WHEN NOT g THEN 'no_geometry' WHEN page_id % 6 = 0 THEN 'no_text' END AS empty_reason FROM (SELECT page_id, count(*) FILTER (WHERE confidence > 0.55) AS n, bool_or(x_max > 800) AS g FROM v_regions GROUP BY 1)")
def a38_layout_diagnostics(t: Tables):
    rows = t.v_regions.groupBy("page_id").agg(F.count_if(F.col("confidence") > 0.55).alias("n_blocks"), F.bool_or(F.col("x_max") > 800).alias("any_geometry")).withColumns({"n_pages": F.lit(1), "text_length": F.col("page_id") % 6})
    return o.layout_diagnostics(rows).select("page_id", "empty_reason")
