"""Queries of sources and continuous jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.operators import curation
from leafmill.operators.pages import TRANSITIONS
from leafmill.sources import readers, sinks
from leafmill.sources.shared import new_path
from leafmill.streaming import jobs
from leafmill.plans.registry import Tables, query
from leafmill.plans.views import VIEWS


def _stream(t: Tables, view: str):
    """The view over a stream of events instead of the table."""
    return t.spark.sql(VIEWS[view], events=jobs.read(t.spark, f"{t.sf_dir}/events.parquet"))


@query("""SELECT d.metric, seq, round(m, 9) AS window_mean, window_n, coalesce(b.std > 0 AND abs(m - b.mean) > 3.0 * b.std, false) AS drifted FROM (SELECT metric, seq, avg(value) OVER w AS m, count(*) OVER w AS window_n FROM v_observations
WINDOW w AS (PARTITION BY metric ORDER BY ts, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) d LEFT JOIN v_baselines b ON b.metric = d.metric""")
def t1_drift_stream(t: Tables):
    return jobs.drift(_stream(t, "v_observations"), t.v_baselines).withColumn("window_mean", F.round("window_mean", 9))


_KNOWN = ("drift_alert_persistence", "escalation_rate_anomaly", "auto_accept_rate_collapse", "structural_agreement_degradation")


@query("""WITH RECURSIVE e AS (SELECT trigger_type AS kind, fired_at, min(trigger_id) AS trigger_id FROM v_triggers WHERE trigger_type <> 'unlisted_trigger' AND status <> 'resolved' GROUP BY 1, 2),
k AS (SELECT kind, min(fired_at) AS fired_at FROM e GROUP BY 1 UNION ALL SELECT k.kind, (SELECT min(fired_at) FROM e WHERE e.kind = k.kind AND e.fired_at >= k.fired_at + INTERVAL 7 DAY) FROM k WHERE k.fired_at IS NOT NULL)
SELECT v.trigger_id, CASE WHEN trigger_type = 'unlisted_trigger' THEN 'skipped_unknown' WHEN status = 'resolved' THEN 'skipped_resolved' WHEN x.trigger_id IS NOT NULL THEN 'recorded' ELSE 'skipped_cooldown' END AS outcome FROM v_triggers v LEFT JOIN (SELECT e.trigger_id FROM k JOIN e USING (kind, fired_at)) x ON x.trigger_id = v.trigger_id""")
def t2_trigger_stream(t: Tables):
    return jobs.run(jobs.triggers(_stream(t, "v_triggers"), _KNOWN), "triggers")


_COUNTER = "SELECT concat('c', CAST(user_id % 5 AS STRING)) AS series, ts, CAST(event_id % 500 AS DOUBLE) AS value FROM {e}"


@query(f"""WITH g AS (SELECT series, ts, CASE WHEN p IS NULL THEN 0.0 WHEN value >= p THEN value - p ELSE value END AS gain FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS p FROM ({_COUNTER.format(e='events')})))
SELECT series, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS window_start, round(sum(gain), 6) AS increase FROM g CROSS JOIN range(3) r(i) GROUP BY 1, 2""")
def t3_counter_increase(t: Tables):
    return jobs.counter_increase(t.spark.sql(_COUNTER, e=jobs.read(t.spark, f"{t.sf_dir}/events.parquet")), "3 hours", "1 hour")


_LES = (10.0, 25.0, 50.0, 100.0, 1e9)


@query(f"""SELECT series, round(lo + (le - lo) * (0.5 * total - below) / (count - below), 6) AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY le) AS r FROM (SELECT *, coalesce(lag(count) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0.0) AS lo, max(count) OVER (PARTITION BY series) AS total
FROM (SELECT e.event_type AS series, b.le, count(CASE WHEN e.value <= b.le THEN 1 END) AS count FROM events e CROSS JOIN (SELECT unnest([10.0, 25.0, 50.0, 100.0, 1e9])::DOUBLE AS le) b GROUP BY 1, 2) WINDOW w AS (PARTITION BY series ORDER BY le)) WHERE count >= 0.5 * total) WHERE r = 1""")
def t4_histogram_quantile(t: Tables):
    events = jobs.read(t.spark, f"{t.sf_dir}/events.parquet").select(F.col("event_type").alias("series"), "value")
    return jobs.histogram_quantile(jobs.long_buckets(jobs.run(jobs.histogram(events, _LES), "histogram", ["series"]), _LES), 0.5)


@query("SELECT date_trunc('hour', ts) AS window_start, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*) FILTER (WHERE event_type <> 'view'), 1), 6) AS ratio, count(*) FILTER (WHERE event_type = 'error') / greatest(count(*) FILTER (WHERE event_type <> 'view'), 1) > 0.25 AS firing FROM events GROUP BY 1")
def t5_ratio_alert(t: Tables):
    events = jobs.read(t.spark, f"{t.sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    found = jobs.run(jobs.ratio_counts(events, F.col("event_type") == "error", F.col("event_type") != "view", "1 hour"), "ratio", ["window_start"])
    return jobs.ratio_alert(found, 0.25)


@query("""WITH m AS (SELECT event_type AS series, ts, bool_and(coalesce(value > 15, false)) AS firing FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, lag(ts) OVER w AS p, lag(firing) OVER w AS pf, lead(ts) OVER w AS n FROM m WINDOW w AS (PARTITION BY series ORDER BY ts)),
r AS (SELECT *, sum(CASE WHEN pf AND ts <= p + INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS run FROM g WHERE firing),
e AS (SELECT series, min(ts) AS since, max(ts) AS last, max(least(ts + INTERVAL 1 HOUR, coalesce(n, ts + INTERVAL 1 HOUR))) AS until, bool_or(n IS NULL) AS open FROM r GROUP BY series, run)
SELECT series, since, since + INTERVAL 10 MINUTE AS fired_at FROM e WHERE since + INTERVAL 10 MINUTE < until AND (NOT open OR since + INTERVAL 10 MINUTE <= greatest(last, (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)))""")
def t6_alert_stream(t: Tables):
    ticks = jobs.read(t.spark, f"{t.sf_dir}/events.parquet").select(F.col("event_type").alias("series"), "ts", (F.col("value") > 15).alias("firing"))
    return jobs.run(jobs.alerts(ticks, 600, 3600), "alerts")


_MOVES = ", ".join(f"'{a}>{b}'" for a, to in TRANSITIONS.items() for b in to)
_STATES = "['queued', 'preprocessing', 'layout_detection', 'accepted', 'pending_human_correction', 'semantic_norm']"


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS r FROM (SELECT 'p-' || user_id % 200 AS page_id, event_id AS seq, {_STATES}[event_id % 6 + 1] AS expected, {_STATES}[(event_id + user_id) % 6 + 1] AS target FROM events)),
f AS (SELECT page_id, 0::BIGINT AS r, NULL::BIGINT AS seq, 'queued' AS state, false AS applied FROM n WHERE r = 1
UNION ALL SELECT page_id, r, seq, CASE WHEN ok THEN target ELSE state END, ok FROM (SELECT n.*, f.state, n.expected = f.state AND f.state || '>' || n.target IN ({_MOVES}) AS ok FROM f JOIN n ON n.page_id = f.page_id AND n.r = f.r + 1))
SELECT page_id, seq, applied, state, state IN ('accepted', 'review', 'failed') AS completed FROM f WHERE r > 0""")
def t7_page_state_stream(t: Tables):
    states = F.array(*[F.lit(s) for s in ("queued", "preprocessing", "layout_detection", "accepted", "pending_human_correction", "semantic_norm")])
    events = jobs.read(t.spark, f"{t.sf_dir}/events.parquet").select(F.concat(F.lit("p-"), (F.col("user_id") % 200).cast("string")).alias("page_id"), F.col("event_id").alias("seq"), F.get(states, F.col("event_id") % 6).alias("expected"), F.get(states, (F.col("event_id") + F.col("user_id")) % 6).alias("target"), "ts")
    return jobs.run(jobs.page_states(events), "page-states")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def t8_dedupe_stream(t: Tables):
    rows = jobs.read(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "ts")
    return jobs.run(jobs.dedupe(rows, "user_id", "ts", "60 days").select("user_id", F.lit(1).cast("long").alias("n")), "dedupe")


@query("""SELECT task_id::VARCHAR AS task_id, ts AS stale_from, ts + INTERVAL 1 DAY AS stale_at FROM (SELECT user_id AS task_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)
WHERE n > ts + INTERVAL 1 DAY OR (n IS NULL AND ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))""")
def t9_stale_stream(t: Tables):
    rows = jobs.read(t.spark, f"{t.sf_dir}/events.parquet").select(F.col("user_id").alias("task_id"), "ts")
    return jobs.run(jobs.stale_tasks(rows, 86_400), "stale")


_STAGE = "CASE WHEN service_name IN ('geometry_a','geometry_b') THEN 'preprocessing' WHEN service_name = 'rectify' THEN 'rectification' WHEN service_name IN ('layout_a','layout_b') THEN 'layout' ELSE 'classification' END"


@query(f"SELECT date_trunc('hour', invoked_at) AS window_start, {_STAGE} AS stage, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, round(count(*) FILTER (WHERE status = 'success') / count(*), 4) AS success_rate FROM v_invocations GROUP BY 1, 2")
def t10_stage_health_stream(t: Tables):
    return jobs.run(jobs.stage_health(_stream(t, "v_invocations")), "health", ["window_start", "stage"])


@query("SELECT count(*) AS calls, round(count(*) FILTER (WHERE status = 'success') / count(*), 4) AS success_rate FROM v_invocations")
def t11_kpi_stream(t: Tables):
    return jobs.run(jobs.kpi(_stream(t, "v_invocations")), "kpi", [])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 400000")
def s1_table_scan(t: Tables):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    return t.spark.read.schema(schema).parquet(f"{t.sf_dir}/orders.parquet").where("o_totalprice > 400000").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT vec_id, (vec_id % 3)::INT AS class_id, 2 AS n_points, round(x1::DOUBLE, 4) AS first_x, round(y2, 4) AS last_y FROM v_quads WHERE vec_id % 5 <> 0")
def s4_seg_labels(t: Tables):
    value = F.when(F.col("vec_id") % 5 == 0, "1 0.5 0.5").otherwise(F.concat_ws(" ", (F.col("vec_id") % 3).cast("string"), *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")], F.lit(" ")))
    rows = readers.seg_labels(t.v_quads.select("vec_id", value.alias("value")))
    return rows.select("vec_id", "class_id", F.size("points").alias("n_points"), F.round(F.get("points", 0)["x"], 4).alias("first_x"), F.round(F.element_at("points", -1)["y"], 4).alias("last_y"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN 'reject' ELSE 'good' END AS state, CASE WHEN vec_id % 5 <> 1 THEN round(x1 - x2 / 2, 3) END AS left_x, CASE WHEN vec_id % 5 <> 1 THEN round(y4, 3) END AS last_y FROM v_quads WHERE vec_id % 5 <> 0")
def s5_pose_labels(t: Tables):
    c = F.col("vec_id") % 5
    full = F.concat_ws(" ", F.lit("2"), *[F.col(x).cast("string") for x in ("x1", "y1", "x2", "y2")], *[x for i in range(1, 5) for x in (F.col(f"x{i}").cast("string"), F.col(f"y{i}").cast("string"), F.lit("2"))])
    good, bad = readers.pose_labels(t.v_quads.select("vec_id", F.when(c == 0, F.concat(F.lit("# "), full)).when(c == 1, "1 2 3").otherwise(full).alias("value")))
    return good.select("vec_id", F.lit("good").alias("state"), F.round(F.get("box", 0), 3).alias("left_x"), F.round(F.get(F.get("keypoints", 3), 1), 3).alias("last_y")).unionByName(bad.select("vec_id", F.lit("reject").alias("state")), allowMissingColumns=True)


@query("SELECT CASE WHEN pos = 3 THEN 'unknown_label' WHEN pos = 4 THEN 'bad_score' WHEN pos = 5 THEN 'bad_coordinate' WHEN pos = 6 THEN 'malformed' ELSE 'kept' END AS reason, count(*) AS n FROM v_regions GROUP BY 1")
def s8_flatten_detections(t: Tables):
    label = F.when(F.col("pos") == 3, "Odd Thing").when(F.col("pos") == 6, " ").otherwise(F.concat(F.lit(" "), F.initcap(F.replace("type", F.lit("_"), F.lit(" ")))))
    coords = F.when(F.col("pos") == 5, F.array(F.lit("x"), F.lit("1"))).otherwise(F.array(*[F.col(c).cast("string") for c in ("x_min", "y_min", "x_max", "y_max")]))
    box = F.struct(label.alias("label"), F.when(F.col("pos") == 4, "NaN").otherwise(F.col("confidence").cast("string")).alias("score"), F.when(F.col("pos") % 2 == 0, coords).alias("coordinate"), F.when(F.col("pos") % 2 == 1, coords).alias("bbox"))
    boxes = t.v_regions.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", box.alias("b")))).alias("a")).select("page_id", F.transform("a", lambda x: x["b"]).alias("boxes"))
    raw = boxes.select("page_id", F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct("boxes"))).otherwise(F.to_json(F.struct(F.struct("boxes").alias("res")))).alias("raw"))
    return readers.flatten_detections(raw, ["text_block", "title", "table", "image", "caption"]).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT page_id, 1 AS tier, CASE pos % 4 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'PARAGRAPH' ELSE 'TABLE' END AS type, CASE WHEN pos % 5 = 0 THEN 0.5 ELSE confidence END AS confidence, x_min, y_max FROM v_regions WHERE page_id % 3 = 0 AND pos % 4 <> 3
UNION ALL SELECT page_id, 2, CASE pos % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'LIST_ITEM' WHEN 2 THEN 'FIGURE' ELSE CASE WHEN pos % 2 = 0 THEN 'SECTION_HEADER' ELSE 'PARAGRAPH' END END, 0.9, CASE WHEN pos % 3 = 1 THEN x_min + 1 ELSE x_min END, y_max FROM v_regions WHERE page_id % 3 = 1 AND (pos % 3 <> 1 OR page_id % 2 = 0)
UNION ALL SELECT page_id, 3, 'PARAGRAPH', confidence, CASE WHEN page_id % 2 = 0 THEN x_min ELSE x_min + 2 END, y_max FROM v_regions WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 3, 'TABLE', 0.5, x_min, y_max FROM v_regions WHERE page_id % 3 = 2 AND pos % 2 = 0
UNION ALL SELECT page_id, 3, CASE WHEN pos % 2 = 0 THEN 'PHOTO' ELSE 'FIGURE' END, confidence, x_min, y_max FROM v_regions WHERE page_id % 3 = 2 AND pos % 3 = 0)
SELECT page_id, tier, type, count(*) AS n, round(sum(confidence), 6) AS confidence, round(min(x_min), 4) AS x_min, round(max(y_max), 4) AS y_max FROM e GROUP BY 1, 2, 3""")
def s9_flatten_layout_docs(t: Tables):
    pos, page = F.col("pos"), F.col("page_id")

    def poly(shift: float = 0.0, there: Column | None = None) -> Column:
        points = F.array(*[F.struct((F.col(x) + shift).alias("x"), F.col(y).alias("y")) for x, y in (("x_min", "y_min"), ("x_max", "y_max"))])
        return (points if there is None else F.when(there, points)).alias("poly")

    def gathered(item: Column, which: Column | None = None) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(which if which is not None else F.lit(True), F.struct("pos", item.alias("e"))))), lambda x: x["e"])

    entity = F.struct(F.when(pos % 4 == 0, "TITLE").when(pos % 4 > 1, "TABLE").alias("type"), F.when(pos % 5 != 0, F.col("confidence")).alias("confidence"), poly(there=pos % 4 != 3))
    kind = F.when(pos % 5 == 0, "table").when(pos % 5 == 1, "list").when(pos % 5 == 2, "image").otherwise("text")
    block = F.struct(kind.alias("kind"), F.when(pos % 2 == 0, "Heading").alias("subtype"), F.concat(F.lit(" "), "type").alias("text"), poly(there=pos % 3 != 1))
    lists = t.v_regions.groupBy("page_id").agg(
        gathered(entity).alias("entities"), gathered(block).alias("blocks"),
        gathered(F.struct("confidence", poly(1.0)), (page % 2 == 0) | (pos == 0)).alias("spare"),  # odd pages have too few to stand in
        gathered(F.struct("confidence", poly(there=page % 2 == 0))).alias("page_blocks"), gathered(F.struct(F.lit(None).cast("double").alias("confidence"), poly()), pos % 2 == 0).alias("tables"),
        gathered(F.struct("confidence", poly(2.0))).alias("paragraphs"), gathered(F.struct(F.when(pos % 2 == 0, "photo").alias("type"), "confidence", poly()), pos % 3 == 0).alias("visual_elements"),
    )
    tier = page % 3
    pages = F.when(tier == 1, F.array(F.struct(F.col("spare").alias("paragraphs")))), F.when(tier == 2, F.array(F.struct(F.col("page_blocks").alias("blocks"), "tables", "paragraphs", "visual_elements")))
    doc = F.when(tier == 0, F.to_json(F.struct("entities"))).when(tier == 1, F.to_json(F.struct(F.col("blocks").alias("layout_blocks"), pages[0].alias("pages")))).otherwise(F.to_json(F.struct(pages[1].alias("pages"))))
    rows = readers.flatten_layout_doc(lists.select("page_id", doc.alias("doc")))
    return rows.groupBy("page_id", "tier", "type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.min("x_min"), 4).alias("x_min"), F.round(F.max("y_max"), 4).alias("y_max"))


@query("SELECT trigger_id, trigger_type, CASE WHEN trigger_id % 3 = 0 THEN 0.0 ELSE trigger_id / 4 END AS metric_value, date_trunc('second', fired_at) AS starts_at FROM v_triggers")
def s10_parse_alerts(t: Tables):
    labels = F.struct("trigger_type", F.lit("m").alias("metric_name"), F.when(F.col("trigger_id") % 3 == 0, "n/a").otherwise((F.col("trigger_id") / 4).cast("string")).alias("metric_value"), F.lit("1").alias("threshold_value"))
    alert = F.struct(F.lit("firing").alias("status"), labels.alias("labels"), F.date_format("fired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startsAt"))
    raw = t.v_triggers.select("trigger_id", F.to_json(F.struct(F.array(alert).alias("alerts"))).alias("raw"))
    return readers.parse_alerts(raw).select("trigger_id", "trigger_type", "metric_value", "starts_at")


@query("SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, 0 AS rejected FROM v_baselines WHERE metric NOT LIKE 'layout%' UNION ALL SELECT metric, NULL, NULL, 1 FROM v_baselines WHERE metric LIKE 'layout%'")
def s11_parse_baselines(t: Tables):
    body = F.when(F.col("metric").startswith("layout"), F.to_json(F.struct("mean"))).otherwise(F.to_json(F.struct("mean", "std")))
    raw = t.v_baselines.select(F.concat(F.lit('{"_note": "x", "'), "metric", F.lit('": '), body, F.lit("}")).alias("raw"))
    good, bad = readers.parse_baselines(raw)
    return good.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.lit(0).alias("rejected")).unionByName(bad.withColumn("rejected", F.lit(1)), allowMissingColumns=True)


@query("""SELECT material_type AS material, f.field, CASE WHEN f.field = 'split' THEN 0.8 WHEN material_type = 'book' AND f.field = 'area_min' THEN 0.2 WHEN material_type = 'microfilm' AND f.field = 'area_max' THEN 0.9 ELSE f.value END AS value
FROM (SELECT DISTINCT material_type FROM v_jobs) CROSS JOIN (SELECT 'split' AS field, 0.75::DOUBLE AS value UNION ALL SELECT 'area_min', 0.15 UNION ALL SELECT 'area_max', 1.0 UNION ALL SELECT 'variance', 0.12) f""")
def s12_policy_thresholds(t: Tables):
    # newspapers turn the bounds round and archival documents leave [0, 1]: both get the defaults back
    latest = '{"split": 0.8, "area_min": {"book": 0.2, "newspaper": 0.7, "archival_document": -0.1}, "area_max": {"newspaper": 0.6, "microfilm": 0.9, "book": "bad"}, "variance": "oops"}'
    last = t.v_models.agg(F.max("created_at").alias("m"))
    policies = t.v_models.crossJoin(F.broadcast(last)).select(F.col("version_tag").alias("version"), F.col("created_at").alias("applied_at"), F.when(F.col("created_at") == F.col("m"), latest).otherwise('{"split": 0.1}').alias("config"))
    fields = t.spark.createDataFrame([("split", 0.75), ("area_min", 0.15), ("area_max", 1.0), ("variance", 0.12)], "field string, value double")
    defaults = t.v_jobs.select(F.col("material_type").alias("material")).distinct().crossJoin(F.broadcast(fields))
    return readers.checked_bounds(readers.policy_thresholds(policies, defaults), defaults, "area_min", "area_max")


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_linenumber > 6)) AS jobs,
(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_linenumber > 6)) AS pages, (SELECT count(DISTINCT l_orderkey) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_linenumber > 6)) AS rejected""")
def s16_ingest_jobs(t: Tables):
    sub = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("job_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("page_number"), F.lit("u").alias("uri"))).alias("pages")).withColumn("material_type", F.lit("book"))
    js, ps, bad = readers.ingest_jobs(sub, most_pages=6)
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(js, "jobs").crossJoin(F.broadcast(one(ps, "pages"))).crossJoin(F.broadcast(one(bad, "rejected")))


@query(f"""SELECT family || '/' || material || '/' || part AS place, count(*) AS n FROM (SELECT family, CASE WHEN lower(trim(material_type)) IN ('book','newspaper','microfilm') THEN lower(trim(material_type)) WHEN lower(trim(material_type)) = 'archival_document' THEN 'microfilm' ELSE 'book' END AS material,
CASE WHEN ('0x' || substr(sha1('42:' || job_id), 1, 8))::BIGINT % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM v_lineage CROSS JOIN (VALUES ('segmentation'), ('pose')) f(family) WHERE human_corrected AND acceptance_decision = 'accepted' AND CASE family WHEN 'pose' THEN geometry_b_used ELSE geometry_a_used END
AND (coalesce(corr_w > 0 AND corr_h > 0, false) OR coalesce(down_w > 0 AND down_h > 0, false))) GROUP BY 1""")
def s13_training_set(t: Tables):
    kept, _ = curation.corrected_set(t.v_lineage, "all")
    path = new_path(t.spark, "training-set")
    sinks.write_training_set(kept.withColumn("uri", F.coalesce("output_uri", "otiff_uri")), path)
    back = t.spark.read.schema("value string, family string, material string, part string").text(f"{path}/labels")
    return back.groupBy(F.concat_ws("/", "family", "material", "part").alias("place")).agg(F.count("*").alias("n"))


@query("SELECT page_id, count(*) AS n, round(sum(confidence), 6) AS confidence FROM v_regions GROUP BY 1")
def s14_layout_documents(t: Tables):
    path = new_path(t.spark, "layout")
    sinks.write_layout(t.v_regions, path)
    rows = t.spark.read.text(path).select(F.from_json("value", "page_id long, regions array<struct<confidence:double>>").alias("d")).select("d.page_id", F.explode("d.regions.confidence").alias("c"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.sum("c"), 6).alias("confidence"))


@query("SELECT service_name, count(*) AS n, count(*) FILTER (WHERE stage = 'production') AS approved FROM v_models GROUP BY 1")
def s3_dataset_registry(t: Tables):
    path = new_path(t.spark, "registry")
    rows = t.v_models.select(F.col("version_tag").alias("version"), F.col("service_name").alias("family"), F.lit("u").alias("uri"), F.sha1(F.col("version_tag").cast("binary")).alias("checksum"), (F.col("stage") == "production").alias("approved"), F.col("created_at").cast("string").alias("created_at"))
    for name in ("approved", "others", "approved"):  # a batch that comes twice counts once
        readers.append_registry(rows.where("approved" if name == "approved" else "NOT approved"), path, name)
    return readers.registry(t.spark, path).groupBy(F.col("family").alias("service_name")).agg(F.count("*").alias("n"), F.count_if("approved").alias("approved"))


#: One row a file; tasks move their files to their place themselves, the driver does not do it for all.
_MANY_FILES = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}


def _tasks(t: Tables) -> int:
    """Writers of many small files: a file costs far more than its bytes, by which Spark would put them into few tasks."""
    return 4 * t.spark.sparkContext.defaultParallelism


_CASES = "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'geometry_a' WHEN 1 THEN 'geometry_b' ELSE 'classify' END AS model, material_type, round(confidence, 4) AS confidence_min FROM {q}"


@query(f"SELECT 'c-' || vec_id AS case_id, material_type, confidence_min FROM ({_CASES.format(q='v_quads')}) WHERE model = 'geometry_b' AND material_type = 'book' AND vec_id % 7 <> 0")
def s2_golden_cases(t: Tables):
    """Case files in folders of a hundred, where names repeat, and a manifest for each folder that leaves some of them out."""
    root = new_path(t.spark, "golden")
    rows = t.spark.sql(_CASES, q=t.v_quads)
    case = F.struct(F.concat(F.lit("c-"), "vec_id").alias("case_id"), "model", "material_type", F.struct("confidence_min").alias("thresholds"))
    cases = rows.select(F.floor(F.col("vec_id") / 100).alias("lot"), F.regexp_replace(F.to_json(case), ",", ",\n  ").alias("value"))
    cases.repartition(_tasks(t), "lot").sortWithinPartitions("lot").write.options(**_MANY_FILES).partitionBy("lot").text(f"{root}/cases")
    written = t.spark.read.schema("value string, lot long").text(f"{root}/cases", wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    listed = written.select("lot", "file", field("case_id"), field("model"), field("material_type")).where(F.substring("case_id", 3, 20).cast("long") % 7 != 0)
    entry = F.struct("case_id", "model", "material_type", F.concat(F.lit("./cases/lot="), "lot", F.lit("/"), "file").alias("annotation_path"))
    manifests = listed.groupBy("lot").agg(F.to_json(F.struct(F.collect_list(entry).alias("cases"))).alias("value"))  # at most a hundred entries each
    manifests.select("value").write.mode("append").options(**_MANY_FILES).text(root)
    found = readers.golden_cases(t.spark, f"{root}/*.txt", f"{root}/cases", model="geometry_b", material="book")
    return found.select("case_id", "material_type", F.col("thresholds.confidence_min").alias("confidence_min"))


_PAGE_FILE = "coalesce(html, '') || chr(10)"


@query(f"SELECT sha256({_PAGE_FILE}) AS hash, strlen({_PAGE_FILE})::BIGINT AS byte_size, count(*) AS n_files, count(*) FILTER (WHERE page_id % 10 = 3) AS n_changed FROM pages GROUP BY 1, 2")
def s6_artifacts(t: Tables):
    """Pages as files in the shared folder; the recorded hash of every tenth is another one.

    A folder holds a hundred files of pages with one last digit, so it takes no glob over a folder
    for each page to find them, and every file is read and hashed once.
    """
    root, hashes = new_path(t.spark, "artifacts"), new_path(t.spark, "artifact-hashes")
    lot = F.floor(F.col("page_id") / 1000) * 10 + F.col("page_id") % 10
    t.pages.select(lot.alias("lot"), F.coalesce("html", F.lit("")).alias("value")).repartition(_tasks(t), "lot").write.options(**_MANY_FILES).partitionBy("lot").text(root)
    found = readers.artifacts(t.spark, root)
    found.write.parquet(hashes)
    found = t.spark.read.schema(found.schema).parquet(hashes)
    page = F.regexp_extract("uri", "lot=(-?[0-9]+)", 1).try_cast("long")
    recorded = found.select("uri", F.when(page % 10 == 3, F.sha2(F.lit("earlier"), 256)).otherwise(F.col("hash")).alias("hash"))
    changed = readers.hash_mismatches(found, recorded).select("uri", F.lit(1).alias("changed"))
    return found.join(changed, "uri", "left").groupBy("hash", "byte_size").agg(F.count("*").alias("n_files"), F.count("changed").alias("n_changed"))


def _widest():
    """A stand-in backend: the box's own area decides its class."""

    def run(batch):
        area = (batch.x_max - batch.x_min) * (batch.y_max - batch.y_min)
        return batch[["page_id", "pos"]].assign(label=area.gt(20_000).map({True: "large", False: "small"}))

    return run


@query("SELECT page_id, pos, CASE WHEN (x_max - x_min) * (y_max - y_min) > 20000 THEN 'large' ELSE 'small' END AS label FROM v_regions")
def x1_detector_hook(t: Tables):
    return sinks.detect(t.v_regions, _widest, "page_id long, pos int, label string")
