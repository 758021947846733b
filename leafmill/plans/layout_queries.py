"""Queries of geometry gates and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import geometry as g
from leafmill.operators import gates, layout
from leafmill.plans.registry import Tables, query

_A, _B = "v_regions", "v_regions_b"
_IOU_FN = "CASE WHEN least({a}x_max,{b}x_max) > greatest({a}x_min,{b}x_min) AND least({a}y_max,{b}y_max) > greatest({a}y_min,{b}y_min) THEN (least({a}x_max,{b}x_max) - greatest({a}x_min,{b}x_min)) * (least({a}y_max,{b}y_max) - greatest({a}y_min,{b}y_min)) / (({a}x_max-{a}x_min)*({a}y_max-{a}y_min) + ({b}x_max-{b}x_min)*({b}y_max-{b}y_min) - (least({a}x_max,{b}x_max) - greatest({a}x_min,{b}x_min)) * (least({a}y_max,{b}y_max) - greatest({a}y_min,{b}y_min))) ELSE 0.0 END"
_IOU = _IOU_FN.format(a="a.", b="b.")


def corners() -> list[g.Corner]:
    return [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(1, 5)]


@query(f"SELECT a.page_id, a.pos AS i, b.pos AS j, round({_IOU}, 6) AS iou FROM {_A} a JOIN {_B} b ON a.page_id = b.page_id AND a.type = b.type WHERE {_IOU} >= 0.5")
def j16_iou_pairs(t: Tables):
    return layout.pairs(t.v_regions, t.v_regions_b, 0.5).select("page_id", "i", "j", F.round("iou", 6).alias("iou"))


@query(f"SELECT a.page_id, a.pos AS i, round(coalesce(max({_IOU}), 0), 6) AS iou FROM {_A} a LEFT JOIN {_B} b ON a.page_id = b.page_id AND a.type = b.type GROUP BY 1, 2")
def j17_best_match(t: Tables):
    return layout.best_match(t.v_regions, t.v_regions_b, ["page_id", "type"]).select("page_id", "i", F.round("iou", 6).alias("iou"))


@query(f"""SELECT page_id, bool_and(abs(coalesce(n_a, 0) - coalesce(n_b, 0)) <= 1) AS histogram_match FROM (SELECT page_id, type, count(*) AS n_a FROM {_A} GROUP BY 1, 2) FULL JOIN (SELECT page_id, type, count(*) AS n_b FROM {_B} GROUP BY 1, 2) USING (page_id, type) GROUP BY 1""")
def j18_type_histogram(t: Tables):
    return layout.type_histogram(t.v_regions, t.v_regions_b)


@query(f"SELECT DISTINCT page_id, type FROM (SELECT page_id, type FROM {_A} UNION SELECT page_id, type FROM {_B})")
def u3_type_keys(t: Tables):
    return t.v_regions.select("page_id", "type").union(t.v_regions_b.select("page_id", "type")).distinct()


_STRUCT_IOU = _IOU_FN.format(a="k.", b="n.")


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, type ORDER BY confidence DESC, pos) AS r FROM (SELECT * FROM v_regions UNION ALL SELECT page_id, pos + 100, type, x_min, y_min, x_max, y_max, confidence FROM v_regions_b)),
f AS (SELECT page_id, type, 0::BIGINT AS r, NULL::INT AS pos, 0.0::DOUBLE AS confidence, false AS stays, list_filter([{{'x_min': 0.0::DOUBLE, 'y_min': 0.0::DOUBLE, 'x_max': 0.0::DOUBLE, 'y_max': 0.0::DOUBLE}}], lambda x: false) AS kept FROM n WHERE r = 1
UNION ALL SELECT page_id, type, r, pos, confidence, stays, CASE WHEN stays THEN list_append(kept, {{'x_min': x_min, 'y_min': y_min, 'x_max': x_max, 'y_max': y_max}}) ELSE kept END FROM
(SELECT n.*, f.kept, len(list_filter(f.kept, lambda k: {_STRUCT_IOU} > 0.5)) = 0 AS stays FROM f JOIN n ON n.page_id = f.page_id AND n.type = f.type AND n.r = f.r + 1))
SELECT page_id, type, pos, round(confidence, 6) AS confidence FROM f WHERE stays""")
def c9_nms(t: Tables):
    return layout.nms(t.v_regions.unionByName(t.v_regions_b.withColumn("pos", F.col("pos") + 100))).select("page_id", "type", "pos", F.round("confidence", 6).alias("confidence"))


_MATCHED = f"""n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY iou DESC, i, j) AS r FROM (SELECT a.page_id, a.pos AS i, b.pos AS j, {_IOU} AS iou FROM v_regions a JOIN v_regions_b b ON a.page_id = b.page_id AND a.type = b.type WHERE {_IOU} >= 0.5)),
f AS (SELECT page_id, 0::BIGINT AS r, NULL::INT AS i, NULL::INT AS j, 0.0::DOUBLE AS iou, false AS fresh, []::INT[] AS si, []::INT[] AS sj FROM n WHERE r = 1
UNION ALL SELECT page_id, r, i, j, iou, fresh, CASE WHEN fresh THEN list_append(si, i) ELSE si END, CASE WHEN fresh THEN list_append(sj, j) ELSE sj END FROM
(SELECT n.*, f.si, f.sj, NOT list_contains(f.si, n.i) AND NOT list_contains(f.sj, n.j) AS fresh FROM f JOIN n ON n.page_id = f.page_id AND n.r = f.r + 1)),
g AS (SELECT page_id, i, j, iou FROM f WHERE fresh)"""


@query(f"WITH RECURSIVE {_MATCHED} SELECT page_id, i, j, round(iou, 6) AS iou FROM g")
def c10_greedy_match(t: Tables):
    return layout.greedy_match(t.v_regions, t.v_regions_b).select("page_id", "i", "j", F.round("iou", 6).alias("iou"))


@query(f"""WITH RECURSIVE {_MATCHED},
h AS (SELECT page_id, bool_and(abs(coalesce(n_a, 0) - coalesce(n_b, 0)) <= 1) AS same FROM (SELECT page_id, type, count(*) AS n_a FROM v_regions GROUP BY 1, 2) FULL JOIN (SELECT page_id, type, count(*) AS n_b FROM v_regions_b GROUP BY 1, 2) USING (page_id, type) GROUP BY 1),
c AS (SELECT a.page_id, a.n_a, coalesce(b.n_b, 0) AS n_b, coalesce(m.matched, 0) AS matched, coalesce(m.mean_iou, 0.0) AS mean_iou, coalesce(h.same, false) AND b.n_b IS NOT NULL AS histogram_match, b.n_b IS NULL AS single_model
FROM (SELECT page_id, count(*) AS n_a FROM v_regions GROUP BY 1) a LEFT JOIN (SELECT page_id, count(*) AS n_b FROM v_regions_b GROUP BY 1) b USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS matched, avg(iou) AS mean_iou FROM g GROUP BY 1) m USING (page_id) LEFT JOIN h USING (page_id))
SELECT page_id, n_a, n_b, matched, round(mean_iou, 6) AS mean_iou, histogram_match, single_model, matched / greatest(n_a, n_b) >= 0.7 AND histogram_match AS agreed,
CASE WHEN single_model THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.6 * (matched / greatest(n_a, n_b)) + 0.2 * mean_iou + 0.2 * histogram_match::INT)), 6) END AS consensus FROM c""")
def a22_consensus(t: Tables):
    return layout.consensus(t.v_regions, t.v_regions_b)


@query("""SELECT page_id, pos, round(greatest(0.0, least(1.0, confidence * CASE WHEN (x_max - x_min) * (y_max - y_min) < 0.01 * 1000.0 * 1400.0 THEN 0.8 ELSE 1.0 END * CASE WHEN x_min <= 50 OR x_max >= 950 OR y_min <= 70 OR y_max >= 1330 THEN 0.9 ELSE 1.0 END)), 6) AS confidence FROM v_regions""")
def c11_recalibrate(t: Tables):
    return layout.recalibrate(t.v_regions, 1000.0, 1400.0).select("page_id", "pos", F.round("confidence", 6).alias("confidence"))


@query("SELECT page_id, pos, 'r' || row_number() OVER (PARTITION BY page_id ORDER BY y_min, x_min, pos) AS id FROM v_regions")
def w8_renumber(t: Tables):
    return layout.renumber(t.v_regions).select("page_id", "pos", "id")


_CLUSTERS = "SELECT page_id, x, sum(gap) OVER (PARTITION BY page_id ORDER BY x) AS cluster FROM (SELECT page_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY page_id ORDER BY x) > 80.0 THEN 1 ELSE 0 END AS gap FROM (SELECT page_id, (x_min + x_max) / 2 AS x FROM v_regions WHERE type = 'text_block'))"


@query(f"SELECT page_id, round(x, 6) AS x, cluster FROM ({_CLUSTERS})")
def w9_cluster_1d(t: Tables):
    text = t.v_regions.where("type = 'text_block'").select("page_id", ((F.col("x_min") + F.col("x_max")) / 2).alias("x"))
    return layout.cluster_1d(text, "page_id", "x", F.lit(80.0)).select("page_id", F.round("x", 6).alias("x"), "cluster")


@query(f"""SELECT page_id, count(*) AS column_count, coalesce(string_agg(round(cut * 10000)::BIGINT::VARCHAR, ',' ORDER BY cut), '') AS cuts FROM (SELECT page_id, greatest(0.0, least(1.0, (m + lead(m) OVER (PARTITION BY page_id ORDER BY m)) / 2 / 1000.0)) AS cut0, CASE WHEN lead(m) OVER (PARTITION BY page_id ORDER BY m) IS NULL THEN NULL
ELSE greatest(0.0, least(1.0, (m + lead(m) OVER (PARTITION BY page_id ORDER BY m)) / 2 / 1000.0)) END AS cut FROM (SELECT page_id, cluster, avg(x) AS m FROM ({_CLUSTERS}) GROUP BY 1, 2)) GROUP BY page_id""")
def w10_columns(t: Tables):
    return layout.columns(t.v_regions).select("page_id", "column_count", F.array_join(F.transform("cuts", lambda c: F.round(c * 10000).cast("long").cast("string")), ",").alias("cuts"))


@query("SELECT page_id, round(greatest(max(x_max), 1.0), 6) AS width, round(greatest(max(y_max), 1.0), 6) AS height FROM v_regions GROUP BY 1")
def a30_page_dims(t: Tables):
    return layout.page_dims(t.v_regions).select("page_id", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE type = '{x}') AS n_{x}" for x in layout.TYPES)


@query(f"SELECT page_id, round(avg(confidence), 6) AS mean_confidence, round(count(*) FILTER (WHERE confidence < 0.6) / count(*), 6) AS low_share, {_COUNTS} FROM v_regions GROUP BY 1")
def a20_layout_summary(t: Tables):
    return layout.layout_summary(t.v_regions, 0.6)


_OBS = " UNION ALL ".join([f"SELECT page_id, 'class_fraction_{x}' AS metric, round(count(*) FILTER (WHERE type = '{x}') / count(*), 6) AS value FROM v_regions GROUP BY 1" for x in layout.TYPES] + ["SELECT page_id, 'mean_confidence', round(avg(confidence), 6) FROM v_regions GROUP BY 1", "SELECT page_id, 'region_count', count(*)::DOUBLE FROM v_regions GROUP BY 1"])


@query(_OBS)
def a21_observations(t: Tables):
    return layout.observations(t.v_regions)


@query(f"SELECT page_id, round(avg(iou), 6) AS agreement FROM (SELECT a.page_id, a.pos, coalesce(max({_IOU}), 0.0) AS iou FROM {_A} a LEFT JOIN {_B} b ON a.page_id = b.page_id GROUP BY 1, 2) GROUP BY 1")
def a26_cross_model(t: Tables):
    return layout.cross_model(t.v_regions, t.v_regions_b)


def _natives(labels, *odd: str) -> list[str]:
    """Every native label of a detector, and some that it does not know."""
    return [*sorted(layout.label_map(labels)), *odd]


def _fed(labels, *odd: str) -> tuple[str, str]:
    """Array of what a detector is fed with and a table of its classes, as SQL of either engine."""
    values = ", ".join(f"('{n}', '{k or ''}')" for n, k in layout.label_map(labels).items())
    return ", ".join(f"'{n}'" for n in _natives(labels, *odd)), values


_FED = {
    "primary": (_fed(layout.PRIMARY_LABELS, "seal", "formula"), None),
    "secondary": (_fed(layout.SECONDARY_LABELS, "stamp"), None),
    "external": (_fed(layout.EXTERNAL_LABELS, "WIDGET"), "text_block"),
}


def _twin_of(source: str, regions: str) -> str:
    (fed, values), unknown = _FED[source]
    n = fed.count("', '") + 1
    return f"""SELECT '{source}' AS source, coalesce(m.type, '{unknown or ''}') AS type, count(*) AS n FROM (SELECT [{fed}][(page_id * 7 + pos * 3) % {n} + 1] AS native FROM {regions}) r LEFT JOIN (VALUES {values}) m(native, type) USING (native)
WHERE coalesce(m.type, '{unknown or ''}') <> '' GROUP BY 2"""


@query(f"""{_twin_of('primary', 'v_regions')} UNION ALL {_twin_of('secondary', 'v_regions_b')} UNION ALL {_twin_of('external', 'v_regions')}
UNION ALL SELECT 'warning', native, count(*) FROM (SELECT [{_FED['primary'][0][0]}][(page_id * 7 + pos * 3) % {_FED['primary'][0][0].count("', '") + 1} + 1] AS native FROM v_regions) WHERE native IN ('seal', 'formula') GROUP BY 2""")
def p16_map_classes(t: Tables):
    def fed(regions, natives: list[str], written):
        label = F.get(F.array(*map(F.lit, natives)), ((F.col("page_id") * 7 + F.col("pos") * 3) % len(natives)).cast("int"))
        return regions.select("page_id", written(label).alias("label"))

    label = F.col("label")
    # as the detectors write them: the first with blanks, hyphens and capitals, the second with blanks around
    first = fed(t.v_regions, _natives(layout.PRIMARY_LABELS, "seal", "formula"), lambda c: F.concat(F.lit(" "), F.initcap(F.regexp_replace(c, "_", F.when(F.col("pos") % 2 == 0, "-").otherwise("  ")))))
    second = fed(t.v_regions_b, _natives(layout.SECONDARY_LABELS, "stamp"), lambda c: F.concat(F.upper(c), F.lit(" ")))
    third = fed(t.v_regions, _natives(layout.EXTERNAL_LABELS, "WIDGET"), F.lower)
    out = layout.unmapped(first, layout.PRIMARY_LABELS, layout.primary_label(label)).select(F.lit("warning").alias("source"), F.col("native").alias("type"), "n")
    parts = {
        "primary": layout.map_classes(first, layout.PRIMARY_LABELS, layout.primary_label(label)), "secondary": layout.map_classes(second, layout.SECONDARY_LABELS, layout.secondary_label(label)),
        "external": layout.map_classes(third, layout.EXTERNAL_LABELS, layout.external_label(label), "text_block"),
    }
    for source, rows in parts.items():
        out = out.unionByName(rows.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(source).alias("source"), "type", "n"))
    return out


@query("""SELECT page_id, CASE WHEN n > 7 THEN 'local_agreement' WHEN page_id % 3 = 0 THEN 'external' WHEN n > 0 THEN 'local_fallback_a' ELSE 'none' END AS layout_source,
CASE WHEN n > 7 THEN n WHEN page_id % 3 = 0 THEN page_id % 4 ELSE n END AS n_regions, 'done' AS status FROM (SELECT page_id, count(*) FILTER (WHERE confidence > 0.52) AS n FROM v_regions GROUP BY 1) WHERE n > 0""")
def c8_adjudicate(t: Tables):
    rows = t.v_regions.groupBy("page_id").agg(F.count_if(F.col("confidence") > 0.52).alias("n_a")).where("n_a > 0")
    rows = rows.withColumns({"agreed": F.col("n_a") > 7, "n_b": F.lit(None).cast("long"), "external": F.when(F.col("page_id") % 3 == 0, F.col("page_id") % 4)})
    return layout.adjudicate(rows).select("page_id", "layout_source", "n_regions", "status")


@query(f"SELECT a.vec_id, round({_IOU.replace('a.x_min', 'a.x1').replace('a.y_min', 'a.y1').replace('a.x_max', 'a.x3').replace('a.y_max', 'a.y3').replace('b.x_min', '100').replace('b.y_min', '100').replace('b.x_max', '600').replace('b.y_max', '500')}, 6) AS iou FROM v_quads a")
def f1_iou(t: Tables):
    other = tuple(F.lit(float(v)) for v in (100, 100, 600, 500))
    return t.v_quads.select("vec_id", F.round(g.iou((F.col("x1"), F.col("y1"), F.col("x3"), F.col("y3")), other), 6).alias("iou"))


@query("SELECT vec_id, round(abs(x1*y2 - x2*y1 + x2*y3 - x3*y2 + x3*y4 - x4*y3 + x4*y1 - x1*y4) / 2, 4) AS area FROM v_quads")
def f2_quad_area(t: Tables):
    return t.v_quads.select("vec_id", F.round(g.quad_area(corners()), 4).alias("area"))




def _cross(i: int) -> str:
    a, b, c = (i - 1) % 4 + 1, i % 4 + 1, (i + 1) % 4 + 1
    return f"sign((x{b}-x{a})*(y{c}-y{b}) - (y{b}-y{a})*(x{c}-x{b}))"


@query(f"SELECT vec_id, least({', '.join(_cross(i) for i in range(1, 5))}) = greatest({', '.join(_cross(i) for i in range(1, 5))}) AS convex FROM (SELECT vec_id, x1, y1, CASE WHEN vec_id % 3 = 0 THEN 300 ELSE x2 END AS x2, CASE WHEN vec_id % 3 = 0 THEN 400 ELSE y2 END AS y2, x3, y3, x4, y4 FROM v_quads)")
def f3_convex(t: Tables):
    dent = t.v_quads.withColumns({"x2": F.when(F.col("vec_id") % 3 == 0, 300.0).otherwise(F.col("x2")), "y2": F.when(F.col("vec_id") % 3 == 0, 400.0).otherwise(F.col("y2"))})
    return dent.select("vec_id", g.is_convex(corners()).alias("convex"))


_UNROLL = " UNION ALL ".join(f"SELECT vec_id, {i - 1} AS i, x{i} AS x, y{i} AS y FROM v_quads" for i in (3, 1, 4, 2))


@query(f"SELECT vec_id, round(arg_min(x, x + y), 4) AS tl_x, round(arg_max(y, x - y), 4) AS tr_y, round(arg_max(x, x + y), 4) AS br_x, round(arg_min(y, x - y), 4) AS bl_y FROM ({_UNROLL}) GROUP BY 1")
def f4_order_corners(t: Tables):
    c = corners()
    o = t.v_quads.select("vec_id", g.order_corners([c[2], c[0], c[3], c[1]]).alias("o"))
    return o.select("vec_id", *(F.round(f"o.{k}.{a}", 4).alias(f"{k}_{a}") for k, a in (("tl", "x"), ("tr", "y"), ("br", "x"), ("bl", "y"))))


_KEYPOINTS = f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, y, n) AS l, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, y, n) AS r FROM (SELECT vec_id, CASE i WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS n, x, y FROM ({_UNROLL}))"


@query(f"""SELECT vec_id, printf('%.3f/%.3f %.3f/%.3f %.3f/%.3f %.3f/%.3f', tl.x, tl.y, tr.x, tr.y, br.x, br.y, bl.x, bl.y) AS points FROM (SELECT vec_id, arg_min({{'x': x, 'y': y}}, x + y) FILTER (WHERE l <= 2) AS tl, arg_max({{'x': x, 'y': y}}, y) FILTER (WHERE l <= 2) AS bl,
arg_min({{'x': x, 'y': y}}, y) FILTER (WHERE r <= 2) AS tr, arg_max({{'x': x, 'y': y}}, x + y) FILTER (WHERE r <= 2) AS br FROM ({_KEYPOINTS}) GROUP BY 1)""")
def f5_reorder_keypoints(t: Tables):
    pts = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (4, 2, 1, 3)])
    text = F.array_join(F.transform(g.reorder_keypoints(pts), lambda p: F.concat_ws("/", g.fixed(p["x"], 3), g.fixed(p["y"], 3))), " ")
    return t.v_quads.select("vec_id", F.when(F.forall(pts, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), text).alias("points"))


@query("SELECT vec_id, round(400 + (x1 - 400) * cos(radians(30)) - (y1 - 300) * sin(radians(30)), 5) AS rx, round(300 + (x1 - 400) * sin(radians(30)) + (y1 - 300) * cos(radians(30)), 5) AS ry, round(1 - y1 / 600, 5) AS qx, round(x1 / 800, 5) AS qy FROM v_quads")
def f6_rotate(t: Tables):
    x, y = F.col("x1"), F.col("y1")
    rx, ry = g.rotate(x, y, 400.0, 300.0, 30.0)
    qx, qy = g.rotate_quarter(x / 800, y / 600, F.lit(90))
    return t.v_quads.select("vec_id", F.round(rx, 5).alias("rx"), F.round(ry, 5).alias("ry"), F.round(qx, 5).alias("qx"), F.round(qy, 5).alias("qy"))


@query("SELECT vec_id, turn, round(CASE turn WHEN 90 THEN 1 - y ELSE CASE turn WHEN 180 THEN 1 - x ELSE CASE turn WHEN 270 THEN y ELSE x END END END, 6) AS x, round(CASE turn WHEN 90 THEN x WHEN 180 THEN 1 - y WHEN 270 THEN 1 - x ELSE y END, 6) AS y FROM (SELECT vec_id, x1 / 800 AS x, y1 / 600 AS y FROM v_quads) CROSS JOIN (VALUES (0), (90), (180), (270)) v(turn)")
def f7_augment(t: Tables):
    rows = t.v_quads.select("vec_id", (F.col("x1") / 800).alias("x0"), (F.col("y1") / 600).alias("y0"), F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("turn"))
    x, y = g.rotate_quarter(F.col("x0"), F.col("y0"), F.col("turn"))
    return rows.select("vec_id", "turn", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT vec_id, trunc(x1 * 2.5)::INT AS sx, trunc(y1 * 2.5)::INT AS sy, round(greatest(0.0, least(1.0, (x2 + 40) / 800)), 6) AS nx, round(greatest(0.0, least(600.0, y3)), 6) AS cy FROM v_quads")
def f8_scale_shift_clip(t: Tables):
    box = g.scale_box((F.col("x1"), F.col("y1"), F.col("x3"), F.col("y3")), 2.5, 2.5)
    return t.v_quads.select("vec_id", box[0].alias("sx"), box[1].alias("sy"), F.round(g.clip((F.col("x2") + 40) / 800), 6).alias("nx"), F.round(g.clip(F.col("y3"), 0.0, 600.0), 6).alias("cy"))


@query("SELECT vec_id, floor(least(x1, x2, x3, x4))::BIGINT AS x_min, floor(least(y1, y2, y3, y4))::BIGINT AS y_min, ceil(greatest(x1, x2, x3, x4))::BIGINT AS x_max, ceil(greatest(y1, y2, y3, y4))::BIGINT AS y_max, round(x1 - x2 / 2, 5) AS left_x FROM v_quads")
def f9_boxes(t: Tables):
    box = g.outer_box(g.box_of(corners()))
    return t.v_quads.select("vec_id", *(c.alias(n) for c, n in zip(box, g.BOX, strict=True)), F.round(g.to_xyxy(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))[0], 5).alias("left_x"))


@query("""SELECT vec_id, round(((degrees(atan2(tr[2] - tl[2], tr[1] - tl[1]))) + degrees(atan2(br[2] - bl[2], br[1] - bl[1]))) / 2, 5) AS angle FROM (SELECT vec_id, CASE WHEN a[2] <= b[2] THEN [a[2], a[1]] ELSE [b[2], b[1]] END AS tl, CASE WHEN a[2] <= b[2] THEN [b[2], b[1]] ELSE [a[2], a[1]] END AS tr,
CASE WHEN c[2] <= d[2] THEN [c[2], c[1]] ELSE [d[2], d[1]] END AS bl, CASE WHEN c[2] <= d[2] THEN [d[2], d[1]] ELSE [c[2], c[1]] END AS br FROM (SELECT vec_id, l[1] AS a, l[2] AS b, l[3] AS c, l[4] AS d FROM (SELECT vec_id, list_sort([[y1, x1], [y2, x2], [y3, x3], [y4, x4]]) AS l FROM v_quads)))""")
def f10_skew_angle(t: Tables):
    return t.v_quads.select("vec_id", F.round(g.skew_angle(corners()), 5).alias("angle"))


_DOWN = "CASE WHEN {v} <= {a} THEN 1.0 WHEN {v} >= {b} THEN 0.0 ELSE ({b} - {v}) / ({b} - {a}) END"
_UP = "CASE WHEN {v} >= {b} THEN 1.0 WHEN {v} <= {a} THEN 0.0 ELSE ({v} - {a}) / ({b} - {a}) END"
_RANGE = "CASE WHEN {v} BETWEEN {b} AND {c} THEN 1.0 WHEN {v} <= {a} OR {v} >= {d} THEN 0.0 WHEN {v} < {b} THEN ({v} - {a}) / ({b} - {a}) ELSE ({d} - {v}) / ({d} - {c}) END"


@query(f"SELECT vec_id, round({_DOWN.format(v='skew_residual', a='1.0', b='5.0')}, 6) AS down, round({_UP.format(v='border_score', a='0.3', b='0.5')}, 6) AS up, round({_RANGE.format(v='foreground_coverage', a='0.1', b='0.2', c='0.9', d='0.95')}, 6) AS inside FROM v_quads")
def f11_ramps(t: Tables):
    return t.v_quads.select("vec_id", F.round(g.ramp_down(F.col("skew_residual"), 1.0, 5.0), 6).alias("down"), F.round(g.ramp_up(F.col("border_score"), 0.3, 0.5), 6).alias("up"), F.round(g.ramp_range(F.col("foreground_coverage"), 0.1, 0.2, 0.9, 0.95), 6).alias("inside"))


@query("SELECT lineage_id, trunc(w * s)::INT AS down_w, trunc(h * s)::INT AS down_h, round_even(w * p, 0)::INT AS proxy_w FROM (SELECT *, least(2096.0 / w, 2096.0 / h, 1.0) AS s, least(1024.0 / w, 1024.0 / h, 1.0) AS p FROM (SELECT lineage_id, down_h * 3 AS w, down_h * 4 AS h FROM v_lineage))")
def f12_fit_dims(t: Tables):
    rows = t.v_lineage.select("lineage_id", (F.col("down_h") * 3).alias("w"), (F.col("down_h") * 4).alias("h"))
    (dw, dh), (pw, _) = g.fit_dims(F.col("w"), F.col("h"), 2096, True), g.fit_dims(F.col("w"), F.col("h"), 1024, False)
    return rows.select("lineage_id", dw.alias("down_w"), dh.alias("down_h"), pw.alias("proxy_w"))


def _models(t: Tables):
    """Both models' answers from the quads: b is a, shifted."""
    box = g.box_of(corners())
    area = g.quad_area(corners()) / (800.0 * 600.0)
    count = F.when(F.col("vec_id") % 4 == 0, 2).otherwise(1)
    rows = t.v_quads.withColumns({"page_count": count, "split_required": F.col("vec_id") % 4 == 0, "fraction": F.when(F.col("vec_id") % 9 == 0, F.lit(0.09)).otherwise(area)})
    rows = rows.withColumn("failed", gates.sanity(corners(), box, F.col("page_count"), F.col("fraction"), 800.0, 600.0))
    same = [F.col(c).alias(c) for c in ("split_required", "tta_agreement", "tta_variance", "failed")]
    a = F.when(F.col("vec_id") % 17 != 0, F.struct("page_count", "confidence", F.col("fraction").alias("min_area"), *same))
    b = F.when(F.col("vec_id") % 13 != 0, F.struct(F.when(F.col("vec_id") % 7 == 0, 3 - F.col("page_count")).otherwise(F.col("page_count")).alias("page_count"), (F.col("confidence") * F.when(F.col("vec_id") % 5 == 0, 1.0).otherwise(0.97)).alias("confidence"), (F.col("fraction") * 0.95).alias("min_area"), *same))
    return rows.select("vec_id", "material_type", a.alias("a"), b.alias("b"))


_TURN = "nullif(CASE WHEN abs({c}) < 1e-9 THEN 0 ELSE sign({c}) END, 0)"
_TURNS = ", ".join(_TURN.format(c=_cross(i).removeprefix("sign(").removesuffix(")")) for i in range(1, 5))
_INSIDE = " AND ".join(f"x{i} BETWEEN 0 AND 800 AND y{i} BETWEEN 0 AND 600" for i in range(1, 5))
_CHECKED = f"""m AS (SELECT *, vec_id % 4 = 0 AS sr, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS pc, abs(x1*y2 - x2*y1 + x2*y3 - x3*y2 + x3*y4 - x4*y3 + x4*y1 - x1*y4) / 2 AS area,
greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS w, greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS h FROM v_quads),
fr AS (SELECT *, CASE WHEN vec_id % 9 = 0 THEN 0.09::DOUBLE ELSE area / 480000.0 END AS fraction, CASE WHEN material_type = 'newspaper' THEN 0.10 ELSE 0.15 END / pc AS low,
CASE WHEN material_type = 'archival_document' THEN 0.5 ELSE 0.3 END AS flat, CASE WHEN material_type IN ('newspaper', 'microfilm') THEN 5.0 ELSE 3.0 END AS tall FROM m),
q AS (SELECT *, list_filter([CASE WHEN NOT ({_INSIDE}) THEN 'within_bounds' END, CASE WHEN NOT (area > 0 AND w > 0 AND h > 0) THEN 'non_degenerate' END, CASE WHEN NOT fraction BETWEEN low AND 1 THEN 'area_fraction_plausible' END,
CASE WHEN NOT (h > 0 AND coalesce(w / nullif(h, 0) BETWEEN flat AND tall, false)) THEN 'aspect_ratio_plausible' END, CASE WHEN NOT coalesce(least({_TURNS}) = greatest({_TURNS}), true) THEN 'corner_ordering_valid' END], lambda x: x IS NOT NULL) AS failed,
vec_id % 17 <> 0 AS has_a, vec_id % 13 <> 0 AS has_b FROM fr)"""


@query(f"WITH {_CHECKED} SELECT vec_id, CASE WHEN has_a THEN array_to_string(failed, ',') END AS failed_a, CASE WHEN has_b THEN array_to_string(failed, ',') END AS failed_b FROM q")
def c1_sanity(t: Tables):
    return _models(t).select("vec_id", F.array_join("a.failed", ",").alias("failed_a"), F.array_join("b.failed", ",").alias("failed_b"))


@query("SELECT vec_id, CASE WHEN vec_id % 17 <> 0 AND vec_id % 13 <> 0 THEN vec_id % 7 <> 0 OR (CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END) = 3 - (CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END) END AS agreed FROM v_quads")
def c2_structural_agreement(t: Tables):
    return _models(t).select("vec_id", gates.agree().alias("agreed"))


@query("SELECT vec_id, vec_id % 4 <> 0 OR least(confidence, tta_agreement) >= 0.75 AS split_ok, tta_variance <= 0.15 AS variance_ok FROM v_quads WHERE vec_id % 17 <> 0")
def c3_candidate_filters(t: Tables):
    return _models(t).where("a IS NOT NULL").select("vec_id", gates.passes_split(F.col("a")).alias("split_ok"), gates.passes_variance(F.col("a")).alias("variance_ok"))


_SELECTED = f"""{_CHECKED},
b AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN 3 - pc ELSE pc END AS b_pc, confidence * CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 0.97 END AS b_conf, fraction * 0.95 AS b_area FROM q),
s AS (SELECT *, has_a AND len(failed) = 0 AS sane_a, has_b AND len(failed) = 0 AS sane_b, CASE WHEN has_a AND has_b THEN pc = b_pc END AS agreement, tta_variance <= 0.15 AS calm FROM b),
p AS (SELECT *, sane_a AND (NOT sr OR least(confidence, tta_agreement) >= 0.75) AS split_a, sane_b AND (NOT sr OR least(b_conf, tta_agreement) >= 0.75) AS split_b FROM s),
l AS (SELECT *, split_a AND calm AS l_a, split_b AND calm AS l_b FROM p),
k AS (SELECT *, NOT l_a AND NOT l_b AS nobody, has_a AND has_b AND coalesce(agreement, false) AND l_a AND l_b AS high, l_a AND l_b AND least(fraction, b_area) < 0.30 AS small FROM l)"""
_WHY = """CASE WHEN NOT nobody THEN NULL WHEN NOT (has_a OR has_b) THEN 'geometry_selection_failed' WHEN NOT sane_a AND NOT sane_b THEN 'geometry_sanity_failed' WHEN NOT split_a AND NOT split_b THEN 'split_confidence_low' ELSE 'tta_variance_high' END"""
_ROUTE = "CASE WHEN nobody THEN 'pending_human_correction' WHEN high THEN 'accepted' ELSE 'rectification' END"


@query(f"""WITH {_SELECTED}
SELECT vec_id, agreement AS structural_agreement, CASE WHEN nobody THEN NULL WHEN l_a AND NOT l_b THEN 'a' WHEN l_b AND NOT l_a OR small OR b_conf > confidence THEN 'b' ELSE 'a' END AS selected,
CASE WHEN nobody THEN NULL WHEN high THEN 'high' ELSE 'low' END AS trust, CASE WHEN nobody THEN NULL WHEN l_a <> l_b THEN 'sole_survivor' WHEN small THEN 'page_area_preference' WHEN confidence = b_conf THEN 'default_a' ELSE 'higher_confidence' END AS selection_reason,
{_WHY} AS review_reason,
{_ROUTE} AS route FROM k""")
def c4_select_geometry(t: Tables):
    return gates.select_geometry(_models(t)).select("vec_id", "structural_agreement", "selected", "trust", "selection_reason", "review_reason", "route")


_GATE_VALUES = {
    "geometry_a.confidence": "CASE WHEN has_a THEN confidence END", "geometry_a.tta_agreement": "CASE WHEN has_a THEN tta_agreement END", "geometry_a.tta_variance": "CASE WHEN has_a THEN tta_variance END", "geometry_a.split": "CASE WHEN has_a THEN sr::INT END",
    "geometry_b.confidence": "CASE WHEN has_b THEN b_conf END", "geometry_b.tta_agreement": "CASE WHEN has_b THEN tta_agreement END", "geometry_b.tta_variance": "CASE WHEN has_b THEN tta_variance END", "geometry_b.split": "CASE WHEN has_b THEN sr::INT END",
    "structural_agreement": "agreement::INT", "selection.accepted_fraction": "(route = 'accepted')::INT", "selection.review_fraction": "(route = 'pending_human_correction')::INT", "selection.disagreement_fraction": "coalesce(NOT agreement, false)::INT",
    "selection.geometry_sanity_failed_fraction": "coalesce(why = 'geometry_sanity_failed', false)::INT", "selection.split_confidence_low_fraction": "coalesce(why = 'split_confidence_low', false)::INT", "selection.tta_variance_high_fraction": "coalesce(why = 'tta_variance_high', false)::INT",
    "quality.blur_score": "CASE WHEN vec_id % 6 <> 0 THEN blur_score END", "quality.border_score": "border_score", "quality.foreground_coverage": "foreground_coverage",
    "validation.valid_fraction": "(vec_id % 3 = 0)::INT", "validation.invalid_fraction": "(vec_id % 3 = 1)::INT", "validation.rectification_triggered_fraction": "(vec_id % 3 = 2)::INT", "rectification.confidence": "CASE WHEN vec_id % 3 = 2 THEN tta_agreement END",
}


@query(f"""WITH {_SELECTED}, o AS (SELECT *, {_ROUTE} AS route, {_WHY} AS why FROM k)
SELECT vec_id, metric, round(value, 6) AS value FROM ({' UNION ALL '.join(f"SELECT vec_id, '{k}' AS metric, ({v})::DOUBLE AS value FROM o" for k, v in _GATE_VALUES.items())}) WHERE value IS NOT NULL""")
def a21_gate_observations(t: Tables):
    quality = t.v_quads.select("vec_id", F.when(F.col("vec_id") % 6 != 0, F.col("blur_score")).alias("blur_score"), "border_score", "foreground_coverage", F.when(F.col("vec_id") % 3 == 2, F.col("tta_agreement")).alias("rectification_confidence"))
    label = F.when(F.col("vec_id") % 3 == 0, "valid").when(F.col("vec_id") % 3 == 1, "invalid").otherwise("rectification_triggered")
    rows = gates.select_geometry(_models(t)).join(quality, "vec_id").withColumn("validation_route", label)
    return gates.observations(rows, "vec_id").select("vec_id", "metric", F.round("value", 6).alias("value"))



@query("""SELECT page_id, pos AS region, round(area, 6) AS area_fraction FROM (SELECT *, row_number() OVER w AS r, lead(area) OVER w AS second FROM (SELECT page_id, pos, (x_max - x_min) * (y_max - y_min) / 400000 AS area, confidence > 0.51 AS sane FROM v_regions)
WINDOW w AS (PARTITION BY page_id ORDER BY area DESC, pos DESC)) WHERE r = 1 AND sane AND coalesce(second, 0) <= 0.12""")
def c5_largest_region(t: Tables):
    rows = t.v_regions.select("page_id", F.col("pos").alias("region"), ((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")) / 400000).alias("area_fraction"), (F.col("confidence") > 0.51).alias("sane"))
    return gates.largest_region(rows).select("page_id", "region", F.round("area_fraction", 6).alias("area_fraction"))


@query("""SELECT vec_id, array_to_string(CASE WHEN vec_id % 19 = 0 THEN ['file_exists'] ELSE list_filter([CASE WHEN bad THEN 'valid_image' END, CASE WHEN NOT bad AND NOT (w > 0 AND h > 0) THEN 'non_degenerate' END, CASE WHEN NOT bad AND w > 0 AND h > 0 AND (w < 16 OR h < 16) THEN 'min_dimensions' END,
CASE WHEN NOT bad AND bytes < 512 THEN 'min_file_size' END, CASE WHEN NOT (x1 >= 0 AND y1 >= 0 AND x3 <= 800 AND y3 <= 600) THEN 'bounds_consistent' END, CASE WHEN greatest(0.0, (x3 - x1) * (y3 - y1)) / 480000 < 0.001 THEN 'crop_area_plausible' END,
CASE WHEN NOT bad AND w > 0 AND h > 0 AND (abs(w - 700) > 2 OR abs(h - 500) > 2) THEN 'dimensions_consistent' END], lambda x: x IS NOT NULL) END, ',') AS failed
FROM (SELECT *, vec_id % 23 = 0 AS bad, CASE WHEN vec_id % 11 = 0 THEN 0 WHEN vec_id % 11 = 1 THEN 12 ELSE 698 + vec_id % 7 END AS w, 500 AS h, vec_id * 40 AS bytes FROM v_quads)""")
def c6_hard_checks(t: Tables):
    i = F.col("vec_id")
    rows = t.v_quads.select("vec_id", (i % 19 != 0).alias("exists"), (i % 23 != 0).alias("decodes"), F.when(i % 11 == 0, 0).when(i % 11 == 1, 12).otherwise(698 + i % 7).alias("actual_w"), F.lit(500).alias("actual_h"), (i * 40).alias("byte_size"),
        F.col("x1").alias("x_min"), F.col("y1").alias("y_min"), F.col("x3").alias("x_max"), F.col("y3").alias("y_max"), F.lit(800).alias("orig_w"), F.lit(600).alias("orig_h"), F.lit(700).alias("post_w"), F.lit(500).alias("post_h"))
    return gates.hard_checks(rows).select("vec_id", F.array_join("failed", ",").alias("failed"))


_N = "material_type = 'newspaper'"
_SIG = {
    "skew": _DOWN.format(v="skew_residual", a="1.0", b="5.0"), "blur": _DOWN.format(v="blur_score", a="0.4", b="0.7"),
    "border": f"CASE WHEN {_N} THEN {_UP.format(v='border_score', a='0.2', b='0.4')} ELSE {_UP.format(v='border_score', a='0.3', b='0.5')} END",
    "foreground": f"CASE WHEN {_N} THEN {_RANGE.format(v='foreground_coverage', a='0.03', b='0.08', c='0.95', d='0.99')} ELSE {_RANGE.format(v='foreground_coverage', a='0.1', b='0.2', c='0.9', d='0.95')} END",
    "geometry": _UP.format(v="confidence", a="0.5", b="0.8"), "tta": _UP.format(v="tta_agreement", a="0.7", b="0.9"),
}


@query(f"""SELECT vec_id, round(s, 6) AS soft_score, round((2.0 * skew + blur + border + foreground + 0.5 * geometry + 0.0 * tta) / 5.5, 6) AS weighted_score, s >= CASE WHEN {_N} THEN 0.5 ELSE 0.6 END OR ({_N} AND (geometry < 0.5 OR tta < 0.5) AND NOT (skew < 0.5 OR blur < 0.5 OR border < 0.5 OR foreground < 0.5)) AS soft_passed
FROM (SELECT *, (skew + blur + border + foreground + geometry + tta) / 6 AS s FROM (SELECT vec_id, material_type, {', '.join(f'{v} AS {k}' for k, v in _SIG.items())} FROM v_quads))""")
def c7_soft_score(t: Tables):
    weighted = gates.soft_score(t.v_quads, weights={"skew": 2.0, "geometry": 0.5, "tta": 0.0}).select("*", F.round("soft_score", 6).alias("weighted_score")).drop("soft_score", "soft_passed")
    return gates.soft_score(weighted).select("vec_id", F.round("soft_score", 6).alias("soft_score"), "weighted_score", "soft_passed")


def _before_after():
    before = {"border": F.col("border_score"), "skew": F.col("skew_residual"), "blur": F.col("blur_score"), "foreground": F.col("foreground_coverage")}
    after = {"border": F.col("border_score") + F.col("tta_variance"), "skew": F.col("skew_residual") * F.col("confidence"), "blur": F.col("blur_score") * 0.9, "foreground": F.col("tta_agreement")}
    return before, after


_GAIN = "greatest(-1.0, least(1.0, {s} * ({a} - {b}) / greatest(abs({a}), abs({b}), 1.0)))"
_BA = {"border": ("border_score + tta_variance", "border_score", 1), "skew": ("skew_residual * confidence", "skew_residual", -1), "blur": ("blur_score * 0.9", "blur_score", 1), "foreground": ("tta_agreement", "foreground_coverage", 1)}
_SCORE = "greatest(0.0, least(1.0, 0.5 + " + " + ".join(f"{w} * " + _GAIN.format(s=_BA[k][2], a=f"({_BA[k][0]})", b=_BA[k][1]) for k, w in (("border", 0.35), ("skew", 0.35), ("blur", 0.15), ("foreground", 0.15))) + "))"


@query(f"""SELECT vec_id, round({_SCORE}, 6) AS score, array_to_string(list_filter([CASE WHEN border_score + tta_variance <= border_score THEN 'border_score_not_improved' END, CASE WHEN skew_residual * confidence >= skew_residual THEN 'skew_residual_not_improved' END,
CASE WHEN blur_score * 0.9 + 0.05 < blur_score THEN 'blur_score_regressed' END], lambda x: x IS NOT NULL), ',') AS warnings FROM v_quads""")
def c12_rectification_score(t: Tables):
    before, after = _before_after()
    return t.v_quads.select("vec_id", F.round(gates.rectification_score(before, after), 6).alias("score"), F.array_join(gates.rectification_warnings(before, after), ",").alias("warnings"))


@query(f"""SELECT vec_id, array_to_string(list_filter([CASE WHEN {_SCORE} < 0.6 THEN 'low_confidence' END, CASE WHEN skew_residual * confidence >= skew_residual THEN 'skew_not_improved' END, CASE WHEN border_score + tta_variance < border_score THEN 'border_regressed' END,
CASE WHEN border_score + tta_variance <= border_score OR skew_residual * confidence >= skew_residual THEN 'warning_veto' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v_quads""")
def c17_accept_rectified(t: Tables):
    before, after = _before_after()
    reasons = gates.accept_rectified(gates.rectification_score(before, after), before, after, gates.rectification_warnings(before, after), 0.6)
    return t.v_quads.select("vec_id", F.array_join(reasons, ",").alias("reasons"))


def _second(t: Tables):
    i = F.col("vec_id")
    return t.v_quads.select("vec_id", "material_type", (i % 6 != 0).alias("rectified"), (i % 2 == 0).alias("is_child"), (i % 10 == 0).alias("split_reported"), (i % 20 == 0).alias("fallback"), F.when(F.col("confidence") > 0.7, "accepted").otherwise("rectification").alias("route2"),
        F.when(i % 7 != 0, F.col("tta_variance") < 0.1).alias("agreed2"), F.when(i % 8 == 0, "inherited").alias("review2"), (F.col("blur_score") < 0.6).alias("valid2"), (F.col("skew_residual") < 1).alias("first_ok"))


_SECOND = """SELECT vec_id, first_ok, CASE WHEN NOT rectified AND material_type = 'newspaper' AND valid2 THEN NULL WHEN NOT rectified THEN 'rectification_failed' WHEN is_child AND split_reported AND NOT fallback THEN 'split_child_reports_split'
WHEN route2 <> 'accepted' THEN CASE WHEN coalesce(NOT agreed2, false) THEN 'structural_disagreement_post_rectification' WHEN review2 IS NOT NULL THEN review2 ELSE 'low_geometry_trust' END WHEN NOT valid2 THEN 'artifact_validation_failed' END AS second_reason
FROM (SELECT vec_id, material_type, vec_id % 6 <> 0 AS rectified, vec_id % 2 = 0 AS is_child, vec_id % 10 = 0 AS split_reported, vec_id % 20 = 0 AS fallback, CASE WHEN confidence > 0.7 THEN 'accepted' ELSE 'rectification' END AS route2,
CASE WHEN vec_id % 7 <> 0 THEN tta_variance < 0.1 END AS agreed2, CASE WHEN vec_id % 8 = 0 THEN 'inherited' END AS review2, blur_score < 0.6 AS valid2, skew_residual < 1 AS first_ok FROM v_quads)"""


@query(f"SELECT vec_id, second_reason, CASE WHEN second_reason IS NULL THEN 'accepted' ELSE 'pending_human_correction' END AS second_route FROM ({_SECOND})")
def c18_second_pass_route(t: Tables):
    return gates.second_pass_route(_second(t)).select("vec_id", "second_reason", "second_route")


@query(f"SELECT vec_id, CASE WHEN first_ok OR second_reason IS NULL THEN 'accepted' ELSE 'pending_human_correction' END AS child_route, CASE WHEN first_ok THEN 'accepted' ELSE 'pending_human_correction' END AS direct_route FROM ({_SECOND})")
def c19_split_child_route(t: Tables):
    direct = gates.split_child_route(_second(t), "disabled_direct_review").select("vec_id", F.col("child_route").alias("direct_route"))
    return gates.split_child_route(_second(t)).select("vec_id", "child_route").join(direct, "vec_id")


@query("SELECT vec_id, CASE WHEN confidence > 0.7 AND blur_score < 0.6 THEN 'accept_now' ELSE 'rectification' END AS route FROM v_quads")
def p17_first_pass_route(t: Tables):
    return t.v_quads.select("vec_id", gates.first_pass_route(F.col("confidence") > 0.7, F.col("blur_score") < 0.6).alias("route"))


@query("SELECT job_id, CASE WHEN pipeline_mode = 'layout' THEN 'layout_detection' ELSE 'accepted' END AS next_state FROM v_jobs")
def p18_next_state(t: Tables):
    return t.v_jobs.select("job_id", gates.next_state(F.col("pipeline_mode")).alias("next_state"))


@query("SELECT sha256(vec_id::VARCHAR || '|geometry') AS gate_id, vec_id, 'geometry' AS gate_type, '{\"material_type\":\"' || material_type || '\"}' AS payload FROM v_quads")
def p22_gate_log(t: Tables):
    return gates.gate_log(t.v_quads, ["vec_id"], "geometry", ["material_type"])
