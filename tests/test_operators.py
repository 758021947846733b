"""Order-dependent and nested operators against small Python loops, and edge cases."""

import math
import random
import unicodedata

import numpy as np
import pytest
from leafmill.functions import geometry as g
from leafmill.operators import curation, gates, golden, health, layout, orientation, pages, sequence
from leafmill.sources import readers, sinks, tables
from pyspark.sql import functions as F

REGION = "page_id long, pos int, type string, x_min double, y_min double, x_max double, y_max double, confidence double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def boxes(seed, n_pages=6, n=14):
    rng = random.Random(seed)
    out = []
    for p in range(n_pages):
        for i in range(n):
            x, y = rng.randint(0, 40), rng.randint(0, 40)
            out.append((p, i, rng.choice(["title", "table"]), float(x), float(y), float(x + rng.randint(10, 40)), float(y + rng.randint(10, 40)), rng.choice([0.5, 0.7, 0.7, 0.9])))
    return out


def test_nms_equals_a_loop(spark):
    rows = boxes(1)
    want = []
    for p in range(6):
        for t in ("title", "table"):
            kept = []
            for r in sorted((r for r in rows if r[0] == p and r[2] == t), key=lambda r: (-r[7], r[1])):
                if all(iou(r[3:7], k[3:7]) <= 0.5 for k in kept):
                    kept.append(r)
            want += [(r[0], r[1]) for r in kept]
    found = layout.nms(spark.createDataFrame(rows, REGION)).collect()
    assert sorted((r.page_id, r.pos) for r in found) == sorted(want) and len(want) < len(rows)


def test_greedy_match_and_consensus_equal_a_loop(spark):
    a, b = boxes(2), boxes(3)
    x, y = spark.createDataFrame(a, REGION), spark.createDataFrame(b[: 5 * 14], REGION)
    want, stats = [], {}
    for p in range(6):
        pa, pb = [r for r in a if r[0] == p], [r for r in b[: 5 * 14] if r[0] == p]
        used_i, used_j, mine = set(), set(), []
        for v, i, j in sorted(((-iou(r[3:7], s[3:7]), r[1], s[1]) for r in pa for s in pb if r[2] == s[2])):
            if -v >= 0.3 and i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                mine.append((p, i, j, -v))
        want += mine
        if pb:
            count = lambda rs, t: sum(r[2] == t for r in rs)
            hist = all(abs(count(pa, t) - count(pb, t)) <= 1 for t in ("title", "table"))
            mean = sum(m[3] for m in mine) / len(mine) if mine else 0.0
            ratio = len(mine) / max(len(pa), len(pb))
            stats[p] = (len(mine), ratio >= 0.7 and hist, round(min(1, 0.6 * ratio + 0.2 * mean + 0.2 * hist), 6))
        else:
            stats[p] = (0, False, 0.0)
    found = layout.greedy_match(x, y, 0.3).collect()
    assert sorted((r.page_id, r.i, r.j) for r in found) == sorted(w[:3] for w in want)
    for r in layout.consensus(x, y, least_iou=0.3).collect():
        assert (r.matched, r.agreed) == stats[r.page_id][:2] and abs(r.consensus - stats[r.page_id][2]) < 2e-6


def test_cooldown_equals_a_loop(spark):
    from datetime import datetime, timedelta

    rng = random.Random(4)
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 2000)), i) for i, k in enumerate(rng.choices("abc", k=200))]
    want, last = [], {}
    for k, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or at >= last[k] + timedelta(days=7):
            last[k] = at
            want.append((k, i))
    found = health.cooldown(spark.createDataFrame(rows, "kind string, fired_at timestamp, event_id long")).collect()
    assert sorted((r.kind, r.event_id) for r in found) == sorted(want)


def test_throughput_of_a_known_day(spark):
    rows = [("accepted", "2024-01-02 00:00:00", 180_000.0)] * 120
    df = spark.createDataFrame(rows, "status string, status_updated_at string, processing_time_ms double").withColumn("status_updated_at", F.to_timestamp("status_updated_at"))
    now = "2024-01-02 12:00:00"
    assert tuple(health.page_rates(df, now, 24).first()) == (120, 5.0, 20.0)
    part = df.withColumn("processing_time_ms", F.when(F.rand(1) > 0.5, F.col("processing_time_ms")))
    assert tuple(health.page_rates(part, now, 24).first()) == (120, 5.0, None)
    assert tuple(health.page_rates(df.limit(0), now, 24).first()) == (0, 0.0, None)


QUAD = {"page_count": 1, "split_required": False, "confidence": 0.9, "tta_agreement": 0.95, "tta_variance": 0.02, "min_area": 0.6, "failed": []}
MODEL = "struct<page_count:int,split_required:boolean,confidence:double,tta_agreement:double,tta_variance:double,min_area:double,failed:array<string>>"


@pytest.mark.parametrize(
    ("material", "a", "b", "want"),
    [
        ("book", {}, {}, ("a", "high", "default_a", None, "accepted")),
        ("book", {}, {"confidence": 0.95}, ("b", "high", "higher_confidence", None, "accepted")),
        ("book", {}, {"page_count": 2}, ("a", "low", "default_a", None, "rectification")),
        ("book", {}, {"failed": ["within_bounds"]}, ("a", "low", "sole_survivor", None, "rectification")),
        ("book", {"min_area": 0.2}, {"confidence": 0.5}, ("b", "high", "page_area_preference", None, "accepted")),
        ("book", {"failed": ["x"]}, {"failed": ["y"]}, (None, None, None, "geometry_sanity_failed", "pending_human_correction")),
        ("book", {"split_required": True, "confidence": 0.7}, {"split_required": True, "tta_agreement": 0.7}, (None, None, None, "split_confidence_low", "pending_human_correction")),
        ("book", {"tta_variance": 0.2}, {"tta_variance": 0.2}, (None, None, None, "tta_variance_high", "pending_human_correction")),
        ("newspaper", {}, {"failed": ["area_fraction_plausible"], "min_area": 0.09}, ("a", "high", "mild_area_fallback", None, "accepted")),
        ("book", None, {}, ("b", "low", "sole_survivor", None, "rectification")),
        ("book", None, None, (None, None, None, "geometry_selection_failed", "pending_human_correction")),
    ],
)
def test_geometry_selection(spark, material, a, b, want):
    rows = [(material, None if a is None else {**QUAD, **a}, None if b is None else {**QUAD, **b})]
    r = gates.select_geometry(spark.createDataFrame(rows, f"material_type string, a {MODEL}, b {MODEL}")).first()
    assert (r.selected, r.trust, r.selection_reason, r.review_reason, r.route) == want


def test_sanity_of_a_quad(spark):
    one = spark.createDataFrame([("book",)], "material_type string")
    quad = lambda *p: [(F.lit(float(x)), F.lit(float(y))) for x, y in p]
    check = lambda c, f=0.5, n=1, other=None: one.select(gates.sanity(c, g.box_of(c), F.lit(n), F.lit(f), 800.0, 600.0, other).alias("f")).first().f
    good = quad((50, 40), (750, 40), (750, 560), (50, 560))
    assert check(good) == [] and check(good, 0.1) == ["area_fraction_plausible"] and check(good, 0.1, 2) == []
    assert check(quad((-5, 40), (750, 40), (750, 560), (50, 560))) == ["within_bounds"]
    assert check(quad((50, 40), (750, 560), (750, 40), (50, 560))) == ["non_degenerate", "corner_ordering_valid"]
    assert check(good, 0.5, 2, g.box_of(good)) == ["regions_non_overlapping"]


def test_reorder_keypoints_against_a_loop(spark):
    rng = random.Random(6)
    quads = [[(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(4)] for _ in range(60)] + [[(1.0, 1.0)] * 4, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]

    def loop(pts):
        if len(pts) != 4 or len(set(pts)) < 4:
            return pts
        left, right = sorted(pts)[:2], sorted(pts, key=lambda p: (-p[0], p[1]))[:2]
        order = [min(left, key=sum), max(left, key=lambda p: p[1]), min(right, key=lambda p: p[1]), max(right, key=sum)]
        order = [order[0], order[2], order[3], order[1]]
        if len(set(order)) == 4:
            return order
        tl, br = min(pts, key=sum), max(pts, key=sum)
        rest = [p for p in pts if p not in (tl, br)]
        if len(rest) != 2:
            return pts
        tr, bl = rest if rest[0][0] >= rest[1][0] else rest[::-1]
        return [tl, tr, br, bl]

    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in q]) for i, q in enumerate(quads)], "i int, q array<struct<x:double,y:double>>")
    for r in df.select("i", g.reorder_keypoints(F.col("q")).alias("o")).collect():
        assert [(p.x, p.y) for p in r.o] == loop(quads[r.i]), quads[r.i]


def test_fixed_rounds_as_printf(spark):
    rng = random.Random(7)
    values = [x for j in range(200) for x in (j + 0.0625, -(j + 0.1953125), float(f"{j}.0055"), float(f"0.{j:03d}5"), math.nextafter(j / 1000 + 0.0005, 0))]
    values += [rng.gauss(0, 1) * 10 ** rng.randrange(-8, 12) for _ in range(400)] + [0.0, -0.0, -0.0001, 0.9995, 999.9995, 0.9999995, 5e-324, 2.0**50 + 0.0625, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", g.fixed(F.col("v"), 3).alias("three"), g.fixed(F.col("v"), 6).alias("six")).collect()
    assert [(r.three, r.six) for r in rows] == [(f"{r.v:.3f}", f"{r.v:.6f}") for r in rows] and len(rows) == len(values)
    assert spark.range(1).select(g.fixed(F.lit(None).cast("double"), 3).alias("t")).first().t is None


def test_unaugment_inverts(spark):
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(g.unaugment(*g.rotate(F.lit(30.0), F.lit(50.0), 100.0, 80.0, 15.0), 200.0, 160.0, F.lit(False), 15.0, 1.0), "xy", strict=True)]).first()
    assert math.isclose(r.x, 30, abs_tol=1e-9) and math.isclose(r.y, 50, abs_tol=1e-9)


def test_script_classes(spark):
    text = "ab١ ش2٣é!漢"

    def script_of(ch):
        name = unicodedata.name(ch, "")
        if not ch.isalnum():
            return "other"
        return "arabic" if "ARABIC" in name else "latin" if "LATIN" in name or "DIGIT" in name else "other"

    want = {k: sum(script_of(c) == k for c in text) for k in ("arabic", "latin", "other")}
    df = spark.createDataFrame([(1, text, 0.5), (1, None, 2.0), (2, "", None)], "page_id long, text string, conf double")
    assert df.where("page_id = 1 AND text IS NOT NULL").select(orientation.script_counts(F.col("text")).alias("c")).first().c.asDict() == want
    e = {r.page_id: r for r in orientation.script_evidence(df).collect()}
    assert (e[1].arabic_ratio, e[1].latin_ratio, e[1].mean_conf, e[1].n_boxes) == (round(want["arabic"] / len(text), 6), round(want["latin"] / len(text), 6), 0.75, 2)
    assert (e[2].arabic_ratio, e[2].n_chars) == (0.0, 0)
    assert {r.page_id: r.direction for r in orientation.reading_direction(orientation.script_evidence(df), "page_id").collect()} == {1: "ltr" if want["latin"] > want["arabic"] else "unresolved" if want["latin"] == want["arabic"] else "rtl", 2: "unresolved"}


def test_votes(spark):
    df = spark.createDataFrame([(1, "x", 0, 0.5), (1, "y", 1, 0.9), (1, "y", 2, 0.7), (2, "b", 0, 0.4), (2, "a", 1, 0.6)], "k int, choice string, pos int, confidence double")
    assert {(r.k, r.choice, r.votes, r.confidence) for r in golden.vote(df, "k").collect()} == {(1, "y", 2, 0.8), (2, "b", 1, 0.4)}
    assert {(r.k, r.choice) for r in golden.sampled_vote(df, "k").collect()} == {(1, "y"), (2, "b")}


def test_sources_and_sinks(spark, tmp_path):
    import json

    (tmp_path / "cases").mkdir()
    (tmp_path / "manifest.json").write_text(json.dumps({"cases": [{"case_id": "c1", "model": "m", "material_type": "book", "annotation_path": "cases/c1.json"}, {"case_id": "c2", "model": "n", "material_type": "book", "annotation_path": "cases/c2.json"}]}))
    for c in ("c1", "c2"):
        (tmp_path / f"cases/{c}.json").write_text(json.dumps({"case_id": c, "model": "m", "thresholds": {"iou_min": 0.75}, "annotations": {"bboxes": [[0, 0, 1, 1]], "classes": [0]}}, indent=1))
    found = readers.golden_cases(spark, str(tmp_path / "manifest.json"), str(tmp_path / "cases/*.json"), model="m").collect()
    assert [(r.case_id, r.thresholds.iou_min) for r in found] == [("c1", 0.75)]
    reg = str(tmp_path / "registry")
    assert readers.registry(spark, reg).count() == 0
    one = spark.createDataFrame([("v1", "pose", "u", "h", True, "2024")], "version string, family string, uri string, checksum string, approved boolean, created_at string")
    assert [readers.append_registry(one, reg, b) for b in ("b1", "b2", "b1")] == [True, True, False]
    (tmp_path / "registry/batch=b2/_SUCCESS").unlink()  # a write that broke off
    assert readers.registry(spark, reg).count() == 1 and readers.append_registry(one, reg, "b2")
    assert readers.registry(spark, reg).count() == 2
    files = readers.artifacts(spark, str(tmp_path / "cases"))
    wrong = files.withColumn("hash", F.when(F.col("uri").endswith("c1.json"), "old").otherwise(F.col("hash")))
    assert files.count() == 2 and readers.hash_mismatches(files, wrong).count() == 1
    assert curation.dataset_checksum(files.withColumnRenamed("uri", "path")).first().n_files == 2
    sinks.write_training_set(spark.createDataFrame([("pose", "book", "val", "u1", "0 1 1")], "family string, material string, part string, uri string, label string"), str(tmp_path / "set"))
    assert spark.read.text(str(tmp_path / "set/labels")).first().value == "u1\t0 1 1" and spark.read.json(str(tmp_path / "set/manifest")).first().n == 1
    sinks.write_layout(spark.createDataFrame(boxes(7, 2, 3), REGION), str(tmp_path / "layout"))
    assert sorted(json.loads(r.value)["page_id"] for r in spark.read.text(str(tmp_path / "layout")).collect()) == [0, 1]
    got = sinks.detect(spark.range(4), lambda: lambda batch: batch.assign(label="x"), "id long, label string").collect()
    assert len(got) == 4
    jobs_df = spark.createDataFrame([("j1", "book")], "job_id string, material_type string")
    jobs_df.write.parquet(str(tmp_path / "jobs"))
    assert tables.scan(spark, str(tmp_path / "jobs"), "jobs").columns[0] == "job_id" and len(tables.SCHEMAS) == 14


def test_flag_handling_of_nulls_and_nothing(spark):
    page = "page_id string, job_id string, page_number int, sub_page_index int, status string, output_uri string, input_uri string, reading_order int, qa_approved boolean, human_corrected boolean"
    none = spark.createDataFrame([], page)
    assert pages.job_rollup(none).count() == pages.qa_gate(none).count() == pages.download_manifest(none).count() == pages.closable_parents(none).count() == 0
    odd = spark.createDataFrame([("p", None, None, None, None, None, None, None, None, None)], page)
    assert pages.job_rollup(odd).count() == 1 and pages.download_manifest(odd.withColumn("status", F.lit("x"))).count() == 1
    assert layout.nms(spark.createDataFrame([], REGION)).count() == 0
    assert spark.range(1).select(g.iou(*[tuple(F.lit(float(v)) for v in b) for b in ((0, 0, 1, 1), (1, 0, 2, 1))]).alias("v")).first().v == 0.0


def test_blocks_of_a_hot_key_do_not_show(spark):
    """One key holds all rows; blocks of a few rows give what one window over the whole key gives."""
    rng = random.Random(4)
    rows = [("m", i // 3, i, None if i % 50 == 7 else rng.random()) for i in range(400)] + [(None, 1, 900, 1.0), (None, 2, 901, 3.0), ("n", 0, 902, 5.0)]
    df = spark.createDataFrame(rows, "metric string, ts long, seq long, value double").repartition(6)
    base = spark.createDataFrame([("m", 0.5, 0.01)], "metric string, mean double, std double")
    want = {}
    for m in ("m", "n", None):
        own = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(own):
            values = [x[3] for x in own[max(0, i - 9) : i + 1] if x[3] is not None]
            want[r[2]] = (round(sum(values) / len(values), 9) if values else None, len(own[max(0, i - 9) : i + 1]))
    for block in (12, 100, 100_000):
        found = health.rolling_drift(df, base, 10, block=block).collect()
        assert {r.seq: (round(r.window_mean, 9), r.window_n) for r in found} == want and len(found) == len(rows)
        assert all(r.drifted == (r.metric == "m" and abs(r.window_mean - 0.5) > 0.03) for r in found if r.metric != "m" or abs(abs(r.window_mean - 0.5) - 0.03) > 1e-6)
    calls = [("s", i, i, "success" if rng.random() < 0.3 else None if i % 9 == 0 else "error") for i in range(300)]
    runs, at = [], []
    for c in [*calls, ("s", 0, 0, "success")]:
        if c[3] == "success":
            if len(at) >= 3:
                runs.append((len(at), at[0], at[-1]))
            at = []
        else:
            at.append(c[1])
    df = spark.createDataFrame(calls, "service_name string, invoked_at long, id long, status string").repartition(5)
    for block in (7, 100_000):
        assert sorted((r.length, r.first_at, r.last_at) for r in health.failure_streaks(df, 3, block).collect()) == sorted(runs)
    values = [(k, None if i % 11 == 0 else float(rng.randrange(50))) for k in ("a", None) for i in range(101)] + [("z", None), ("o", 4.0)]
    found = {r.k: r.q for r in sequence.quantile(spark.createDataFrame(values, "k string, v double").repartition(4), ["k"], "v", 0.95, "q").collect()}
    assert found.keys() == {"a", None, "o"} and found["o"] == 4.0
    for k in ("a", None):
        assert abs(found[k] - np.quantile([v for x, v in values if x == k and v is not None], 0.95)) < 1e-9
    assert health.rolling_drift(df.limit(0).selectExpr("'m' AS metric", "id AS ts", "id AS seq", "1.0 AS value"), base).count() == 0


def test_cooldown_equals_fold(spark):
    rng, day = random.Random(6), 86_400
    rows = [("hot", rng.randrange(0, 300 * day), i) for i in range(900)] + [("rare", 40 * day * i, 1000 + i) for i in range(5)] + [(None, 7 * day * i, 2000 + i) for i in range(9)] + [(None, 7 * day, 1), ("x", None, 5)]
    df = spark.createDataFrame(rows, "kind string, s long, event_id long").selectExpr("kind", "timestamp_seconds(s) AS fired_at", "event_id").repartition(5)
    want = set()
    for k in ("hot", "rare", None):
        last = None
        for s in sorted({s for kind, s, _ in rows if kind == k and s is not None}):
            if last is None or s >= last + 7 * day:
                last = s
                want.add((k, min(e for kind, x, e in rows if kind == k and x == s)))
    assert {(r.kind, r.event_id) for r in health.cooldown(df).collect()} == want
    assert health.cooldown(df.limit(0)).count() == 0


def test_checksum_follows_content_and_not_order(spark):
    files = spark.range(3000).selectExpr("concat('f', id) AS path", "sha2(CAST(id AS STRING), 256) AS hash")
    one = curation.dataset_checksum(files).first()
    assert one == curation.dataset_checksum(files.repartition(7)).first() and one.n_files == 3000
    assert curation.dataset_checksum(files.where("path <> 'f7'")).first().checksum != one.checksum
    assert curation.dataset_checksum(files.limit(0)).first().checksum is None


def test_crowded_pages_are_tiled(spark):
    """Tiles give the pairs and best matches that all pairs of a page give."""
    rng = random.Random(12)

    def page(number, n, seed):
        own = random.Random(seed)
        out = []
        for i in range(n):
            x, y, w, h = own.uniform(0, 900), own.uniform(0, 900), own.choice([5, 20, 90, 700]) * own.random(), own.choice([5, 20, 90, 700]) * own.random()
            out.append((number, i, own.choice(["title", "table"]), x, y, x + w, y + h, 0.5))
        return out

    a = page(1, 300, 1) + page(2, 6, 2) + [(1, 900, "title", None, 1.0, 2.0, 3.0, 0.5), (1, 901, "title", 5.0, 5.0, 5.0, 5.0, 0.5), (4, 0, "title", 1.0, 1.0, 2.0, 2.0, 0.5), (None, 0, "title", 1.0, 1.0, 2.0, 2.0, 0.5)]
    b = [(p, i, t, x + rng.uniform(-3, 3), y, x2, y2, c) if x is not None else (p, i, t, x, y, x2, y2, c) for p, i, t, x, y, x2, y2, c in a if i % 7] + page(3, 2, 3)
    first, second = spark.createDataFrame(a, REGION).repartition(3), spark.createDataFrame(b, REGION).repartition(3)
    whole = {(r.page_id, r.type, r.i, r.j): r.iou for r in layout.pairs(first, second, 0.1, crowded=10**9).collect()}
    tiled = layout.pairs(first, second, 0.1, crowded=20).collect()
    assert len(tiled) == len(whole) > 100 and {(r.page_id, r.type, r.i, r.j): r.iou for r in tiled} == whole
    best = {(r.page_id, r.type, r.i): (r.j, r.iou) for r in layout.best_match(first, second, ["page_id", "type"], crowded=10**9).collect()}
    found = layout.best_match(first, second, ["page_id", "type"], crowded=20).collect()
    assert len(found) == len(best) == len(a) and {(r.page_id, r.type, r.i): (r.j, r.iou) for r in found} == best
    assert best[4, "title", 0] == (None, 0.0) and best[1, "title", 900] == (None, 0.0)
    with pytest.raises(ValueError):
        layout.pairs(first, second, 0.0)


def test_checksum_levels(spark):
    files = spark.range(4000).selectExpr("concat('f', id) AS path", "sha2(CAST(id AS STRING), 256) AS hash")
    one = curation.dataset_checksum(files, in_group=10).first()
    assert one == curation.dataset_checksum(files.repartition(5), in_group=10).first() and one.n_files == 4000
    assert curation.dataset_checksum(files.where("path <> 'f7'"), in_group=10).first().checksum != one.checksum


def test_label_maps(spark):
    rows = spark.createDataFrame([(" Document-Title ",), ("Figure / Caption",), ("seal",), (None,), ("PARAGRAPH",), ("page_break",)], "label string")
    got = lambda labels, native, unknown=None: {r.native: r.type for r in layout.map_classes(rows, labels, native(F.col("label")), unknown).collect()}
    assert got(layout.PRIMARY_LABELS, layout.primary_label) == {"document_title": "title", "figure_caption": "caption"}
    assert got(layout.SECONDARY_LABELS, layout.secondary_label) == {"paragraph": "text_block"}
    outer = got(layout.EXTERNAL_LABELS, layout.external_label, "text_block")
    assert "PAGE_BREAK" not in outer and outer[None] == outer["SEAL"] == "text_block"
    assert {r.native: r.n for r in layout.unmapped(rows, layout.PRIMARY_LABELS, layout.primary_label(F.col("label"))).collect()} == {"seal": 1, "": 1, "paragraph": 1, "page_break": 1}
