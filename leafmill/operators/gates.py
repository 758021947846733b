"""Geometry and artifact quality gates: wide rows per page, one CASE chain, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geometry as g

#: Default thresholds of the gates, per material where they differ.
ASPECT = {"book": (0.3, 3.0), "newspaper": (0.3, 5.0), "archival_document": (0.5, 3.0), "microfilm": (0.3, 5.0)}
AREA = {"book": (0.15, 1.0), "newspaper": (0.10, 1.0), "archival_document": (0.15, 1.0), "microfilm": (0.15, 1.0)}
SOFT_THRESHOLD = {"book": 0.60, "newspaper": 0.50, "archival_document": 0.60, "microfilm": 0.60}
SPLIT_CONFIDENCE, TTA_VARIANCE, SMALL_PAGE = 0.75, 0.15, 0.30
MILD_AREA, STRONG_CONFIDENCE, STRONG_TTA, SLIVER = 0.08, 0.90, 0.90, 0.12
SIGNAL_FLOOR = 0.5


def per_material(values: dict, at: int | None = None) -> Column:
    """Column of the material's value; unknown materials get that of books."""
    pick = (lambda v: v) if at is None else (lambda v: v[at])
    out = F.lit(pick(values["book"]))
    for m, v in values.items():
        out = F.when(F.col("material_type") == m, F.lit(pick(v))).otherwise(out)
    return out


def named(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def sanity(corners: list[g.Corner], box: tuple[Column, ...], page_count: Column, fraction: Column, width: float, height: float, other: tuple[Column, ...] | None = None) -> Column:
    """Names of the failed sanity checks of a region."""
    inside = F.lit(True)
    for x, y in corners:
        inside = inside & x.between(0, width) & y.between(0, height)
    inside = inside & (box[0] >= 0) & (box[1] >= 0) & (box[2] <= width) & (box[3] <= height)
    w, h = box[2] - box[0], box[3] - box[1]
    low = per_material(AREA, 0) / F.when(page_count == 2, 2.0).otherwise(1.0)
    aspect = F.coalesce((w / F.nullif(h, F.lit(0.0))).between(per_material(ASPECT, 0), per_material(ASPECT, 1)), F.lit(False))
    checks = {"within_bounds": ~inside, "non_degenerate": ~((g.quad_area(corners) > 0) & (w > 0) & (h > 0)), "area_fraction_plausible": ~fraction.between(low, per_material(AREA, 1)), "aspect_ratio_plausible": ~((h > 0) & aspect), "corner_ordering_valid": ~g.is_convex(corners)}
    if other is not None:
        checks["regions_non_overlapping"] = (page_count == 2) & (g.iou(box, other) >= 0.1)
    return named(checks)


def agree(a: str = "a", b: str = "b") -> Column:
    """Both models give the same page count and split decision; null if one is missing."""
    x, y = F.col(a), F.col(b)
    return F.when(x.isNotNull() & y.isNotNull(), (x["page_count"] == y["page_count"]) & (x["split_required"] == y["split_required"]))


def passes_split(m: Column) -> Column:
    """Whether a model that asks for a split is sure of it; a null confidence counts as the other value."""
    return ~m["split_required"] | (F.least(m["confidence"], m["tta_agreement"]) >= SPLIT_CONFIDENCE)


def passes_variance(m: Column) -> Column:
    """Whether the variance of a model's passes is small enough; null if it is null."""
    return m["tta_variance"] <= TTA_VARIANCE


def select_geometry(pages: DataFrame) -> DataFrame:
    """Selected model, trust, reason and route of each page.

    ``a`` and ``b`` are structs (page_count, split_required, confidence, tta_agreement, tta_variance,
    min_area, failed: failed sanity checks), null where a model did not answer.
    """
    a, b = F.col("a"), F.col("b")
    has = {n: F.col(n).isNotNull() for n in ("a", "b")}
    sane = {n: F.coalesce(F.size(F.col(n)["failed"]) == 0, F.lit(False)) & has[n] for n in has}
    split = {n: sane[n] & F.coalesce(passes_split(F.col(n)), F.lit(False)) for n in has}
    left = {n: split[n] & F.coalesce(passes_variance(F.col(n)), F.lit(False)) for n in has}
    flags = pages.withColumns({f"_{k}_{n}": v[n] for k, v in (("sane", sane), ("split", split), ("left", left)) for n in has}).withColumn("structural_agreement", agree())
    l_a, l_b = F.col("_left_a"), F.col("_left_b")
    only_area = F.coalesce((F.size(b["failed"]) == 1) & (F.element_at(b["failed"], 1) == "area_fraction_plausible"), F.lit(False))
    tolerated = F.coalesce(
        (F.col("material_type") == "newspaper") & F.col("structural_agreement") & F.col("_sane_a") & only_area & l_a & (a["confidence"] >= STRONG_CONFIDENCE) & (a["tta_agreement"] >= STRONG_TTA)
        & (a["tta_variance"] <= TTA_VARIANCE) & (b["tta_variance"] <= TTA_VARIANCE) & (b["min_area"] >= MILD_AREA), F.lit(False))
    kept_all = (l_a | ~has["a"]) & (l_b | ~has["b"])
    high = has["a"] & has["b"] & F.coalesce(F.col("structural_agreement"), F.lit(False)) & (kept_all | tolerated)
    none = ~l_a & ~l_b
    small = l_a & l_b & (F.least(a["min_area"], b["min_area"]) < SMALL_PAGE)
    model = F.when(none, None).when(tolerated, "a").when(l_a & ~l_b, "a").when(l_b & ~l_a, "b").when(small, "b").when(b["confidence"] > a["confidence"], "b").otherwise("a")
    reason = F.when(none, None).when(tolerated, "mild_area_fallback").when(l_a != l_b, "sole_survivor").when(small, "page_area_preference").when(a["confidence"] == b["confidence"], "default_a").otherwise("higher_confidence")
    why = F.when(~none, None).when(~F.col("_sane_a") & ~F.col("_sane_b") & (has["a"] | has["b"]), "geometry_sanity_failed").when(~F.col("_split_a") & ~F.col("_split_b") & (has["a"] | has["b"]), "split_confidence_low").when(has["a"] | has["b"], "tta_variance_high").otherwise("geometry_selection_failed")
    route = F.when(none, "pending_human_correction").when(high, "accepted").otherwise("rectification")
    return flags.withColumns({"selected": model, "trust": F.when(none, None).when(high, "high").otherwise("low"), "selection_reason": reason, "review_reason": why, "route": route}).drop(*[f"_{k}_{n}" for k in ("sane", "split", "left") for n in has])


def largest_region(regions: DataFrame) -> DataFrame:
    """Per page the largest of its regions (page_id, region, area_fraction, sane) if the others are slivers and it is sane."""
    best = F.max(F.struct("area_fraction", F.col("region"), "sane"))
    rows = regions.groupBy("page_id").agg(best.alias("best"), F.sort_array(F.collect_list("area_fraction"), asc=False).alias("areas"))
    return rows.where(F.col("best.sane") & (F.coalesce(F.get("areas", 1), F.lit(0.0)) <= SLIVER)).select("page_id", F.col("best.region").alias("region"), F.col("best.area_fraction").alias("area_fraction"))


def observations(pages: DataFrame, key: str) -> DataFrame:
    """(key, metric, value) rows of a page's gates; what a page does not have gives no row.

    ``pages`` has the models ``a`` and ``b`` (structs, null: no answer), ``route`` and
    ``review_reason`` of the selection, ``blur_score``, ``border_score`` and
    ``foreground_coverage``, ``validation_route``, and ``rectification_confidence``.
    """
    number = lambda c: c.cast("double")
    values = {}
    for name in ("a", "b"):
        m = F.col(name)
        values |= {f"geometry_{name}.confidence": m["confidence"], f"geometry_{name}.tta_agreement": m["tta_agreement"], f"geometry_{name}.tta_variance": m["tta_variance"], f"geometry_{name}.split": number(m["split_required"])}
    values["structural_agreement"] = number(agree())
    route, why = F.col("route"), F.coalesce("review_reason", F.lit(""))
    routes = {"accepted": route == "accepted", "review": route.isin("pending_human_correction", "review"), "disagreement": F.coalesce(~agree(), F.lit(False))}
    routes |= {r: why == r for r in ("geometry_sanity_failed", "split_confidence_low", "tta_variance_high")}
    values |= {f"selection.{k}_fraction": F.when(route.isNotNull(), number(v)) for k, v in routes.items()}
    values |= {f"quality.{c}": F.col(c) for c in ("blur_score", "border_score", "foreground_coverage")}
    values |= {f"validation.{k}_fraction": number(F.col("validation_route") == k) for k in ("valid", "invalid", "rectification_triggered")}
    values["rectification.confidence"] = F.col("rectification_confidence")
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), number(v).alias("value")) for k, v in values.items()))
    return pages.select(key, F.inline(rows)).where("value IS NOT NULL")


def hard_checks(df: DataFrame, tolerance: int = 2, least_side: int = 16, least_bytes: int = 512, least_crop: float = 0.001) -> DataFrame:
    """Failed hard requirements of an artifact; a missing file fails that check alone."""
    w, h, ok = F.col("actual_w"), F.col("actual_h"), F.col("decodes")
    area = F.col("orig_w") * F.col("orig_h")
    crop = F.greatest(F.lit(0.0), (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")))
    solid = (w > 0) & (h > 0)
    rest = named({
        "valid_image": ~ok, "non_degenerate": ok & ~solid, "min_dimensions": ok & solid & ((w < least_side) | (h < least_side)), "min_file_size": ok & (F.col("byte_size") < least_bytes),
        "bounds_consistent": ~((F.col("x_min") >= 0) & (F.col("y_min") >= 0) & (F.col("x_max") <= F.col("orig_w")) & (F.col("y_max") <= F.col("orig_h"))), "crop_area_plausible": (area <= 0) | (crop / F.nullif(area, F.lit(0)) < least_crop),
        "dimensions_consistent": ok & solid & ((F.abs(w - F.col("post_w")) > tolerance) | (F.abs(h - F.col("post_h")) > tolerance)),
    })
    return df.withColumn("failed", F.when(~F.col("exists"), F.array(F.lit("file_exists"))).otherwise(rest))


def soft_score(df: DataFrame, with_geometry: bool = True, blur_lower_is_better: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of ramped quality signals against the material's threshold; newspapers pass when only geometry is low.

    Signals that ``weights`` does not name weigh 1; weights that sum to 0 give a null score.
    """
    news = F.col("material_type") == "newspaper"
    pick = lambda a, b: F.when(news, F.lit(a)).otherwise(F.lit(b))
    blur = F.col("blur_score") if blur_lower_is_better else 1 - F.col("blur_score")
    signals = {"skew": g.ramp_down(F.col("skew_residual"), 1.0, 5.0), "blur": g.ramp_down(blur, 0.4, 0.7), "border": g.ramp_up(F.col("border_score"), pick(0.2, 0.3), pick(0.4, 0.5)),
        "foreground": g.ramp_range(F.col("foreground_coverage"), pick(0.03, 0.1), pick(0.08, 0.2), pick(0.95, 0.9), pick(0.99, 0.95))}
    if with_geometry:
        signals |= {"geometry": g.ramp_up(F.col("confidence"), 0.5, 0.8), "tta": g.ramp_up(F.col("tta_agreement"), 0.7, 0.9)}
    df = df.withColumns({f"s_{k}": v for k, v in signals.items()})
    weight = {k: float((weights or {}).get(k, 1.0)) for k in signals}
    score = sum((F.col(f"s_{k}") * weight[k] for k in signals), F.lit(0.0)) / F.nullif(F.lit(sum(weight.values())), F.lit(0.0))
    low = named({k: F.col(f"s_{k}") < SIGNAL_FLOOR for k in signals})
    waiver = news & (F.size(low) > 0) & F.forall(low, lambda x: x.isin("geometry", "tta"))
    return df.withColumn("soft_score", score).withColumn("soft_passed", (F.col("soft_score") >= per_material(SOFT_THRESHOLD)) | waiver)


def first_pass_route(accepted: Column, validated: Column) -> Column:
    """``accept_now`` if a page is accepted and validated, else ``rectification``; null counts as not."""
    return F.when(accepted & validated, "accept_now").otherwise("rectification")


def rectification_score(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """0.5 plus weighted improvements, each relative to the larger of both values and 1, clipped."""

    def gain(k: str, sign: int) -> Column:
        scale = F.greatest(F.abs(before[k]), F.abs(after[k]), F.lit(1.0))
        return g.clip(sign * (after[k] - before[k]) / scale, -1.0, 1.0)

    return g.clip(0.5 + 0.35 * gain("border", 1) + 0.35 * gain("skew", -1) + 0.15 * gain("blur", 1) + 0.15 * gain("foreground", 1))


def rectification_warnings(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of what a rectification did not improve; null values give no warning."""
    return named({"border_score_not_improved": after["border"] <= before["border"], "skew_residual_not_improved": after["skew"] >= before["skew"], "blur_score_regressed": after["blur"] + 0.05 < before["blur"]})


def accept_rectified(confidence: Column, before: dict[str, Column], after: dict[str, Column], warnings: Column, least: float = 0.5) -> Column:
    """Reasons against the rectified artifact, all that apply; empty means it is used."""
    veto = F.array_contains(warnings, "skew_residual_not_improved") | F.array_contains(warnings, "border_score_not_improved")
    return named({"low_confidence": confidence < least, "skew_not_improved": after["skew"] >= before["skew"], "border_regressed": after["border"] < before["border"], "warning_veto": veto})


def second_pass_route(df: DataFrame) -> DataFrame:
    """Route after rectification: columns rectified, is_child, split_reported, fallback, route2, agreed2, trust2, valid2."""
    news = F.col("material_type") == "newspaper"
    why = (
        F.when(~F.col("rectified") & news & F.col("valid2"), None).when(~F.col("rectified"), "rectification_failed").when(F.col("is_child") & F.col("split_reported") & ~F.col("fallback"), "split_child_reports_split")
        .when(F.col("route2") != "accepted", F.when(F.coalesce(~F.col("agreed2"), F.lit(False)), "structural_disagreement_post_rectification").when(F.col("review2").isNotNull(), F.col("review2")).otherwise("low_geometry_trust"))
        .when(~F.col("valid2"), "artifact_validation_failed")
    )
    return df.withColumn("second_reason", why).withColumn("second_route", F.when(why.isNull(), "accepted").otherwise("pending_human_correction"))


def split_child_route(df: DataFrame, policy: str = "conditional") -> DataFrame:
    """Route of each child: accepted, direct review under ``disabled_direct_review``, or the second-pass route."""
    rows = second_pass_route(df)
    direct = F.lit(policy == "disabled_direct_review")
    return rows.withColumn("child_route", F.when(F.col("first_ok"), "accepted").when(direct, "pending_human_correction").otherwise(F.col("second_route")))


def next_state(mode: Column) -> Column:
    """State that follows acceptance in a pipeline mode; null and unknown modes go to ``accepted``."""
    return F.when(mode == "layout", "layout_detection").otherwise("accepted")


def gate_log(df: DataFrame, key: list[str], gate_type: str, payload: list[str]) -> DataFrame:
    """Flat audit rows; the id is a hash of the key, so a rerun writes the same rows."""
    return df.select(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(gate_type)), 256).alias("gate_id"), *key, F.lit(gate_type).alias("gate_type"), F.to_json(F.struct(*payload)).alias("payload"))
