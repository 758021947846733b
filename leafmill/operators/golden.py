"""Golden-set evaluation, gate merging, votes and model promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import sequence

GATES = ("geometry_iou", "split_precision", "structural_agreement", "golden_dataset", "latency_p95")


def golden_pairs(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Case pairs of one image key with equal hashes, and those whose hashes differ; of repeated keys the last case counts."""
    x, y = (d.groupBy("image_key").agg(F.max_by(F.struct("case_id", "sha"), "case_id").alias(n)) for d, n in ((a, "a"), (b, "b")))
    both = x.join(y, "image_key").select("image_key", F.col("a.case_id").alias("case_a"), F.col("b.case_id").alias("case_b"), (F.col("a.sha") == F.col("b.sha")).alias("same"))
    return both.where("same").drop("same"), both.where("NOT same").drop("same")


def classifier_gate(cases: DataFrame, least: float = 0.8) -> DataFrame:
    """Mean confidence against ``least``; a wrong class or a low confidence is a regression."""
    return cases.agg(F.round(F.avg("confidence"), 6).alias("value"), (F.avg("confidence") >= least).alias("pass"), F.count_if((F.col("predicted_class") != F.col("expected_class")) | (F.col("confidence") < F.col("confidence_min"))).alias("regressions"))


def segmentation_gate(cases: DataFrame, least: float = 0.75) -> DataFrame:
    """Mean best IoU and the share of right split decisions among expected splits (1 without any)."""
    expected = F.col("split_expected")
    rate = F.when(F.count_if(expected) == 0, 1.0).otherwise(F.count_if(expected & F.col("split_predicted")) / F.count_if(expected))
    wrong = F.count_if(expected != F.col("split_predicted")) + F.count_if(F.col("iou") < F.col("iou_min")) + F.count_if(F.col("confidence") < F.col("confidence_min"))
    return cases.agg(F.round(F.avg("iou"), 6).alias("value"), F.round(rate, 6).alias("split_rate"), ((F.avg("iou") >= least) & (rate == 1.0)).alias("pass"), wrong.alias("regressions"))


def pose_gate(cases: DataFrame, least_iou: float = 0.7, most_distance: float = 0.03) -> DataFrame:
    """Mean IoU (0 without match) and mean keypoint distance over matched cases (1 if there is none)."""
    iou = F.coalesce("iou", F.lit(0.0))
    distance = F.coalesce(F.avg("distance"), F.lit(1.0))
    return cases.agg(F.round(F.avg(iou), 6).alias("value"), F.round(distance, 6).alias("mean_distance"), ((F.avg(iou) >= least_iou) & (distance <= most_distance)).alias("pass"), F.count_if(F.col("iou").isNull()).alias("regressions"))


def mean_keypoint_distance(a: Column, b: Column) -> Column:
    """Mean distance of keypoints of equal position; null if the lists differ in length or hold a null."""
    d = F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x) / F.size(d)


def merge_gates(rows: DataFrame) -> DataFrame:
    """Per model and gate over materials: all pass, least value, summed regressions; one input passes through."""
    ok = F.coalesce("pass", F.lit(True))
    return rows.groupBy("service_name", "gate").agg(F.bool_and(ok).alias("pass"), F.when(F.count("*") == 1, F.min("value")).otherwise(F.round(F.min("value"), 4)).alias("value"), F.sum("regressions").alias("regressions"))


def merge_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every canonical gate of two models: both pass, the lesser value; a missing side fails with 0."""
    names = a.sparkSession.createDataFrame([(n,) for n in GATES], "gate string")
    x, y = (d.select("gate", F.col("pass").alias(f"pass_{n}"), F.col("value").alias(f"value_{n}")) for d, n in ((a, "a"), (b, "b")))
    rows = names.join(x, "gate", "left").join(y, "gate", "left")
    ok = F.coalesce(F.col("pass_a") & F.col("pass_b"), F.lit(False))
    return rows.select("gate", ok.alias("pass"), F.least(F.coalesce("value_a", F.lit(0.0)), F.coalesce("value_b", F.lit(0.0))).alias("value"))


def gate_summary(model_gates: DataFrame) -> DataFrame:
    """Per model: gates, those that passed (a missing verdict passes), and the names of the failed ones."""
    ok = F.coalesce("pass", F.lit(True))
    return model_gates.groupBy("model_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(~ok, F.col("gate")))), ",").alias("failed"))


def latest_model(models: DataFrame) -> DataFrame:
    """Newest model of each service and stage: archived ones by promotion, null first, the others by creation."""
    by = F.when(F.col("stage") == "archived", F.col("promoted_at")).otherwise(F.col("created_at"))
    w = Window.partitionBy("service_name", "stage").orderBy(by.desc_nulls_first(), "model_id")
    return models.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def promotion_plan(models: DataFrame, model_gates: DataFrame, force: bool = False) -> DataFrame:
    """What promoting the newest staged model of each service would do, and why it is blocked."""
    staged = latest_model(models).where("stage = 'staging'").select("service_name", "model_id")
    current = latest_model(models).where("stage = 'production'").select("service_name", F.col("model_id").alias("replaces"))
    rows = staged.join(gate_summary(model_gates), "model_id", "left").join(current, "service_name", "left")
    blocked = F.when(F.col("total").isNull(), "no_gate_results").when(F.col("failed") != "", "gates_failed")
    return rows.select("service_name", "model_id", "replaces", (blocked.isNull() | F.lit(force)).alias("promote"), blocked.alias("blocked_by"), F.when(F.lit(force), F.col("failed")).alias("bypassed"))


def rollback_plan(models: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Production model of each service, what a rollback restores, and whether it may happen by itself."""
    last = latest_model(models)
    live, old = last.where("stage = 'production'"), last.where("stage = 'archived'").select("service_name", F.col("model_id").alias("restores"))
    soon = F.coalesce(now - F.col("promoted_at") <= F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
    return live.select("service_name", "model_id", "promoted_at", soon.alias("automatic")).join(old, "service_name")


def vote(ballots: DataFrame, key: str) -> DataFrame:
    """Winner by count (the first seen of equals) and the mean confidence of its ballots."""
    counts = ballots.groupBy(key, "choice").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.avg("confidence").alias("c"))
    best = F.max_by(F.struct("choice", "n", "c"), F.struct("n", -F.col("first")))
    return counts.groupBy(key).agg(best.alias("b"), F.sum("n").alias("total")).select(key, F.col("b.choice").alias("choice"), F.col("b.n").alias("votes"), "total", F.round("b.c", 6).alias("confidence"))


def sampled_vote(ballots: DataFrame, key: str, small: int = 11, share: float = 0.2, most: int = 50, accept: float = 0.7) -> DataFrame:
    """All ballots of small groups; else a first sample, accepted at a clear majority, or both samples together.

    Samples are the first ballots in hash order.  Group sizes are aggregated, and only ballots
    whose rank can be within both samples are kept, so a group of any size is no single task.
    """
    sizes = ballots.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    take = F.when(F.col("n") < small, F.col("n")).otherwise(F.least(F.ceil(F.col("n") * share), F.lit(most)))
    ranked = Window.partitionBy(key).orderBy(F.sha1(F.col("pos").cast("string").cast("binary")), "pos")
    rows = ballots.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= max(2 * most, small))  # kept in each task before groups meet
    rows = rows.join(sizes.select("_key", take.alias("take")), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    one, two = vote(rows.where("r <= take"), key), vote(rows.where("r <= 2 * take"), key)
    clear = F.col("votes") / F.col("total") >= accept
    second = two.select(key, *(F.col(c).alias(f"{c}_2") for c in ("choice", "votes", "total", "confidence")))
    both = one.join(second, key)
    return both.select(key, *(F.when(clear, F.col(c)).otherwise(F.col(f"{c}_2")).alias(c) for c in ("choice", "confidence")), F.when(clear, 1).otherwise(2).alias("rounds"))


def tta_stats(passes: DataFrame, width: float, height: float) -> DataFrame:
    """Share of the modal page count and variance of the passes' centres (population, x plus y; under two passes 0)."""
    counts = passes.groupBy("page_id", "page_count").agg(F.count("*").alias("n")).groupBy("page_id").agg((F.max("n") / F.sum("n")).alias("agreement"))
    spread = passes.groupBy("page_id").agg(F.when(F.count("cx") < 2, 0.0).otherwise(F.var_pop(F.col("cx") / width) + F.var_pop(F.col("cy") / height)).alias("variance"))
    rows = counts.join(spread, "page_id")
    return rows.select("page_id", F.round("agreement", 4).alias("agreement"), F.round("variance", 6).alias("variance"), (F.col("agreement") < 0.80).alias("low_agreement"), (F.col("variance") > 0.10).alias("high_variance"))


def collection_metrics(runs: DataFrame) -> DataFrame:
    """Mean iou, split and agreement, and exact p95 of latency, of each collection; nulls enter none of them."""
    p95 = sequence.quantile(runs, ["collection"], "latency", 0.95, "p95").withColumnRenamed("collection", "_collection")
    means = runs.groupBy("collection").agg(*(F.avg(c).alias(c) for c in ("iou", "split", "agreement")))
    return means.join(p95, F.col("collection").eqNullSafe(F.col("_collection")), "left").drop("_collection")


def promotion_gates(candidate: DataFrame, production: DataFrame) -> DataFrame:
    """Candidate against production per collection: IoU -0.02, splits -0.03, agreement -0.05, p95 x 1.25 at most."""
    c, p = (d.select("collection", *(F.col(x).alias(f"{n}_{x}") for x in ("iou", "split", "agreement", "p95"))) for d, n in ((candidate, "c"), (production, "p")))
    ok = (F.col("c_iou") >= F.col("p_iou") - 0.02) & (F.col("c_split") >= F.col("p_split") - 0.03) & (F.col("c_agreement") >= F.col("p_agreement") - 0.05) & (F.col("c_p95") <= F.col("p_p95") * 1.25)
    return c.join(p, "collection").select("collection", ok.alias("pass"))


def bad_accept_rate(audits: DataFrame) -> DataFrame:
    """Flagged share of audited automatic acceptances per ISO week, with and without material."""
    week = F.format_string("%04dw%02d", F.extract(F.lit("YEAROFWEEK"), F.col("audited_at")), F.weekofyear("audited_at"))
    return audits.where("auto_accepted").withColumn("week", week).rollup("week", "material").agg(F.count("*").alias("n"), F.round(F.count_if("flagged") / F.count("*"), 4).alias("rate")).where("week IS NOT NULL")


def top_two(detections: DataFrame, key: str) -> DataFrame:
    """First two detections of each image in order of confidence: their sides, the cut between them and the least confidence."""
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "pos")
    rows = detections.withColumn("r", F.row_number().over(w)).where("r <= 2")
    two = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.min(F.struct("cx", "pos", "x_max")).alias("left"), F.max(F.struct("cx", "pos", "x_min")).alias("right"))
    cut = F.when(F.col("n") == 2, F.floor((F.col("left.x_max") + F.col("right.x_min")) / 2))
    return two.select(key, "n", F.round("confidence", 6).alias("confidence"), F.col("left.pos").alias("left_pos"), F.when(F.col("n") == 2, F.col("right.pos")).alias("right_pos"), cut.alias("split_x"))


def check_assignment(detections: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """State of each image's page boxes: none, single, duplicate class, low confidence, or how two pages lie."""
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "pos")
    rows = detections.withColumn("r", F.row_number().over(w)).where("r <= 2")
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("cls").alias("classes"), F.min("confidence").alias("c"), (F.max("cx") - F.min("cx")).alias("dx"), (F.max("cy") - F.min("cy")).alias("dy"))
    state = F.when(F.col("c") < least, "low_confidence").when(F.col("n") == 1, "single").when(F.col("classes") < 2, "duplicate_class").when(F.col("dx") > 1.5 * F.col("dy"), "horizontal").when(F.col("dy") > 1.5 * F.col("dx"), "vertical").otherwise("ambiguous")
    return s.select(key, "n", state.alias("state"))
