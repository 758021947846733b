"""Layout regions: suppression, matching, numbering, columns and consensus.

A region row is (page_id, pos, type, x_min, y_min, x_max, y_max, confidence); ``pos`` is the
detector's order and breaks ties.  Folds run over the regions of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as g

TYPES = ("text_block", "title", "table", "image", "caption")
PAGE_TYPE = ["page_id", "type"]


def _box(s: Column) -> tuple[Column, ...]:
    return tuple(s[c] for c in g.BOX)


def nms(regions: DataFrame, most: float = 0.5) -> DataFrame:
    """Greedy suppression per page and type: by confidence, a region stays if its IoU with all kept ones is at most ``most``."""
    fields = F.struct((-F.col("confidence")).alias("order"), "pos", *g.BOX, "confidence")
    lists = regions.groupBy(*PAGE_TYPE).agg(F.sort_array(F.collect_list(fields)).alias("a"))
    kept = F.aggregate("a", F.slice("a", 1, 0), lambda acc, r: F.when(F.forall(acc, lambda k: g.iou(_box(k), _box(r)) <= most), F.concat(acc, F.array(r))).otherwise(acc))
    return lists.select(*PAGE_TYPE, F.inline(kept)).drop("order")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], crowded: int = 1000, in_tile: int = 32) -> DataFrame:
    """(keys, i, j, a_*, b_*) of boxes of equal keys: every overlapping pair is among them, once.

    On ordinary pages all boxes of a page meet; one count tells whether there are others.  Where the two sides have more than ``crowded``
    boxes of the same keys, their extent is cut into tiles of about ``in_tile`` boxes; a box
    goes to every tile that it touches, and a pair counts in the tile where its overlap begins.
    Boxes with a null coordinate overlap nothing.
    """
    x = a.select(*keys, F.col("pos").alias("i"), *(F.col(c).alias(f"a_{c}") for c in g.BOX))
    y = b.select(*keys, F.col("pos").alias("j"), *(F.col(c).alias(f"b_{c}") for c in g.BOX))
    both = a.select(*keys, *g.BOX).unionByName(b.select(*keys, *g.BOX)).groupBy(*keys).agg(F.count("*").alias("_n"), F.min("x_min").alias("_x"), F.max("x_max").alias("_to_x"), F.min("y_min").alias("_y"), F.max("y_max").alias("_to_y"))
    side = F.ceil(F.sqrt(F.col("_n") / in_tile))
    tiled = both.where(F.col("_n") > crowded)
    if tiled.isEmpty():
        return x.join(y, keys)
    tiled = tiled.select(*keys, "_x", "_y", side.alias("_side"), ((F.col("_to_x") - F.col("_x")) / side).alias("_w"), ((F.col("_to_y") - F.col("_y")) / side).alias("_h"))

    def tile(v: Column, start: str, width: str) -> Column:
        at = F.floor((v - F.col(start)) / F.col(width))
        return F.coalesce(F.when(F.col(width) > 0, F.least(F.greatest(at, F.lit(0)), F.col("_side") - 1)), F.lit(0)).cast("int")

    def touched(rows: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi, start, width: F.explode(F.sequence(tile(F.col(p + lo), start, width), tile(F.greatest(p + lo, p + hi), start, width)))
        rows = rows.join(tiled, keys, "left")
        return rows.select("*", span("x_min", "x_max", "_x", "_w").alias("_tx")).select("*", span("y_min", "y_max", "_y", "_h").alias("_ty"))

    grid = ["_x", "_y", "_side", "_w", "_h"]
    met = touched(x, "a_").join(touched(y, "b_").drop(*grid), [*keys, "_tx", "_ty"])
    own = (F.col("_tx") == tile(F.greatest("a_x_min", "b_x_min"), "_x", "_w")) & (F.col("_ty") == tile(F.greatest("a_y_min", "b_y_min"), "_y", "_h"))
    return met.where(own).drop("_tx", "_ty", *grid)


def pairs(a: DataFrame, b: DataFrame, least: float, crowded: int = 1000) -> DataFrame:
    """Region pairs of a page and type with IoU of at least ``least``, which has to be above 0."""
    if least <= 0:
        raise ValueError("boxes that do not overlap are no pairs")
    met = overlapping(a, b, PAGE_TYPE, crowded).withColumn("iou", g.iou(g.cols("a_"), g.cols("b_")))
    return met.where(F.col("iou") >= least).select(*PAGE_TYPE, "i", "j", "iou")


def greedy_match(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one pairs by falling IoU, ties in input order."""
    lists = pairs(a, b, least).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("order"), "i", "j", "iou"))).alias("p"))
    start = F.slice("p", 1, 0)
    kept = F.aggregate("p", start, lambda acc, r: F.when(F.exists(acc, lambda k: (k["i"] == r["i"]) | (k["j"] == r["j"])), acc).otherwise(F.concat(acc, F.array(r))))
    return lists.select("page_id", F.inline(kept)).drop("order")


def type_histogram(a: DataFrame, b: DataFrame, most: int = 1) -> DataFrame:
    """Per page: counts of every type differ by at most ``most``; a missing type counts 0."""
    x, y = (d.groupBy(*PAGE_TYPE).agg(F.count("*").alias(n)) for d, n in ((a, "n_a"), (b, "n_b")))
    both = x.join(y, PAGE_TYPE, "full")
    return both.groupBy("page_id").agg(F.bool_and(F.abs(F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))) <= most).alias("histogram_match"))


def consensus(a: DataFrame, b: DataFrame, least_ratio: float = 0.7, least_iou: float = 0.5, most_diff: int = 1) -> DataFrame:
    """Agreement of two detectors per page of the first; a page the second did not answer is never agreed."""
    n_a, n_b = (d.groupBy("page_id").agg(F.count("*").alias(n)) for d, n in ((a, "n_a"), (b, "n_b")))
    m = greedy_match(a, b, least_iou).groupBy("page_id").agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    rows = n_a.join(n_b, "page_id", "left").join(m, "page_id", "left").join(type_histogram(a, b, most_diff), "page_id", "left")
    single = F.col("n_b").isNull()
    rows = rows.select("page_id", "n_a", F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), (F.coalesce("histogram_match", F.lit(False)) & ~single).alias("histogram_match"), single.alias("single_model"))
    ratio = F.col("matched") / F.greatest("n_a", "n_b")
    score = g.clip(0.6 * ratio + 0.2 * F.col("mean_iou") + 0.2 * F.col("histogram_match").cast("double"))
    return rows.withColumns({"agreed": (ratio >= least_ratio) & F.col("histogram_match"), "consensus": F.when(F.col("single_model"), 0.0).otherwise(F.round(score, 6)), "mean_iou": F.round("mean_iou", 6)})


def adjudicate(pages: DataFrame) -> DataFrame:
    """Source of the final layout: agreed, n_a, n_b (null: no answer), external (region count, null: not asked or failed)."""
    source = F.when(F.col("agreed"), "local_agreement").when(F.col("external").isNotNull(), "external").when(F.col("n_a") > 0, "local_fallback_a").when(F.col("n_b") > 0, "local_fallback_b").otherwise("none")
    n = F.when(source == "external", F.col("external")).when(source == "local_fallback_b", F.col("n_b")).when(source == "none", 0).otherwise(F.col("n_a"))
    return pages.withColumns({"layout_source": source, "n_regions": n, "status": F.when(source == "none", "failed").otherwise("done")})


def recalibrate(regions: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """Confidence times 0.8 for regions under 1 % of the page and 0.9 within 5 % of an edge."""
    w, h = (F.lit(v) if isinstance(v, (int, float)) else v for v in (width, height))
    small = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")) < 0.01 * w * h
    edge = (F.col("x_min") <= 0.05 * w) | (F.col("x_max") >= w - 0.05 * w) | (F.col("y_min") <= 0.05 * h) | (F.col("y_max") >= h - 0.05 * h)
    return regions.withColumn("confidence", g.clip(F.col("confidence") * F.when(small, 0.8).otherwise(1.0) * F.when(edge, 0.9).otherwise(1.0)))


def renumber(regions: DataFrame, start: int = 1) -> DataFrame:
    """Ids r1, r2, ... of a page's regions from top to bottom, left to right, ties by pos; null places come first."""
    w = Window.partitionBy("page_id").orderBy("y_min", "x_min", "pos")
    return regions.withColumn("id", F.concat(F.lit("r"), (F.row_number().over(w) - 1 + start).cast("string")))


def cluster_1d(points: DataFrame, key: str, x: str, eps: Column) -> DataFrame:
    """Cluster number of each point: a gap wider than ``eps`` starts the next."""
    w = Window.partitionBy(key).orderBy(x)
    gap = F.when(F.col(x) - F.lag(x).over(w) > eps, 1).otherwise(0)
    return points.withColumn("_gap", gap).withColumn("cluster", F.sum("_gap").over(w)).drop("_gap")


def columns(regions: DataFrame, width: float = 1000.0, eps_fraction: float = 0.08) -> DataFrame:
    """Column count of each page with text, and the cuts between columns as fractions of its width."""
    text = regions.where("type = 'text_block'").select("page_id", ((F.col("x_min") + F.col("x_max")) / 2).alias("x"))
    means = cluster_1d(text, "page_id", "x", F.lit(eps_fraction * width)).groupBy("page_id", "cluster").agg(F.avg("x").alias("m"))
    w = Window.partitionBy("page_id").orderBy("m")
    cuts = means.withColumn("cut", g.clip((F.col("m") + F.lead("m").over(w)) / 2 / width))
    return cuts.groupBy("page_id").agg(F.count("*").alias("column_count"), F.sort_array(F.collect_list("cut")).alias("cuts"))


def page_dims(regions: DataFrame) -> DataFrame:
    """Page extent from its boxes: at least 1, 1000 without boxes."""
    return regions.groupBy("page_id").agg(F.coalesce(F.greatest(F.max("x_max"), F.lit(1.0)), F.lit(1000.0)).alias("width"), F.coalesce(F.greatest(F.max("y_max"), F.lit(1.0)), F.lit(1000.0)).alias("height"))


def layout_summary(regions: DataFrame, low: float = 0.5) -> DataFrame:
    """Mean confidence, share of low ones and counts by type of each page; null confidences enter no mean and are not low."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES]
    return regions.groupBy("page_id").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.count_if(F.col("confidence") < low) / F.count("*"), 6).alias("low_share"), *counts)


def observations(regions: DataFrame) -> DataFrame:
    """Per-page metric rows: mean confidence, region count, and the share of every type."""
    s = regions.groupBy("page_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), *[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    values = s.select("page_id", F.col("c").alias("mean_confidence"), F.col("n").cast("double").alias("region_count"), *[(F.col(t) / F.col("n")).alias(f"class_fraction_{t}") for t in TYPES])
    return values.unpivot("page_id", [c for c in values.columns if c != "page_id"], "metric", "value").withColumn("value", F.round("value", 6))


#: Native labels of the three layout detectors by the class that they stand for; fixed values.  None: no region.
PRIMARY_LABELS = {
    "text_block": ("text",),
    "title": ("title", "document_title", "doc_title", "paragraph_title", "section_header", "section_title"),
    "table": ("table",),
    "image": ("image", "figure", "chart"),
    "caption": ("caption", "figure_title", "figure_caption", "table_caption", "image_caption"),
}
SECONDARY_LABELS = {
    "text_block": ("text", "plain text", "paragraph", "body text", "list", "list_item", "list-item", "abstract", "reference", "references", "footnote", "footer", "page-footer", "page_footer"),
    "title": ("title", "section-header", "section_header", "header", "page-header", "page_header", "headline"),
    "table": ("table",),
    "image": ("figure", "image", "picture"),
    "caption": ("caption", "figure_caption", "figure-caption", "table_caption", "table-caption", "table_footnote", "table-footnote", "formula_caption", "formula-caption"),
    None: ("abandon", "isolate_formula", "isolate-formula", "formula", "equation", "algorithm", "code", "page_number", "page-number", "toc"),
}
EXTERNAL_LABELS = {
    "text_block": ("PARAGRAPH", "FORM_FIELD", "FOOTER", "HEADER", "FOOTNOTE", "ENDNOTE", "LIST_ITEM", "EQUATION"),
    "title": ("SECTION_HEADER", "TITLE", "HEADING", "SUBTITLE"),
    "table": ("TABLE",),
    "image": ("IMAGE", "PICTURE", "PHOTO", "FIGURE"),
    "caption": ("CAPTION",),
    None: ("PAGE_BREAK", "PAGE_NUMBER"),
}


def label_map(labels: dict[str | None, tuple[str, ...]]) -> dict[str, str | None]:
    return {native: kind for kind, natives in labels.items() for native in natives}


def primary_label(label: Column) -> Column:
    """Lower case, with one underscore for every run of blanks, hyphens and slashes."""
    return F.array_join(F.filter(F.split(F.lower(label), r"[\s/-]+"), lambda w: w != ""), "_")


def secondary_label(label: Column) -> Column:
    return F.lower(F.trim(label))


def external_label(label: Column) -> Column:
    return F.upper(label)


def map_classes(detections: DataFrame, labels: dict[str | None, tuple[str, ...]], native: Column, unknown: str | None = None) -> DataFrame:
    """``detections`` with ``native`` and ``type``, the class of each native label.

    Labels that stand for no region are dropped; those that no class lists, and null ones,
    become ``unknown`` or are dropped without one.  ``unmapped`` gives what a warning has to name.
    """
    known = F.create_map(*[F.lit(x) for n, kind in label_map(labels).items() for x in (n, kind or "")])
    rows = detections.withColumn("native", native)
    kind = F.when(F.col("native").isNull(), F.lit(None)).otherwise(F.element_at(known, F.col("native")))
    return rows.withColumn("type", F.coalesce(kind, F.lit(unknown))).where("type <> ''")


def unmapped(detections: DataFrame, labels: dict[str | None, tuple[str, ...]], native: Column) -> DataFrame:
    """native, n: labels that no class lists and how often they came; null labels count as empty."""
    rows = detections.select(F.coalesce(native, F.lit("")).alias("native"))
    return rows.where(~F.col("native").isin(*label_map(labels))).groupBy("native").agg(F.count("*").alias("n"))


def best_match(truth: DataFrame, predicted: DataFrame, keys: list[str], crowded: int = 1000) -> DataFrame:
    """Each truth box with its best prediction of the same keys; the first of equals; none gives IoU 0."""
    met = overlapping(truth, predicted, keys, crowded).withColumn("iou", g.iou(g.cols("a_"), g.cols("b_"), clamp=True))
    alone = truth.select(*keys, F.col("pos").alias("i"), F.lit(None).cast(predicted.schema["pos"].dataType).alias("j"), F.lit(0.0).alias("iou"))
    rows = met.where("iou > 0").select(*keys, "i", "j", "iou").unionByName(alone)
    best = F.max_by(F.struct("j", "iou"), F.struct("iou", (-F.col("j")).alias("j")))
    return rows.groupBy(*keys, "i").agg(best.alias("m")).select(*keys, "i", "m.j", "m.iou")


def cross_model(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per page: mean over the first detector's regions of the best IoU with the second's; 0 if either is empty."""
    m = best_match(a, b, ["page_id"])
    return m.groupBy("page_id").agg(F.round(F.avg("iou"), 6).alias("agreement"))
