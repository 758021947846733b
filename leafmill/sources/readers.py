"""Readers of labels, detector output, layout documents, alerts, baselines, policies and artifacts.

Each takes a DataFrame of raw text (column ``value`` or as named) or a path that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "case_id string, model string, material_type string, image_s3_key string, image_sha256 string, split_expected boolean, sub_page_count int, annotations struct<expected_class:string,bboxes:array<array<double>>,classes:array<int>,detections:array<struct<class_id:int,bbox_xyxy:array<double>,keypoints:array<array<double>>>>>, thresholds struct<confidence_min:double,iou_min:double,mean_keypoint_distance_max:double>"
MANIFEST = "cases array<struct<case_id:string,model:string,material_type:string,annotation_path:string>>"


def golden_cases(spark: SparkSession, manifest: str, case_glob: str, model: str | None = None, material: str | None = None) -> DataFrame:
    """Cases that the manifests under a path list, joined to their files.

    A case's path counts from the folder of its manifest, unless it names a store of its own, so
    files of one name in different folders stay apart.  Listed files that are missing give no row.
    """
    folder = F.regexp_replace(F.col("_metadata.file_path"), "[^/]*$", "")
    listed = spark.read.schema(MANIFEST).json(manifest, multiLine=True).select(folder.alias("folder"), F.inline("cases"))
    for column, value in (("model", model), ("material_type", material)):
        if value:
            listed = listed.where(F.col(column) == value)
    files = spark.read.schema(CASE).json(case_glob, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    path = F.regexp_replace("annotation_path", r"^(\./)+", "")
    keys = listed.select("case_id", F.when(path.rlike("^[a-z0-9]+:/"), path).otherwise(F.concat("folder", path)).alias("file"))
    return keys.join(files.drop("case_id"), "file").drop("file")


_REGISTRY = "version string, family string, uri string, checksum string, approved boolean, created_at string"


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Batches under a registry's path whose write has ended."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(f for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS")))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Dataset list: committed batches, or the entries of the old JSON document; a missing path is empty."""
    if path.endswith(".json"):
        return spark.read.schema(f"datasets array<struct<{', '.join(f'{a}:{b}' for a, b in (c.split() for c in _REGISTRY.split(', ')))}>>").json(path, multiLine=True).select(F.inline("datasets"))
    batches = _committed(spark, path)
    return spark.read.schema(_REGISTRY).parquet(*batches) if batches else spark.createDataFrame([], _REGISTRY)


def append_registry(rows: DataFrame, path: str, batch: str) -> bool:
    """Add rows to the dataset list as one batch; whether they were added.

    A batch has a name and a folder of its own, and counts once the marker of its end is there.
    A batch that is there already is left alone, and one that broke off is written anew, so a
    retry of a task or of the driver repeats no entry.  Repeated rows of a batch are repeated entries.
    """
    spark, place = rows.sparkSession, f"{path.rstrip('/')}/batch={batch}"
    if any(f.endswith(f"/batch={batch}") for f in _committed(spark, path)):
        return False
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").mode("overwrite").parquet(place)
    return True


def seg_labels(lines: DataFrame) -> DataFrame:
    """``class x1 y1 ... xn yn``: lines of fewer than five tokens are dropped, an odd last value is ignored."""
    t = F.split(F.trim("value"), r"\s+")
    n = F.floor((F.size("t") - 1) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col("t"), 2 * i + 1).cast("double").alias("x"), F.get(F.col("t"), 2 * i + 2).cast("double").alias("y")))
    return lines.withColumn("t", t).where(F.size("t") >= 5).withColumns({"class_id": F.get("t", 0).cast("int"), "points": points}).drop("t", "value")


def pose_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class cx cy w h`` and four ``kx ky v``: detections, and the lines with fewer than 17 tokens as rejects."""
    rows = lines.withColumn("t", F.split(F.trim("value"), r"\s+")).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    v = lambda i: F.get("t", i).cast("double")
    box = F.array(*[F.round(c, 6) for c in (v(1) - v(3) / 2, v(2) - v(4) / 2, v(1) + v(3) / 2, v(2) + v(4) / 2)])
    keypoints = F.array(*[F.array(F.round(v(5 + 3 * k), 6), F.round(v(6 + 3 * k), 6)) for k in range(4)])
    good = rows.where(F.size("t") >= 17).withColumns({"class_id": v(0).cast("int"), "box": box, "keypoints": keypoints}).drop("t", "value")
    return good, rows.where(F.size("t") < 17).drop("t")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """uri, size and sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("hash"))


def hash_mismatches(found: DataFrame, lineage: DataFrame) -> DataFrame:
    """Artifacts whose hash differs from the recorded one; null hashes and unknown uris are left out."""
    return found.join(lineage.select("uri", F.col("hash").alias("prior")), "uri").where("prior <> hash")


_BOX = "array<struct<label:string,score:string,coordinate:array<string>,bbox:array<string>,box:array<string>>>"


def _finite(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def flatten_detections(raw: DataFrame, labels: list[str]) -> DataFrame:
    """One row per box of ``raw`` JSON, under ``boxes`` or ``res.boxes``, with the reason if it is dropped."""
    parsed = F.from_json("raw", f"boxes {_BOX}, res struct<boxes:{_BOX}>")
    rows = raw.withColumn("p", parsed).select("page_id", F.posexplode(F.coalesce("p.boxes", "p.res.boxes")).alias("pos", "b"))
    label = F.regexp_replace(F.lower(F.trim(F.coalesce("b.label", F.lit("")))), r"[\s-]+", "_")
    coords = F.coalesce("b.coordinate", "b.bbox", "b.box")
    rows = rows.select("page_id", "pos", label.alias("label"), _finite(F.col("b.score")).alias("score"), *[_finite(F.get(coords, i)).alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))])
    reason = F.when(F.col("label") == "", "malformed").when(~F.col("label").isin(*labels), "unknown_label").when(F.col("score").isNull(), "bad_score").when(F.col("x_min").isNull() | F.col("y_min").isNull() | F.col("x_max").isNull() | F.col("y_max").isNull(), "bad_coordinate")
    return rows.withColumn("reason", reason)


_POLY = "poly:array<struct<x:double,y:double>>"
LAYOUT_DOC = f"entities array<struct<type:string,confidence:double,{_POLY}>>, layout_blocks array<struct<kind:string,subtype:string,text:string,{_POLY}>>, pages array<struct<blocks:array<struct<confidence:double,{_POLY}>>,tables:array<struct<confidence:double,{_POLY}>>,paragraphs:array<struct<confidence:double,{_POLY}>>,visual_elements:array<struct<type:string,confidence:double,{_POLY}>>>>"


def flatten_layout_doc(docs: DataFrame) -> DataFrame:
    """Elements of layout documents (page_id, doc as JSON): entities, else layout blocks, else the first page's parts.

    A layout block without polygon takes that of the paragraph in its place if both lists are
    equally long; paragraphs count only where no page block had a polygon.
    """
    d = docs.select("page_id", F.from_json("doc", LAYOUT_DOC).alias("d")).select("page_id", "d.*").withColumn("page", F.get("pages", 0))
    none = lambda t: F.expr(f"cast(array() as array<struct<type:string,confidence:double,text:string,{_POLY}>>)") if t is None else t
    item = lambda kind, conf, poly, text=None: F.struct(kind.alias("type"), conf.cast("double").alias("confidence"), (text if text is not None else F.lit(None).cast("string")).alias("text"), poly.alias("poly"))
    solid = lambda p: F.coalesce(F.size(p) > 0, F.lit(False))
    entities = F.filter(F.transform("entities", lambda e: item(F.coalesce(e["type"], F.lit("PARAGRAPH")), F.coalesce(e["confidence"], F.lit(0.5)), e["poly"])), lambda e: solid(e["poly"]))
    heading = lambda b: F.lower(F.coalesce(b["subtype"], F.lit(""))).isin("header", "section-header", "heading", "title")
    kind = lambda b: F.when(b["kind"] == "table", "TABLE").when(b["kind"] == "list", "LIST_ITEM").when(b["kind"] == "image", "FIGURE").when((b["kind"] == "text") & heading(b), "SECTION_HEADER").otherwise("PARAGRAPH")
    spare = lambda i: F.when(F.size("page.paragraphs") == F.size("layout_blocks"), F.get(F.col("page.paragraphs"), i)["poly"])
    blocks = F.filter(F.transform("layout_blocks", lambda b, i: item(kind(b), F.lit(0.9), F.when(solid(b["poly"]), b["poly"]).otherwise(spare(i)), F.trim(b["text"]))), lambda e: solid(e["poly"]))
    part = lambda c, k: F.coalesce(F.filter(F.transform(c, lambda x: item(F.lit(k), F.coalesce(x["confidence"], F.lit(0.5)), x["poly"])), lambda e: solid(e["poly"])), none(None))
    page_blocks = part("page.blocks", "PARAGRAPH")
    visual = F.coalesce(F.filter(F.transform("page.visual_elements", lambda x: item(F.upper(F.coalesce(x["type"], F.lit("FIGURE"))), F.coalesce(x["confidence"], F.lit(0.5)), x["poly"])), lambda e: solid(e["poly"])), none(None))
    third = F.concat(page_blocks, part("page.tables", "TABLE"), F.when(F.size(page_blocks) == 0, part("page.paragraphs", "PARAGRAPH")).otherwise(none(None)), visual)
    found = F.when(F.size(F.coalesce(entities, none(None))) > 0, entities).when(F.size(F.coalesce(blocks, none(None))) > 0, blocks).otherwise(third)
    tier = F.when(F.size(F.coalesce(entities, none(None))) > 0, 1).when(F.size(F.coalesce(blocks, none(None))) > 0, 2).otherwise(3)
    edge = lambda c, f: f(F.transform("e.poly", lambda p: p[c]))
    rows = d.select("page_id", tier.alias("tier"), F.posexplode(found).alias("pos", "e"))
    return rows.select("page_id", "tier", "pos", "e.type", "e.confidence", "e.text", edge("x", F.array_min).alias("x_min"), edge("y", F.array_min).alias("y_min"), edge("x", F.array_max).alias("x_max"), edge("y", F.array_max).alias("y_max"))


def parse_alerts(raw: DataFrame) -> DataFrame:
    """Alerts of webhook bodies (column ``raw``): values that are not numbers become 0, times may end in Z."""
    kind = "alerts array<struct<status:string,labels:struct<trigger_type:string,metric_name:string,metric_value:string,threshold_value:string>,startsAt:string>>"
    rows = raw.select(*[c for c in raw.columns if c != "raw"], F.inline(F.from_json("raw", kind)["alerts"]))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return rows.select(*[c for c in raw.columns if c != "raw"], F.coalesce("status", F.lit("firing")).alias("status"), "labels.trigger_type", "labels.metric_name", number("labels.metric_value").alias("metric_value"), number("labels.threshold_value").alias("threshold_value"), F.try_to_timestamp("startsAt").alias("starts_at"))


def parse_baselines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """metric, mean, std of the JSON object in ``raw``; keys that begin with _ are notes; incomplete entries are rejects."""
    rows = raw.select(F.explode(F.from_json("raw", "map<string,string>")).alias("metric", "body")).where(~F.col("metric").startswith("_"))
    rows = rows.withColumn("b", F.from_json("body", "mean double, std double")).select("metric", "b.mean", "b.std")
    bad = F.col("mean").isNull() | F.col("std").isNull()
    return rows.where(~bad), rows.where(bad).select("metric")


def policy_thresholds(policies: DataFrame, defaults: DataFrame) -> DataFrame:
    """Thresholds of the latest policy (version, config as JSON, applied_at) over the defaults (material, field, value).

    Per-material entries ``{"field": {"material": v}}`` win over plain ones ``{"field": v}``; values that are not
    numbers leave the default.
    """
    latest = policies.agg(F.max_by("config", F.struct("applied_at", "version")).alias("config"))
    fields = latest.select(F.explode(F.from_json("config", "map<string,string>")).alias("field", "body"))
    plain = fields.select("field", F.col("body").try_cast("double").alias("plain")).where("plain IS NOT NULL")
    special = fields.select("field", F.explode(F.from_json("body", "map<string,string>")).alias("material", "v")).select("field", "material", F.col("v").try_cast("double").alias("special")).where("special IS NOT NULL")
    rows = defaults.join(F.broadcast(plain), "field", "left").join(F.broadcast(special), ["field", "material"], "left")
    return rows.select("material", "field", F.coalesce("special", "plain", "value").alias("value"))


def checked_bounds(thresholds: DataFrame, defaults: DataFrame, low: str, high: str) -> DataFrame:
    """``thresholds`` where each material's ``low`` and ``high`` hold 0 <= low <= high <= 1; where not, both are the defaults."""
    pair = thresholds.where(F.col("field").isin(low, high)).groupBy("material").agg(F.max(F.when(F.col("field") == low, F.col("value"))).alias("lo"), F.max(F.when(F.col("field") == high, F.col("value"))).alias("hi"))
    bad = pair.where("NOT coalesce(0 <= lo AND lo <= hi AND hi <= 1, false)").select("material", F.lit(True).alias("_bad"))
    rows = thresholds.join(F.broadcast(bad), "material", "left").join(F.broadcast(defaults.select("material", "field", F.col("value").alias("_default"))), ["material", "field"], "left")  # a row for each material and field
    return rows.select("material", "field", F.when(F.col("_bad") & F.col("field").isin(low, high), F.col("_default")).otherwise(F.col("value")).alias("value"))


def ingest_jobs(submissions: DataFrame, most_pages: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs and their pages from (job_id, material_type, pages: array of struct page_number, uri).

    Rejected are jobs that repeat a page number, lack one, or have one outside 1 to ``most_pages``.
    """
    pages = submissions.select("job_id", F.inline("pages"))
    bad = pages.groupBy("job_id", "page_number").agg(F.count("*").alias("n")).where(f"n > 1 OR page_number IS NULL OR page_number NOT BETWEEN 1 AND {most_pages}").select("job_id").distinct()
    good = submissions.join(bad, "job_id", "left_anti")
    jobs = good.select("job_id", "material_type", F.lit("queued").alias("status"), F.size("pages").alias("page_count"))
    rows = good.select("job_id", F.inline("pages")).select(F.concat_ws("/", "job_id", "page_number").alias("page_id"), "job_id", "page_number", F.col("uri").alias("input_uri"), F.lit("queued").alias("status"))
    return jobs, rows, bad
