"""Training-set curation: selection, splits, labels, registries and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as g
from leafmill.operators.pages import in_source_window, material_bucket, resolve_dims

FAMILIES = {"segmentation": "geometry_a_used", "pose": "geometry_b_used"}


def hash_split(key: Column, seed: int = 42, parts: int = 5) -> Column:
    """``val`` for one key in ``parts``, by the first 32 bits of sha1(seed:key)."""
    head = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(head % parts == 0, "val").otherwise("train")


def group_split(items: DataFrame, stem: Column, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """All variants of a stem in one part, parts by rounded shares of the stems in hash order.

    The rank of a stem comes from counts per hash prefix, so no task sorts all stems.
    """
    rows = items.withColumn("stem", stem)
    stems = rows.select("stem").distinct().withColumn("h", F.sha1(F.concat(F.lit(f"{seed}|"), "stem").cast("binary"))).withColumn("b", F.substring("h", 1, 3))
    sizes = stems.groupBy("b").agg(F.count("*").alias("c"))
    before = sizes.select("b", (F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"))  # at most 4096 rows
    ranked = stems.join(F.broadcast(before), "b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "stem")))
    n_train, n_val = F.round(F.col("total") * train), F.round(F.col("total") * val)
    part = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return rows.join(ranked.select("stem", part.alias("part")), "stem")


def base_stem(name: Column) -> Column:
    """File name without extension and without a rotation mark; null stays null."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"_rot(0|90|180|270)$", "")


def case_suffix(case_id: Column) -> Column:
    """What follows the last ``_`` or ``/`` of a case id; empty if it ends with one, null stays null."""
    return F.regexp_extract(case_id, r"([^_/]+)$", 1)


def weight_tokens(notes: Column) -> Column:
    """material -> uri of ``weights:book=uri`` tokens."""
    return F.map_from_entries(F.transform(F.regexp_extract_all(notes, F.lit(r"weights:([a-z_]+)=(\S+)"), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, r"weights:([a-z_]+)=", 1), F.regexp_extract(t, r"=(\S+)", 1))))


def object_uri(uri: Column) -> Column:
    """Bucket and key of an s3 uri."""
    return F.struct(F.regexp_extract(uri, r"^s3://([^/]+)/(.+)$", 1).alias("bucket"), F.regexp_extract(uri, r"^s3://([^/]+)/(.+)$", 2).alias("key"))


def derived_uri(uri: Column, kind: str, sub: Column | None = None) -> Column:
    """Path of what is made from an artifact: corrected/, child (_0, _1) or oriented/, with the same name."""
    if kind == "child":
        return F.concat(F.regexp_replace(uri, r"\.[^./]+$", ""), F.lit("_"), sub.cast("string"), F.regexp_extract(uri, r"(\.[^./]+)$", 1))
    return F.regexp_replace(uri, r"^(.*/)([^/]+)$", f"$1{kind}/$2")


def seg_line(label: Column, points: list[g.Corner]) -> Column:
    """``class x1 y1 ...`` with six places; a null class is left out, a null coordinate is written as ``null``."""
    return F.concat_ws(" ", label.cast("string"), *[F.coalesce(g.fixed(v, 6), F.lit("null")) for p in points for v in p])


def corrected_set(lineage: DataFrame, window: str | None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training rows of accepted human corrections, one per family, and a count per reason for what was left out."""
    rows = resolve_dims(lineage.where("human_corrected AND acceptance_decision = 'accepted'"))
    rows = rows.withColumn("material", material_bucket(F.col("material_type")))
    reason = F.when(~in_source_window(F.col("human_correction_timestamp"), window), "outside_window").when(F.col("dims_source") == "rejected", "no_dimensions").when(~(F.col("geometry_a_used") | F.col("geometry_b_used")), "no_family")
    rows = rows.withColumn("reason", reason)
    skipped = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    families = F.filter(F.array(*[F.when(F.col(c), F.lit(f)) for f, c in FAMILIES.items()]), lambda x: x.isNotNull())
    kept = rows.where("reason IS NULL").withColumn("family", F.explode(families)).withColumn("part", hash_split(F.col("job_id"), seed))
    w, h = F.col("width"), F.col("height")
    box = [(F.lit(0.1), F.lit(0.1)), ((w - 10) / w, F.lit(0.1)), ((w - 10) / w, (h - 20) / h), (F.lit(0.1), (h - 20) / h)]
    return kept.withColumn("label", seg_line(F.lit(0), [(g.clip(x), g.clip(y)) for x, y in box])), skipped


def sufficiency(lineage: DataFrame, least: int = 10) -> DataFrame:
    """Corrections per family and material against the minimum; every cell of the grid is there."""
    spark = lineage.sparkSession
    rows = lineage.where("human_corrected AND acceptance_decision = 'accepted'").withColumn("material", material_bucket(F.col("material_type")))
    families = F.filter(F.array(*[F.when(F.col(c), F.lit(f)) for f, c in FAMILIES.items()]), lambda x: x.isNotNull())
    counts = rows.withColumn("family", F.explode(families)).groupBy("family", "material").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(f, m) for f in FAMILIES for m in ("book", "newspaper", "microfilm")], "family string, material string")
    return grid.join(counts, ["family", "material"], "left").select("family", "material", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= least).alias("enough"))


def folds(items: DataFrame, collections: list[str], key: Column) -> DataFrame:
    """Leave-one-collection-out folds: each row once per fold, held out in that of its collection, and its 70/15/15 part."""
    every = items.sparkSession.createDataFrame([(c,) for c in collections], "fold string")
    bucket = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(20))
    part = F.when(bucket < 14, "train").when(bucket < 17, "val").otherwise("test")
    return items.withColumn("part", part).crossJoin(F.broadcast(every)).withColumn("held_out", F.col("collection") == F.col("fold"))


def latest_dataset(registry: DataFrame) -> DataFrame:
    """Newest approved version of each family; of equal times the greater version, families without one have no row."""
    return registry.where("approved").groupBy("family").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every row with the names of the rules it breaks; a rule that is null is broken."""
    return rows.withColumn("broken", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull()))


def ascending(values: Column) -> Column:
    """Strictly ascending array."""
    steps = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: a < b)
    return F.when(F.size(values) < 2, True).otherwise(F.forall(steps, lambda x: x))


def fresh_layout(stored: Column, current: Column) -> Column:
    """Whether a stored layout was made from the current artifact; two nulls count as the same."""
    return F.get_json_object(stored, "$.layout_input.source_page_artifact_uri").eqNullSafe(current)


def without_layout(summary: Column) -> Column:
    """Map of the JSON object without its layout keys; null where nothing is left."""
    kept = F.map_filter(F.from_json(summary, "map<string,string>"), lambda k, _: ~k.isin("downsample", "layout_input", "layout_adjudication"))
    return F.when(F.size(kept) > 0, kept)


def correction_source(candidates: list[Column], requested: Column) -> Column:
    """Struct (allowed, default, chosen): distinct candidates in order; a requested one must be among them."""
    allowed = F.array_distinct(F.filter(F.array(*candidates), lambda x: x.isNotNull() & (x != "")))
    return F.struct(allowed.alias("allowed"), F.get(allowed, 0).alias("default"), F.when(requested.isNull(), F.get(allowed, 0)).when(F.array_contains(allowed, requested), requested).alias("chosen"))


def guardrails(policies: DataFrame) -> DataFrame:
    """Policies that ask for audit or service-level evidence and lack it."""
    rules = F.array(F.when(F.col("needs_audit") & F.col("audit_evidence").isNull(), "audit"), F.when(F.col("needs_slo") & F.col("slo_evidence").isNull(), "slo"))
    return policies.withColumn("missing", F.filter(rules, lambda x: x.isNotNull())).where(F.size("missing") > 0)


def dataset_checksum(files: DataFrame, in_group: int = 1000) -> DataFrame:
    """sha256 over the digests of groups of about ``in_group`` sorted path=hash lines, and the number of files.

    Groups are dealt by a hash of the path and their number follows that of the files; where
    there are more than ``in_group`` of them, runs of ``in_group`` digests are digested again,
    level by level, so nothing of any size meets in one place.  Files without path or hash are
    left out of the digest but counted; no files have no checksum.
    """
    groups = max(1, files.count() // in_group)
    bucket = F.conv(F.substring(F.sha1(F.col("path").cast("binary")), 1, 8), 16, 10).cast("long") % groups
    lines = F.array_join(F.sort_array(F.collect_list(F.concat("path", F.lit("="), "hash"))), "\n")
    parts = files.groupBy(bucket.alias("p")).agg(F.sha2(lines.cast("binary"), 256).alias("h"), F.count("*").alias("n"))
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n")
    digest = F.sha2(digests.cast("binary"), 256)
    while groups > in_group:
        groups = -(-groups // in_group)
        parts = parts.groupBy(F.floor(F.col("p") / in_group).alias("p")).agg(digest.alias("h"), F.sum("n").alias("n"))
    return parts.agg(F.when(F.count("*") > 0, digest).alias("checksum"), F.sum("n").alias("n_files"))


def workspace_params(rows: DataFrame) -> DataFrame:
    """Human crop if complete, else the gate's crop of model a, then b, else half the page."""
    whole = lambda p: F.col(f"{p}_x0").isNotNull() & F.col(f"{p}_x1").isNotNull()
    source = F.when(whole("h"), "human").when(whole("a"), "gate_a").when(whole("b"), "gate_b").otherwise("half_page")
    pick = lambda c, other: F.when(whole("h"), F.col(f"h_{c}")).when(whole("a"), F.col(f"a_{c}")).when(whole("b"), F.col(f"b_{c}")).otherwise(other)
    return rows.withColumns({"source": source, "x0": pick("x0", F.lit(0)), "x1": pick("x1", F.expr("width div 2"))})


def refresh_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases with the labels of their key: found, empty or missing, and whether a split is expected."""
    per = labels.groupBy("key").agg(F.count("box").alias("n"))
    rows = cases.withColumn("key", case_suffix(F.col("case_id"))).join(per, "key", "left")
    return rows.select("case_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").otherwise("found").alias("state"), (F.coalesce("n", F.lit(0)) >= 2).alias("split_expected"))
